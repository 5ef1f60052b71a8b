"""Secret scan: fixed patterns, and a linear-chain conditional random field over words.

The field tags each word (what stands between ASCII white space) as B (a secret
begins), I (it goes on) or O, by the word's shape, its two neighbours' shapes,
the distance to the last key word and features of the file. Every word of a
text is scored, and whole texts are decoded by Viterbi, all texts of a batch at
once. Weights are learned by maximum likelihood from windows of a bounded
sample of texts, the values found by the patterns being its secrets; plain words
that the field then takes for secrets are learned again as such. How sure it
has to be is set on texts held out, by planted secrets and plain words.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.llm.common import frugal, random_rows, release_memory, slices, small_batches
from siftwell.llm.words import ascii_words, ragged

#: Patterns, the group that is the value, and its least length. Fixed values.
PATTERNS = {
    "assign": (re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.A | re.I), 2, 8),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 16),
    "hex": (re.compile(r"[0-9a-f]+"), 0, 32),
}
KINDS = [*PATTERNS, "crf"]
_MAY_MATCH = r"(?i)password|passwd|secret|token|api_?key|AKIA|[0-9a-f]{32}"
_MARKED = r"(?i)[0-9=:\"'_/+]|pass|secret|token|key|auth|bearer|credential"
_KEYS_NEAR = r"(?i)password|passwd|passphrase|passcode|secret|token|api_?key|bearer|credential|\b(?:key|auth|login)\b"
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_EDGES = "\"'`()[]{}<>,;:.!?=#*$%&|"

#: Bounds of the sample that weights are learned from: at most SAMPLE_ROWS texts of at most SAMPLE_BYTES each, 30 MB.
SAMPLE_ROWS, SAMPLE_BYTES = 1500, 20_000
#: Bytes of text that are scored at a time; features take some hundred times as many.
BATCH_BYTES = 2 << 20
B, I, O = 0, 1, 2  # noqa: E741
LONGEST_TRAINED = 32

SHAPES = [
    "bias", "short", "middle", "long", "very_long", "digit", "many_digits", "upper", "lower", "mixed_letters", "letters_and_digits",
    "hexadecimal", "word_set", "varied", "assigns", "ends_assigning", "quoted", "key_word", "path_or_url", "mail", "number", "known_prefix", "plain", "edge",
    "case_changes", "consonants", "ends_quoted", "long_letters", "letters_of_any_case",
]


def base_spans(text: str) -> list[tuple[int, int, int, int, int]]:
    """start, kind, end, and start and end of the value, of what the patterns find; in order."""
    found = []
    for k, (pattern, group, least) in enumerate(PATTERNS.values()):
        for m in pattern.finditer(text):
            if m.end(group) - m.start(group) >= least:
                found.append((m.start(), k, m.end(), m.start(group), m.end(group)))
    return sorted(found)


_CASE_CHANGE = re.compile("[a-z](?=[A-Z])")
_CONSONANTS = re.compile("[b-df-hj-np-tv-xz]{5}", re.I)
_UPPER, _LOWER = re.compile("[A-Z]"), re.compile("[a-z]")
_HEXADECIMAL = re.compile("[0-9A-Fa-f]+")
_WORD_SET = re.compile("[A-Za-z0-9+/_=.-]+")
_KEY = re.compile("pass|secret|token|key|auth|bearer|credential", re.I)


def shape(word: str) -> np.ndarray:
    """Features of a word; an empty word stands for a text's edge."""
    core = word.strip(_EDGES)
    n = len(core)
    digits = 0 if core.isalpha() else sum(c.isdigit() for c in core)
    upper, lower = _UPPER.search(core) is not None, _LOWER.search(core) is not None
    # fewer than eight letters can't have three bits
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(core).values()) if n >= 8 and len(set(core)) >= 8 else 0.0
    return np.array(
        [
            1, n < 6, 6 <= n < 12, 12 <= n < 24, n >= 24, digits > 0, digits * 4 > n, upper, lower, upper and lower, digits > 0 and (upper or lower),
            n >= 8 and _HEXADECIMAL.fullmatch(core) is not None, _WORD_SET.fullmatch(core) is not None, entropy >= 3.0,
            "=" in word or ":" in word, word[-1:] in ("=", ":"), word[:1] in "\"'" and bool(word), _KEY.search(word) is not None,
            "//" in word or word.count("/") > 1, "@" in word, n > 0 and digits == n, core.startswith(("AKIA", "ghp_", "sk_", "xox")), n > 0 and core.isalpha(), not word,
            n >= 8 and len(_CASE_CHANGE.findall(core)) >= 2, n >= 8 and _CONSONANTS.search(core) is not None, word.rstrip(".,;")[-1:] in ("\"", "'") and bool(word), n >= 14 and core.isalpha(), n >= 12 and core.isalpha() and len(_CASE_CHANGE.findall(core)) >= 3,
        ],
        np.float32,
    )


@dataclass
class Field:
    """Weights: own, previous and next word's shapes (3 x features x tags), surroundings x tags, tag x next tag."""

    words: np.ndarray
    around: np.ndarray
    moves: np.ndarray


#: Surroundings of a word: many words of the file are marked, a key word stands in the file, the file is short, and a key word stands 1-2, 3-5, 6-9 or 10-15 words before; and one stands there and the word is long and of letters.
NEAR = (1, 3, 6, 10, 16)
AROUND = 3 + len(NEAR)


#: Code points below this one have their classes in tables; words with others, or longer than LONG bytes, go to shape() one by one. The long s is such another: it folds to an ASCII letter.
TABLED, LONG_S, LONG = 0x250, 0x17F, 1 << 16
#: Bytes of distinct words whose shapes are worked out at a time.
SHAPE_BYTES = 1 << 20


def _class(holds: Callable[[str], object]) -> np.ndarray:
    """Whether each tabled character is of a class; the last place stands for all other characters, of none."""
    return np.array([bool(holds(chr(c))) for c in range(TABLED)] + [False])


_CLASSES = {
    "digit": _class(str.isdigit),
    "alpha": _class(str.isalpha),
    "upper": _class(_UPPER.fullmatch),
    "lower": _class(_LOWER.fullmatch),
    "hexadecimal": _class(_HEXADECIMAL.fullmatch),
    "word_set": _class(_WORD_SET.fullmatch),
    "consonant": _class(re.compile(_CONSONANTS.pattern.removesuffix("{5}"), re.I).fullmatch),
}
_IS_EDGE, _IS_TAIL, _IS_ASSIGN, _IS_QUOTE = (_class(x.__contains__) for x in (_EDGES, ".,;", "=:", "\"'"))


def _varied(cp: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Whether cp[start:end] of each word has at least eight different characters and three bits of entropy."""
    out = np.zeros(len(start), bool)
    some = np.flatnonzero(end - start >= 8)
    if not len(some):
        return out
    n = (end - start)[some]
    keys = np.sort(np.repeat(np.arange(len(some)) * (TABLED + 1), n) + cp[ragged(start[some], n)])
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    times = np.diff(np.append(first, len(keys)))
    word = keys[first] // (TABLED + 1)
    entropy = np.log2(n) - np.bincount(word, times * np.log2(times), len(some)) / n
    good = (np.bincount(word, minlength=len(some)) >= 8) & (entropy >= 3.0)
    # so near the bound that the order of the sum decides; eight different characters alone have three bits exactly
    for k in np.flatnonzero((np.abs(entropy - 3.0) < 1e-9) & (n > 8)).tolist():
        core = "".join(map(chr, cp[start[some[k]] : end[some[k]]].tolist()))
        good[k] = shape(core)[SHAPES.index("varied")] > 0
    out[some] = good
    return out


def shapes(words: pa.Array) -> np.ndarray:
    """shape() of each word, none of them empty; all words of a block at once, by tables of classes of characters."""
    size = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(words), len(SHAPES)), np.float32)
    single = size > LONG
    usual = np.flatnonzero(~single)
    ends = np.cumsum(size[usual])
    for low in range(0, int(ends[-1]) if len(ends) else 0, SHAPE_BYTES):
        at = usual[np.searchsorted(ends, low, "right") : np.searchsorted(ends, low + SHAPE_BYTES, "right")]
        if len(at):
            out[at], single[at] = _shapes(words.take(pa.array(at)))
    for i in np.flatnonzero(single).tolist():
        out[i] = shape(words[i].as_py())
    return out


def _shapes(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """shapes() of a block, and which words have characters that aren't tabled, so that their rows don't hold."""
    length = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    last = np.cumsum(length)
    first = last - length
    cp = np.frombuffer("".join(words.to_pylist()).encode("utf-32-le"), "<u4")
    odd = np.add.reduceat(((cp >= TABLED) | (cp == LONG_S)).astype(np.int32), first) > 0
    cp = np.minimum(cp, TABLED).astype(np.intp)

    def count(flags: np.ndarray, start: np.ndarray = first, end: np.ndarray = last) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int32)])
        return np.where(end > start, sums[np.maximum(end, start)] - sums[start], 0)

    def bounds(trimmed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of each word without the trimmed characters at either end; end <= start if nothing is left."""
        places = np.arange(len(cp))
        start = np.minimum.reduceat(np.where(trimmed, len(cp), places), first)
        return np.minimum(start, last), np.maximum.reduceat(np.where(trimmed, -1, places), first) + 1

    start, end = bounds(_IS_EDGE[cp])
    end = np.maximum(end, start)
    n = end - start
    has = {k: table[cp] for k, table in _CLASSES.items()}
    inside = {k: count(has[k], start, end) for k in _CLASSES}
    digits, upper, lower = inside["digit"], inside["upper"] > 0, inside["lower"] > 0
    letters = (n > 0) & (inside["alpha"] == n)
    # a place counts if all that follows it in the pattern is inside
    changes = count(np.append(has["lower"][:-1] & has["upper"][1:], False), start, end - 1)
    run = has["consonant"].copy()
    for k in range(1, 5):
        run[: len(run) - k] &= has["consonant"][k:]
        run[max(len(run) - k, 0) :] = False
    consonants = count(run, start, end - 4) > 0
    assign, quote = _IS_ASSIGN[cp], _IS_QUOTE[cp]
    tail_end = bounds(_IS_TAIL[cp])[1]
    known = pc.match_substring_regex(pc.ascii_trim(words, characters=_EDGES), "^(AKIA|ghp_|sk_|xox)").to_numpy(zero_copy_only=False)
    key = pc.match_substring_regex(words, f"(?i){_KEY.pattern}").to_numpy(zero_copy_only=False)
    features = [
        np.ones(len(n), bool), n < 6, (n >= 6) & (n < 12), (n >= 12) & (n < 24), n >= 24, digits > 0, digits * 4 > n, upper, lower, upper & lower, (digits > 0) & (upper | lower),
        (n >= 8) & (inside["hexadecimal"] == n), (n > 0) & (inside["word_set"] == n), _varied(cp, start, end),
        count(assign) > 0, assign[last - 1], quote[first], key,
        count(cp == ord("/")) > 1, count(cp == ord("@")) > 0, (n > 0) & (digits == n), known, letters, np.zeros(len(n), bool),
        (n >= 8) & (changes >= 2), (n >= 8) & consonants, (tail_end > first) & quote[np.maximum(tail_end - 1, 0)], (n >= 14) & letters, (n >= 12) & letters & (changes >= 3),
    ]
    return np.stack(features, 1).astype(np.float32), odd


_EDGE = shape("")


@dataclass
class Words:
    """All words of some texts: offsets of each text's words, shapes of the distinct words and of an edge (last), each word's own, previous and next shape, and its surroundings."""

    offsets: np.ndarray
    shapes: np.ndarray
    own: np.ndarray
    before: np.ndarray
    after: np.ndarray
    around: np.ndarray

    def scores(self, field: Field) -> np.ndarray:
        s = self.shapes
        return (s @ field.words[0])[self.own] + (s @ field.words[1])[self.before] + (s @ field.words[2])[self.after] + self.around @ field.around


def featured(texts: pa.Array) -> Words:
    """The words of texts with their features; shapes are worked out once for each distinct word."""
    offsets, flat = ascii_words(texts)
    coded = flat.dictionary_encode()
    named = coded.dictionary
    table = np.concatenate([shapes(named), _EDGE[None]])
    n, edge, sizes = len(flat), len(named), np.diff(offsets)
    own = coded.indices.to_numpy(zero_copy_only=False).astype(np.int32)
    before, after = np.full(n, edge, np.int32), np.full(n, edge, np.int32)
    before[1:], after[:-1] = own[:-1], own[1:]
    full = sizes > 0
    firsts, lasts = offsets[:-1][full], offsets[1:][full] - 1
    before[firsts], after[lasts] = edge, edge
    says = lambda pattern: pc.match_substring_regex(named, pattern).to_numpy(zero_copy_only=False).astype(bool)[own]
    around = np.zeros((n, AROUND), np.float32)
    if n:
        key = says(_KEYS_NEAR)
        first_of = np.repeat(offsets[:-1], sizes)
        seen = np.concatenate([[-1], np.maximum.accumulate(np.where(key, np.arange(n), -1))[:-1]])
        gap = np.where(seen >= first_of, np.arange(n) - seen, 0)
        count = lambda x: np.add.reduceat(x.astype(np.int64), firsts)
        around[:, 0] = np.repeat(count(says(_MARKED)) * 10 > sizes[full], sizes[full])
        around[:, 1] = np.repeat(count(key) > 0, sizes[full])
        around[:, 2] = np.repeat(sizes[full] < 100, sizes[full])
        for k, (least, beyond) in enumerate(zip(NEAR, NEAR[1:], strict=False)):
            around[:, 3 + k] = (gap >= least) & (gap < beyond)
        around[:, -1] = around[:, 3:-1].any(1) & (table[own, SHAPES.index("long_letters")] > 0)
    return Words(offsets, table, own, before, after, around)


@dataclass
class Chain:
    """A window of a text for training: its words' shapes with one neighbour at either end, and their surroundings."""

    shapes: np.ndarray
    around: np.ndarray


def viterbi(scores: np.ndarray, moves: np.ndarray, starts: np.ndarray | None = None) -> np.ndarray:
    """The best tags of each text, whose first words are `starts`, between two O words. Ties fall to the later tag, so to O.

    All texts are one chain in which an O word stands between two texts. The
    chain is cut into blocks of equal length that are worked on side by side:
    the best way from each tag before a block to each at its end, then the
    blocks in turn, then back pointers within all blocks. This is exact, and
    takes as many steps as the root of the words, whatever the texts' lengths.
    """
    n = len(scores)
    if not n:
        return np.zeros(0, np.int64)
    size = max(1, math.isqrt(n))
    blocks = n // size + 1  # at least one word of padding, which is O
    s = np.full((blocks * size, 3), -1e30)
    s[:, O] = 0
    s[:n] = scores - scores[:, O:]  # an O word counts nothing, so sums stay small
    m = moves - moves[O, O]
    first = np.zeros(blocks * size, bool)
    if starts is not None:
        first[starts] = True
    first[0] = False  # before the first word there is O alone
    # places in a block, tags, blocks: the last axis is the long one
    s = np.ascontiguousarray(s.reshape(blocks, size, 3).transpose(1, 2, 0))
    first = np.ascontiguousarray(first.reshape(blocks, size).T)
    through = (m[:, O, None] + m[None, O, :])[:, :, None]  # by way of an O word

    def moved(t: int) -> np.ndarray:
        return np.where(first[t], through, m[:, :, None]) + s[t]

    ways = moved(0)
    for t in range(1, size):
        step = moved(t)
        ways = np.maximum(np.maximum(ways[:, 0, None] + step[None, 0], ways[:, 1, None] + step[None, 1]), ways[:, 2, None] + step[None, 2])
    entry = np.full((blocks, 3), -1e30)
    entry[0, O] = 0
    for k in range(1, blocks):
        entry[k] = (entry[k - 1][:, None] + ways[:, :, k - 1]).max(0)
    best, back = np.ascontiguousarray(entry.T), np.empty((size, blocks, 3), np.int8)
    for t in range(size):
        step = best[:, None] + moved(t)
        best = np.maximum(np.maximum(step[0], step[1]), step[2])
        back[t] = np.where(step[2] == best, 2, step[1] == best).T
    rows = np.arange(blocks)
    enters = np.tile(np.arange(3, dtype=np.int8), (blocks, 1))
    for t in range(size - 1, -1, -1):
        enters = back[t][rows[:, None], enters]
    at_end = np.full(blocks, O)
    for k in range(blocks - 1, 0, -1):
        at_end[k - 1] = enters[k, at_end[k]]
    tags = np.empty((blocks, size), np.int64)
    tag = at_end
    for t in range(size - 1, -1, -1):
        tags[:, t] = tag
        tag = back[t][rows, tag]
    return tags.reshape(-1)[:n]


#: Windows whose gradients are worked out at a time.
TRAIN_CHUNK = 2048


def _gradients(field: Field, x: np.ndarray, around: np.ndarray, y: np.ndarray, real: np.ndarray) -> list[np.ndarray]:
    """Sums over some windows of the negative log-likelihood's gradients: forward and backward over their places, all windows at once."""
    rows, longest = y.shape
    n, w, m = x.shape[2], field.words, field.moves
    flat, near = x.reshape(-1, n).astype(np.float32), around.astype(np.float32)
    gold = np.eye(3)[y] * real[:, :, None]
    ends = real.sum(1) - 1
    each = (flat @ w.transpose(1, 0, 2).reshape(n, 9).astype(np.float32)).reshape(rows, longest + 2, 3, 3)
    s = each[:, 1:-1, 0] + each[:, :-2, 1] + each[:, 2:, 2] + near @ field.around.astype(np.float32)
    # in probabilities, scaled at each place; places first
    e = np.ascontiguousarray(np.exp(s - s.max(2, keepdims=True)).transpose(1, 0, 2))
    go = np.exp(m - m.max())
    a, c = np.empty_like(e), np.empty((longest, rows, 1))
    for t in range(longest):
        a[t] = (a[t - 1] @ go if t else go[O]) * e[t]
        c[t] = a[t].sum(1, keepdims=True)
        a[t] /= c[t]
    b = np.broadcast_to(go[:, O], e.shape).copy()
    for t in range(longest - 2, -1, -1):
        b[t] = np.where((t < ends)[:, None], (e[t + 1] * b[t + 1] / c[t + 1]) @ go.T, b[t])
    z = (a * b).sum(2, keepdims=True)
    d = (a * b / z).transpose(1, 0, 2) * real[:, :, None] - gold
    onward = e[1:] * b[1:] / (c[1:] * z[1:]) * real[:, 1:].T[:, :, None]
    both = gold[:, :-1].reshape(-1, 3).T @ gold[:, 1:].reshape(-1, 3)
    g_moves = go * (a[:-1].reshape(-1, 3).T @ onward.reshape(-1, 3)) - both
    g_moves[O] += d[:, 0].sum(0)
    g_moves[:, O] += (d[np.arange(rows), ends]).sum(0)
    spread = np.zeros_like(each)
    spread[:, 1:-1, 0], spread[:, :-2, 1], spread[:, 2:, 2] = d, d, d
    g_words = (flat.T @ spread.reshape(-1, 9)).reshape(n, 3, 3).transpose(1, 0, 2)
    return [g_words, near.reshape(-1, near.shape[2]).T @ d.reshape(-1, 3), g_moves]


def train(found: list[Chain], tags: list[np.ndarray], steps: int = 150, rate: float = 0.1, penalty: float = 1e-3, begin: Field | None = None) -> Field:
    """Maximum likelihood by Adam over all chains, from zeros or another field. Features are kept as bytes, and TRAIN_CHUNK windows are worked on at a time, so memory stays small."""
    n, features = len(SHAPES), AROUND
    field = Field(np.zeros((3, n, 3), np.float64), np.zeros((features, 3)), np.zeros((3, 3)))
    if begin is not None:
        field = Field(begin.words.copy(), begin.around.copy(), begin.moves.copy())
    if not any((t != O).any() for t in tags):
        field.words[0][0, O] = 1.0  # nothing to learn from: all words are O
        return field
    longest = max(len(t) for t in tags)
    rows = len(tags)
    x = np.zeros((rows, longest + 2, n), np.uint8)
    y, real = np.full((rows, longest), O, np.int8), np.zeros((rows, longest), bool)
    around = np.zeros((rows, longest, features), np.uint8)
    for i, (c, t) in enumerate(zip(found, tags, strict=True)):
        x[i, : len(t) + 2], y[i, : len(t)], real[i, : len(t)], around[i, : len(t)] = c.shapes, t, True, c.around
    parameters = [field.words, field.around, field.moves]
    first, second = [np.zeros_like(p) for p in parameters], [np.zeros_like(p) for p in parameters]
    for step in range(1, steps + 1):
        sums = [np.zeros_like(p) for p in parameters]
        for k in range(0, rows, TRAIN_CHUNK):
            part = slice(k, k + TRAIN_CHUNK)
            for total, g in zip(sums, _gradients(field, x[part], around[part], y[part], real[part]), strict=True):
                total += g
        for q_, g, f, v in zip(parameters, sums, first, second, strict=True):
            g = g / rows + penalty * q_ / 10
            f += 0.1 * (g - f)
            v += 0.01 * (g * g - v)
            q_ -= rate * (f / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return field


_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
_LEADS = ["{} ", "{}: ", "{} = ", '{} = "', "{} is ", "{}='"]
_KEYS = ["key", "api key", "secret", "bearer", "auth", "password", "access token", "client_secret", "credential", "passphrase"]


def _value(r: np.random.Generator, words: list[str]) -> tuple[str, bool]:
    """A made-up secret, and whether its own letters give it away where no key word stands near."""
    sort = r.integers(8)
    if sort in (4, 6, 7) and words:  # a passphrase as one word
        return "".join(words[k].lower() for k in r.integers(len(words), size=int(r.integers(3, 6))))[:48], False
    if sort == 5 and words:  # a passphrase of words
        return " ".join(words[k].lower() for k in r.integers(len(words), size=int(r.integers(3, 7)))), False
    alphabet = "0123456789abcdef" if sort == 0 else _LETTERS[:52] if sort in (1, 2) else _LETTERS
    return "".join(alphabet[k] for k in r.integers(len(alphabet), size=int(r.integers(14, 44)))), True


def varied(text: str, spans: list[tuple[int, int, int, int, int]], r: np.random.Generator) -> tuple[str, list[tuple[int, int]]]:
    """The text with each found secret rewritten, and where the new values stand.

    Values are of another alphabet and length, letters alone or passphrases
    among them, after another key word and way to assign, some words after it,
    or alone.
    """
    words = [w for w in _WORD.findall(text[:20_000]) if w.isalpha() and w.isascii() and 3 <= len(w) <= 9]
    out, values, at, length = [], [], 0, 0
    for start, _, end, *_ in spans:
        if start < at:
            continue
        value, tells = _value(r, words)
        key = _KEYS[r.integers(len(_KEYS))]
        tail = ""
        how = r.random()
        if tells and how < 0.3:
            lead = ""
        elif words and how < 0.6:
            lead = f"the {key} for " + " ".join(words[k] for k in r.integers(len(words), size=int(r.integers(1, 6)))) + " is "
        else:
            lead = _LEADS[r.integers(len(_LEADS))].format(key)
        if " " in value:  # where a passphrase ends is told by its quotes
            mark = lead[-1:] if lead[-1:] in "\"'" and lead else '"'
            lead, tail = lead if lead.endswith(mark) else lead + mark, mark
        piece = text[at:start] + lead
        values.append((length + len(piece), length + len(piece) + len(value)))
        out.append(piece + value + tail)
        length += len(piece) + len(value) + len(tail)
        at = end
        if tail and text[at : at + 1] in ("'", '"'):
            at += 1  # the old value's closing quote
    return "".join(out) + text[at:], values


#: Bounds of the windows that weights are learned from: with a secret in a text and in all, and without one in a text as it stands; and rewritten copies of a text.
TEXT_WINDOWS, SECRET_WINDOWS, PLAIN_WINDOWS, COPIES = 20, 2500, 4, 16


def _cuts(tags: np.ndarray) -> list[int]:
    """Bounds of windows of about LONGEST_TRAINED words that split no secret shorter than that."""
    cuts = [0]
    while cuts[-1] < len(tags):
        stop = least = min(cuts[-1] + LONGEST_TRAINED, len(tags))
        while least > cuts[-1] + 1 and least < len(tags) and tags[least] == I:
            least -= 1
        cuts.append(least if least > cuts[-1] + 1 else stop)
    return cuts


#: One text in so many is held out to set the threshold; passes and steps that learn again what was taken for a secret, and how often such a window counts.
HELD_OUT, MINING, MINING_STEPS, MINED_WEIGHT = 4, 2, 60, 6
#: Steps by which an O word's score is raised, the margin added to the least one that will do, and the share of the field's spans that have to be planted secrets.
SHIFTS, MARGIN, PRECISION = np.arange(0, 12.5, 0.5), 1.5, 0.95
_RISKY = [SHAPES.index(x) for x in ("long", "very_long", "digit", "mixed_letters", "key_word", "quoted", "case_changes", "long_letters", "consonants")]


def _windows(w: Words, j: int, tags: np.ndarray, chosen: list[tuple[int, int]]) -> list[tuple[Chain, np.ndarray]]:
    """Chains and tags of some windows of text j."""
    first, out = int(w.offsets[j]), []
    for a, b in chosen:
        at = np.concatenate([[w.before[first + a]], w.own[first + a : first + b], [w.after[first + b - 1]]])
        out.append((Chain(w.shapes[at].astype(np.uint8), w.around[first + a : first + b].astype(np.uint8)), tags[a:b].astype(np.int8)))
    return out


def _tagged(text: str, n: int, values: list[tuple[int, int]]) -> np.ndarray:
    """Tags of a text's n words where the secrets stand at `values`."""
    spans = np.array([m.span() for m in _WORD.finditer(text)])
    tags = np.full(n, O)
    for s, e in sorted(values, reverse=True):
        a, b = np.searchsorted(spans[:, 1], s, "right"), np.searchsorted(spans[:, 0], e)
        tags[a:b], tags[a : a + 1] = I, B
    return tags


def _parts(items: Iterator, size: int = 16) -> Iterator[list]:
    while part := list(islice(items, size)):
        yield part


def learn(texts: list[str], seed: int = 1) -> Field:
    """Weights from texts, the values that the patterns find being the secrets.

    Each text with secrets is also learned with its secrets rewritten, so that
    the field goes by shape and neighbours and not by one pattern. Texts are cut
    into windows of LONGEST_TRAINED words for training. Where a text as it
    stands has words that the field takes for secrets and no pattern does, their
    windows are learned again as plain. One text in HELD_OUT takes no part: it
    sets the threshold (see calibrated).
    """
    r = np.random.default_rng(seed)
    held, used = texts[::HELD_OUT], [t for k, t in enumerate(texts) if k % HELD_OUT]

    def known() -> Iterator[tuple[bool, str, list[tuple[int, int]]]]:
        for t in used:
            base = base_spans(t)
            yield False, t, [x[3:] for x in base]
            for _ in range(COPIES if base else 0):
                yield True, *varied(t, base[:200], r)

    secret: list[tuple[Chain, np.ndarray]] = []
    rest: list[tuple[Chain, np.ndarray]] = []
    for part in _parts(known()):
        w = featured(pa.array([t for _, t, _ in part], pa.string()))
        for j, (copy, text, values) in enumerate(part):
            first, end = int(w.offsets[j]), int(w.offsets[j + 1])
            if first == end:
                continue
            tags = _tagged(text, end - first, values)
            cuts = _cuts(tags)
            windows = list(zip(cuts, cuts[1:], strict=False))
            has = [(a, b) for a, b in windows if (tags[a:b] != O).any()]
            none = [] if copy else [(a, b) for a, b in windows if (tags[a:b] == O).all()]
            odd = np.concatenate([[0], np.cumsum(w.shapes[w.own[first:end]][:, _RISKY].sum(1))])
            none.sort(key=lambda x: odd[x[0]] - odd[x[1]])
            few = none[: PLAIN_WINDOWS // 2] + [none[k] for k in r.integers(PLAIN_WINDOWS // 2, max(len(none), PLAIN_WINDOWS // 2 + 1), size=PLAIN_WINDOWS // 2) if k < len(none)]
            secret += _windows(w, j, tags, [has[k] for k in r.permutation(len(has))[:TEXT_WINDOWS]])
            rest += _windows(w, j, tags, few)
    # as many windows without a secret as eight times those with one are enough
    secret = [secret[k] for k in r.permutation(len(secret))[:SECRET_WINDOWS]]
    rest = [rest[k] for k in r.permutation(len(rest))[: 8 * len(secret) + 500]]
    field = train([c for c, _ in secret + rest], [t for _, t in secret + rest])
    mined: list[tuple[Chain, np.ndarray]] = []
    for _ in range(MINING if secret else 0):
        found = [x for part in _parts(iter(used)) for x in _mistaken(part, field)]
        if not found:
            break
        mined += found[: SECRET_WINDOWS // MINED_WEIGHT]
        every = secret + rest + mined * MINED_WEIGHT
        field = train([c for c, _ in every], [t for _, t in every], steps=MINING_STEPS, begin=field)
    del secret, rest, mined
    field = calibrated(field, held, seed)
    release_memory()
    return field


def _mistaken(texts: list[str], field: Field) -> list[tuple[Chain, np.ndarray]]:
    """Windows of texts in which the field tags words that the patterns don't find, as plain words."""
    w = featured(pa.array(texts, pa.string()))
    tags = viterbi(w.scores(field), field.moves, w.offsets[:-1][np.diff(w.offsets) > 0])
    out = []
    for j in np.unique(np.searchsorted(w.offsets, np.flatnonzero(tags != O), "right") - 1).tolist():
        first, end = int(w.offsets[j]), int(w.offsets[j + 1])
        right = _tagged(texts[j], end - first, [x[3:] for x in base_spans(texts[j])])
        wrong = np.flatnonzero((tags[first:end] != O) & (right == O))
        cuts = _cuts(right)
        chosen = sorted({(cuts[k], cuts[k + 1]) for k in (np.searchsorted(cuts, wrong, "right") - 1).tolist()})
        out += _windows(w, j, right, chosen)
    return out


def judged(field: Field, texts: list[str], seed: int = 2, shifts: np.ndarray = np.zeros(1)) -> list[tuple[int, int, int, int]]:
    """For each shift of an O word's score: spans of the field in texts as they stand that no pattern has, planted secrets that it finds, planted ones, and spans that are neither. Secrets are planted into copies of the texts that have some (see varied)."""
    r = np.random.default_rng(seed)
    cases = [(t, [x[3:] for x in base_spans(t)], False) for t in texts]
    cases += [(*varied(t, base[:200], r), True) for t in texts if (base := base_spans(t)) for _ in range(2)]
    out = np.zeros((len(shifts), 4), int)
    for part in _parts(iter(cases)):
        w = featured(pa.array([t for t, _, _ in part], pa.string()))
        scores, full = w.scores(field), w.offsets[:-1][np.diff(w.offsets) > 0]
        gold = [_tagged(t, int(n), v) if n else np.zeros(0, int) for (t, v, _), n in zip(part, np.diff(w.offsets), strict=True)]
        known = [_tagged(t, int(n), [x[3:] for x in base_spans(t)]) if n else np.zeros(0, int) for (t, _, _), n in zip(part, np.diff(w.offsets), strict=True)]
        for k, shift in enumerate(shifts):
            moved = scores.copy()
            moved[:, O] += shift
            tags = viterbi(moved, field.moves, full)
            for j, (_, _, planted) in enumerate(part):
                got = tags[w.offsets[j] : w.offsets[j + 1]]
                # runs of the field, less those that the patterns have already
                starts = np.flatnonzero((got != O) & np.concatenate([[True], (got[:-1] == O) | (got[1:] == B)])[: len(got)])
                ends = [int(np.flatnonzero(np.append(got[s + 1 :], O) != I)[0]) + s + 1 for s in starts]
                runs = [(s, e) for s, e in zip(starts.tolist(), ends, strict=True) if (known[j][s:e] == O).all()]
                wrong = sum((gold[j][s:e] == O).all() for s, e in runs)
                if not planted:
                    out[k, 0] += wrong
                    continue
                secrets = [s for s in np.flatnonzero(gold[j] == B).tolist() if known[j][s] == O]
                covered = np.zeros(len(got) + 1, bool)
                for s, e in runs:
                    covered[s:e] = True
                out[k] += [0, sum(covered[s] for s in secrets), len(secrets), wrong]
    return [tuple(x) for x in out.tolist()]


def calibrated(field: Field, texts: list[str], seed: int = 2) -> Field:
    """field with the O tag raised by the least shift, and MARGIN, at which it finds nothing in held-out texts as they stand and at least PRECISION of its spans in planted ones are the secrets; by the greatest one where none will do. Without held-out texts it stays as it is."""
    if not texts:
        return field
    results = judged(field, texts, seed, SHIFTS)
    fine = [k for k, (false, hits, _, wrong) in enumerate(results) if not false and wrong <= (1 - PRECISION) * (hits + wrong)]
    shift = SHIFTS[fine[0]] + (MARGIN if fine[0] else 0) if fine else SHIFTS[-1]
    words = field.words.copy()
    words[0][SHAPES.index("bias"), O] += shift
    return Field(words, field.around, field.moves)


def sample(docs: DataFrame, text: str = "text", rows: int = SAMPLE_ROWS, text_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """t: at most `rows` different texts up to text_bytes, those of the least hash, which is a random choice: two thirds of them hold an equals sign or colon, the others are any."""
    whole = docs.select(F.col(text).cast("string").alias("t")).filter(F.octet_length("t") <= text_bytes)
    marked = F.col("t").contains("=") | F.col("t").contains(":")
    seen = whole.agg(F.count("*").alias("n"), F.count_if(marked).alias("marked")).first()
    by_hash = [F.xxhash64("t"), F.col("t")]
    some = random_rows(whole.filter(marked).distinct(), seen["marked"], rows - rows // 3, by_hash)
    return some.unionAll(random_rows(whole.distinct(), seen["n"], rows // 3, by_hash))


def learned(docs: DataFrame, text: str = "text", rows: int = SAMPLE_ROWS, text_bytes: int = SAMPLE_BYTES) -> Field:
    """learn() over a bounded sample of docs, in one task: the driver gets the weights alone, some kilobytes. The texts stand in the order of a hash, so the order in which they come makes no difference."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = [t for b in batches for t in b.column("t").to_pylist()]
        field = learn(sorted(texts, key=lambda t: (hashlib.md5(t.encode()).digest(), t)))
        yield pa.RecordBatch.from_arrays([pa.array([x.astype(np.float64).tobytes()]) for x in (field.words, field.around, field.moves)], ["words", "around", "moves"])

    found = sample(docs, text, rows, text_bytes).coalesce(1).mapInArrow(frugal(run), "words binary, around binary, moves binary").first()
    weights = lambda x, *shape: np.frombuffer(x, np.float64).reshape(shape).copy()
    if found is None:  # an empty table has one partition or none
        return learn([])
    return Field(weights(found["words"], 3, len(SHAPES), 3), weights(found["around"], AROUND, 3), weights(found["moves"], 3, 3))


def secret_spans(texts: pa.Array, field: Field) -> list[list[tuple[int, int, int]]]:
    """For each text its spans as start, kind, end in code points: the patterns', and the field's that overlap none of them."""
    texts = pc.fill_null(texts, "")
    may = np.flatnonzero(pc.match_substring_regex(texts, _MAY_MATCH).to_numpy(zero_copy_only=False))
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(len(texts))]
    for i in may.tolist():
        out[i] = [s[:3] for s in base_spans(texts[i].as_py())]
    w = featured(texts)
    tags = viterbi(w.scores(field), field.moves, w.offsets[:-1][np.diff(w.offsets) > 0])
    secret = np.flatnonzero(tags != O)
    for i in np.unique(np.searchsorted(w.offsets, secret, "right") - 1).tolist():
        text, own = texts[i].as_py(), tags[w.offsets[i] : w.offsets[i + 1]]
        words = [m.span() for m in _WORD.finditer(text)]
        base, runs, last = [(x, y) for x, _, y in out[i]], [], -2
        for k in np.flatnonzero(own != O).tolist():
            s, e = words[k]
            core = text[s:e]
            s, e = s + len(core) - len(core.lstrip(_EDGES)), e - (len(core) - len(core.rstrip(_EDGES)))
            # the pattern's span stands for words that it overlaps
            if s >= e or any(s < y and x < e for x, y in base):
                continue
            if own[k] == I and last == k - 1:
                runs[-1][1] = e
            else:
                runs.append([s, e])
            last = k
        out[i] = sorted(out[i] + [(s, len(PATTERNS), e) for s, e in runs])
    return out


def scan(docs: DataFrame, field: Field, text: str = "text", redact: bool = False, mask: str = "[secret]") -> DataFrame:
    """docs with n_assign, n_access, n_hex, base_sha256 and spans of the whole text (null: empty).

    With redact, each secret is also replaced by `mask` in the text (null stays
    null) and the count columns are left out. Rows and other columns stay.
    """
    small_batches(docs.sparkSession)
    made = [] if redact else ["n_assign", "n_access", "n_hex", "base_sha256", "spans"]
    rows = docs.drop(*made)
    names = rows.columns

    def written(spans: list[tuple[int, int, int]]) -> str:
        return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text, BATCH_BYTES):
            texts = b.column(text)
            found = secret_spans(texts, field)
            if redact:
                clean = [_masked(texts[i].as_py(), s, mask) if s else None for i, s in enumerate(found)]
                hit = pa.array([bool(s) for s in found])
                new = pc.if_else(hit, pa.array(clean, pa.string()), texts)
                yield pa.RecordBatch.from_arrays([new if n == text else b.column(n) for n in names], names)
                continue
            base = [[x for x in s if x[1] < len(PATTERNS)] for s in found]
            counts = [pa.array([sum(x[1] == k for x in s) for s in base], pa.int64()) for k in range(len(PATTERNS))]
            digests = pa.array([hashlib.sha256(written(s).encode()).hexdigest() for s in base])
            yield pa.RecordBatch.from_arrays([*[b.column(n) for n in names], *counts, digests, pa.array([written(s) for s in found])], [*names, *made])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    more = "" if redact else ", n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    return rows.mapInArrow(frugal(run), schema + more)


def _masked(text: str, spans: list[tuple[int, int, int]], mask: str) -> str:
    """text with each stretch of overlapping spans replaced by one mask."""
    out, at = [], 0
    for s, _, e in spans:
        if e <= at:
            continue
        if s >= at:
            out.append(text[at:s] + mask)
        at = e
    return "".join(out) + text[at:]


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return scan(docs, learned(docs)).drop("text")
