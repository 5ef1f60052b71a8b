"""Runs of code points that show nothing, and the messages that they carry.

A batch's texts that hold a suspect character are opened as arrays of code
points; kinds are told by ranges, with the neighbours on both sides, and runs
are the islands of one kind. Tags spell ASCII, variation selectors bytes, and
two sorts of zero-width characters bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.operators.spans import line_starts, lines_of

ISSUES = ["tag", "variation-selector", "bidi", "zero-width", "invisible-filler"]
#: Ranges of code points by issue. Fixed values.
RANGES = {
    "tag": [(0xE0000, 0xE007F)],
    "variation-selector": [(0xFE00, 0xFE0F), (0xE0100, 0xE01EF)],
    "bidi": [(0x061C, 0x061C), (0x200E, 0x200F), (0x202A, 0x202E), (0x2066, 0x2069)],
    "zero-width": [(0x180E, 0x180E), (0x200B, 0x200D), (0x2060, 0x2064), (0xFEFF, 0xFEFF)],
    "invisible-filler": [(0x00AD, 0x00AD), (0x034F, 0x034F), (0x115F, 0x1160), (0x3164, 0x3164), (0xFFA0, 0xFFA0)],
}
#: Pictographs, which joiners tie together, and scripts whose letters joiners shape. Fixed values.
PICTOGRAPHS = [(0xA9, 0xA9), (0xAE, 0xAE), (0x20E3, 0x20E3), (0x2300, 0x23FF), (0x2600, 0x27BF), (0x2B00, 0x2BFF), (0x1F000, 0x1FAFF)]
JOINING = [(0x0600, 0x06FF), (0x0750, 0x077F), (0x08A0, 0x08FF), (0x0900, 0x0DFF), (0x1780, 0x17FF)]
FLAG, CANCEL = 0x1F3F4, 0xE007F
#: Any of them in a text, as a Java expression.
SUSPECT = "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for ranges in RANGES.values() for a, b in ranges) + "]"
#: The range that all of them lie in, together with the controls; a text without any is told by few comparisons. Fixed value.
RARE = r"[\x00-\x08\x0E-\x1F\x7F\u00AD\u034F-\x{10FFFF}]"
#: Least run that can spell a message, by issue; share of printable characters that a message has. Fixed values.
LEAST = {"variation-selector": (4, 0.8), "zero-width": (16, 0.9)}


def is_suspect(text: Column) -> Column:
    return text.rlike(RARE) & text.rlike(SUSPECT)


def _in(points: np.ndarray, ranges: list[tuple[int, int]]) -> np.ndarray:
    out = np.zeros(len(points), bool)
    for a, b in ranges:
        out |= (points >= a) & (points <= b)
    return out


def _islands(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of equal values."""
    cuts = np.flatnonzero(np.diff(values)) + 1
    return np.concatenate([[0], cuts]), np.concatenate([cuts, [len(values)]])


def kinds(points: np.ndarray) -> np.ndarray:
    """For each code point 0, or the place in ISSUES, from 1, of what is odd about it."""
    before, after = np.concatenate([[0], points[:-1]]), np.concatenate([points[1:], [0]])
    of = {name: _in(points, ranges) for name, ranges in RANGES.items()}
    hidden = np.zeros(len(points), bool)
    for name in ISSUES:
        hidden |= of[name]
    shifted = lambda x, by: np.concatenate([[False], x[:-1]]) if by < 0 else np.concatenate([x[1:], [False]])
    odd = dict(of)
    # a flag of a region is a black flag, up to six letters or digits as tags, and the cancel tag
    starts, ends = _islands(of["tag"].astype(np.int8))
    for s, e in zip(starts, ends, strict=True):
        if of["tag"][s] and s and points[s - 1] == FLAG and e - s <= 7 and points[e - 1] == CANCEL and _in(points[s : e - 1], [(0xE0030, 0xE0039), (0xE0061, 0xE007A)]).all():
            odd["tag"] = odd["tag"].copy()
            odd["tag"][s:e] = False
    # one selector behind something visible picks a glyph
    selector = of["variation-selector"]
    alone = selector & ~shifted(selector, -1) & ~shifted(selector, 1)
    blank = np.array([chr(c).isspace() for c in before[alone]], bool) if alone.any() else np.zeros(0, bool)
    visible = np.zeros(len(points), bool)
    visible[alone] = (before[alone] > 0x20) & (before[alone] != 0x7F) & ~blank
    odd["variation-selector"] = selector & ~(alone & visible & ~shifted(hidden, -1))
    # a mark at the very start, joiners between pictographs and within scripts that join
    joiner = points == 0x200D
    joins = joiner & (_in(before, PICTOGRAPHS) | shifted(selector, -1)) & _in(after, PICTOGRAPHS)
    shapes = ((points == 0x200C) | joiner) & (_in(before, JOINING) | _in(after, JOINING))
    odd["zero-width"] = of["zero-width"] & ~joins & ~shapes
    if len(points) and points[0] == 0xFEFF:
        odd["zero-width"][0] = False
    soft = np.flatnonzero(points == 0xAD)
    if len(soft):
        odd["invisible-filler"] = odd["invisible-filler"].copy()
        odd["invisible-filler"][[i for i in soft if chr(before[i]).isalpha() and chr(after[i]).isalpha()]] = False
    out = np.zeros(len(points), np.int8)
    for place, name in reversed(list(enumerate(ISSUES, 1))):
        out[odd[name]] = place
    return out


def printable(text: str) -> float:
    """Share of characters that can be read: no controls but tab and line breaks, no replacement character."""
    fine = sum(c in "\t\n\r" or 0x20 <= ord(c) < 0x7F or (ord(c) >= 0xA0 and c != "\ufffd") for c in text)
    return fine / len(text) if text else 0.0


def message(issue: str, points: np.ndarray) -> str | None:
    """What a run spells, if anything."""
    if issue == "tag":
        text = "".join(chr(c - 0xE0000) for c in points if c not in (0xE0001, CANCEL))
        return text if text.strip() else None
    least, share = LEAST.get(issue, (len(points) + 1, 1.0))
    if len(points) < least:
        return None
    if issue == "variation-selector":
        low = points <= 0xFE0F
        text = np.where(low, points - 0xFE00, points - 0xE0100 + 16).astype(np.uint8).tobytes().decode("utf-8", "replace")
        return text if printable(text) > share else None
    sorts, first = np.unique(points, return_index=True)
    if len(sorts) != 2:
        return None
    zero = points[min(first)]
    bits = (points != zero)[: len(points) // 8 * 8]
    for bit in (bits, ~bits):  # either sort may be the 1
        text = np.packbits(bit).tobytes().decode("latin-1")
        if printable(text) > share:
            return text
    return None


def unicode_runs(files: DataFrame, keep: tuple[str, ...] = (), key: str = "file_id") -> DataFrame:
    """key, kept columns, issue, start and end (code points), n, line, column and decoded of each run in texts of files; null and empty texts have none. No shuffle."""
    columns = [key, *keep]
    rows = files.filter(is_suspect(F.col("text"))).select(*columns, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            owner, out = [], []
            for i, text in enumerate(b.column("text")):
                text = text.as_py()
                points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
                found = kinds(points)
                starts, ends = _islands(found)
                odd = found[starts] > 0
                starts, ends = starts[odd], ends[odd]
                begin = line_starts(text)
                line = lines_of(begin, starts)
                for s, e, at in zip(starts.tolist(), ends.tolist(), line.tolist(), strict=True):
                    issue = ISSUES[found[s] - 1]
                    out.append((issue, s, e, e - s, at + 1, s - int(begin[at]) + 1, message(issue, points[s:e])))
                owner += [i] * len(starts)
            types = [pa.string(), *[pa.int32()] * 5, pa.string()]
            at = pa.array(owner, pa.int64())
            yield pa.RecordBatch.from_arrays([*[b.column(c).take(at) for c in columns], *[pa.array([x[k] for x in out], t) for k, t in enumerate(types)]], [*columns, "issue", "start", "end", "n", "line", "column", "decoded"])

    kept = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in columns)
    return rows.mapInArrow(run, f"{kept}, issue string, start int, end int, n int, line int, column int, decoded string")


def zero_width_total(files: DataFrame, key: str = "file_id") -> DataFrame:
    """key and n: zero-width characters out of place in each text that has any."""
    runs = unicode_runs(files, key=key).filter("issue = 'zero-width'")
    return runs.groupBy(key).agg(F.sum("n").alias("n"))


def spelled(runs: DataFrame) -> Column:
    """Whether a run carries a message."""
    return runs["decoded"].isNotNull()
