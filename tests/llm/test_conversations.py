"""Conversation repair against a plain search over all edits."""

import functools
import hashlib
import random
import re
import zlib

import pytest

from siftwell.llm import conversations as cv
from siftwell.llm.registry import QUERIES

SPACE = " \t\n\x0b\x0c\r"


def damage(rows):
    """[(conv, turn, role, text)] after damage, by conversation; all named ones are there."""
    out = {c: [] for c, *_ in rows}
    for c, t, role, text in rows:
        said = lambda x: " " if x is None else str(x)
        h = zlib.crc32(f"{said(c)}:{said(t)}".encode()) % 20
        role, text = said(role), said(text)
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        role = "user" if h == 4 else role
        out[c] += [] if h == 0 else [(t, role, text)] * (2 if h == 3 else 1)
    return out


def key(role, text):
    return hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()


def repaired(rows):
    """The answer for one conversation's rows (turn, role, text)."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, key(r[1], r[2])))
    seen, faults = set(), []
    for _, role, text in rows:
        bare = text.strip(SPACE)
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None)
        seen.add((role, text))
    after = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    names = {"u": "user", "a": "assistant"}

    @functools.cache
    def best(i, q, inserts):
        options = [(0, "", ())] if i == len(rows) and q in ("", "a") else []
        if inserts < 3:
            for c in "ua":
                if (q, c) in after and (rest := best(i, after[q, c], inserts + 1)):
                    options.append((rest[0] + 5, "I" + rest[1], (f"{names[c]}:", *rest[2])))
        if i < len(rows):
            _, role, text = rows[i]
            if rest := best(i + 1, q, 0):
                options.append((rest[0] + 2, "D" + rest[1], rest[2]))
            if faults[i] not in ("blank", "duplicate"):
                more = 5 if faults[i] == "truncated" else 0
                made = [(0, "K", role[:1], role)] + [(1, "R", c, names[c]) for c in "ua"]
                for cost, letter, c, name in made:
                    if (q, c) in after and (rest := best(i + 1, after[q, c], 0)):
                        options.append((rest[0] + cost + more, letter + rest[1], (f"{name}:{text}", *rest[2])))
        return min(options, key=lambda o: o[:2]) if options else None

    for i in range(len(rows), -1, -1):  # keeps the recursion shallow
        for q in ("", "s", "u", "a"):
            best(i, q, 0)
    cost, audit, lines = best(0, "", 0)
    turns = [t for t, *_ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    pairs = [(a[1][:1] + b[1][:1]) for a, b in zip(rows, rows[1:], strict=False)]
    illegal = sum(p not in ("su", "ua", "au") for p in pairs)
    counts = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
    return gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def made_up(r, n_conv, longest):
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "User"]
    texts = ["Yes.", "No!", "", "   ", "cut off", "a. b", "Why?  \n", None, "ends. ", " ", "x" * 30 + "."]
    rows = []
    for c in range(n_conv):
        smooth = r.random() < 0.5
        for t in range(r.randrange(1, longest)):
            role = ("user", "assistant")[t % 2] if smooth and r.random() < 0.9 else r.choice(roles)
            text = f"{r.random()}." if r.random() < 0.6 else r.choice(texts)
            rows.append((c if c else None, r.choice([t, t, t, t + 1, None]) if r.random() < 0.3 else t, role, text))
    return rows


NAMES = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def check(got, rows):
    want = {c: repaired(x) for c, x in damage(rows).items()}
    got = {x["conv"]: tuple(x[n] for n in NAMES) for x in got}
    assert got.keys() == want.keys()
    for c in want:
        assert got[c] == want[c], c


@pytest.mark.parametrize("seed", [1])
def test_cuts_into_chunks_change_nothing(spark, seed):
    rows = made_up(random.Random(seed), 40, 30)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for chunk_rows, chunk_bytes, passes in ((4096, 4 << 20, 6), (1, 4 << 20, 2), (4, 4 << 20, 0), (4096, 100, 6)):
        check(cv.repair(cv.damaged(df.repartition(5)), chunk_rows, chunk_bytes, passes).collect(), rows)


def test_long_runs_that_never_converge(spark):
    """Every turn is of a role that has to change: costs hang on how many are left, odd or even, however long the run."""
    rows = [(1, t, "tool", f"say {t}.") for t in range(301)] + [(2, t, "user", f"ask {t}?") for t in range(200)] + [(3, t, "user", "same.") for t in range(150)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for passes in (0, 2):
        check(cv.repair(cv.damaged(df), 8, 4 << 20, passes).collect(), rows)


def test_reruns_stop_where_vectors_are_parallel():
    import numpy as np

    r = np.random.default_rng(3)
    codes = r.choice([0, 3, 5, 6, 7], 400)
    lengths = np.array([0, 100, 50, 250])
    ends = r.integers(0, 12, (4, 4))
    old = r.integers(0, 12, (4, 4))
    before = (old, cv.start_vectors(codes, lengths, old))
    plain = cv.start_vectors(codes, lengths, ends)
    assert (cv.start_vectors(codes, lengths, ends, before) == plain).all()
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    assert (cv.cost_vectors(codes, lengths, ends)[offsets[:-1] + np.arange(4)] == plain).all()


def test_op12_on_an_odd_folder(spark, tmp_path):
    rows = made_up(random.Random(9), 60, 12) + [(900, 0, "user", "Long. " * 100_000)] + [(901, t, "user", "dropped or not.") for t in range(40)]
    alone = [c for c in range(2000, 2400) if zlib.crc32(f"{c}:0".encode()) % 20 == 0]
    rows += [(c, 0, "user", "all of it is dropped.") for c in alone]
    df = spark.createDataFrame([(*x, 5, "clash") for x in rows], "conv_id long, turn long, role string, text string, cost int, conv string")
    df.write.parquet(str(tmp_path / "conversations.parquet"))
    got = QUERIES["op12_conversation_repair"](spark, str(tmp_path))
    assert dict(got.dtypes) == {"conv_id": "bigint", **dict.fromkeys(NAMES[:6], "bigint"), "audit": "string", "repaired_sha256": "string"}
    got = got.withColumnRenamed("conv_id", "conv").collect()
    check(got, rows)
    empty = hashlib.sha256(b"").hexdigest()
    assert alone and all(tuple(x[n] for n in NAMES) == (0, 0, 0, 0, 0, 0, "", empty) for x in got if x["conv"] in alone)
    df.limit(0).write.parquet(str(tmp_path / "none" / "conversations.parquet"))
    assert QUERIES["op12_conversation_repair"](spark, str(tmp_path / "none")).collect() == []


def test_string_names_and_lines(spark):
    rows = [("a", 0, "system", "Be kind."), ("a", 1, "user", "Hi."), ("b", 0, "assistant", "Hello."), ("b", 1, "user", "Hi."), ("b", 2, "user", "You?")]
    df = spark.createDataFrame(rows, "conv_id string, turn long, role string, text string")
    got = {x["conv"]: x for x in cv.repair(cv.as_turns(df)).collect()}
    for c in "ab":
        assert tuple(got[c][n] for n in NAMES) == repaired([r[1:] for r in rows if r[0] == c])
    lines = cv.repaired_lines(cv.as_turns(df), chunk_rows=1).orderBy("conv", "chunk", "place").collect()
    for c in "ab":
        text = "\n".join(x["line"] for x in lines if x["conv"] == c)
        assert hashlib.sha256(text.encode()).hexdigest() == got[c]["repaired_sha256"]
