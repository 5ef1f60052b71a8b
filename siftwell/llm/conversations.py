"""Conversation structure repair by rank-convergence parallel Viterbi.

A repaired conversation is empty, or an optional system turn and then turns of
user and assistant by pairs. The cheapest edits to one are a shortest path over
rows and four states; costs to the end run backward, and the audit, the least
in ASCII order among the cheapest, is read off forward.

All rows are sorted over range partitions and cut into chunks, so a
conversation may be of any length. One that lies within a chunk is solved
there. The chunks of the others start from a speculative vector of costs; in
fix-up passes a chunk takes over its successor's vector and is rerun until its
vectors differ from those of the pass before by a constant only, from where on
the old ones hold. Once no chunk changes, the vectors, stitched by their
constants, are exact, and each chunk traces its part of the audit.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwell.llm.common import frugal, stored

#: Rows and bytes of text at which a conversation is cut into a further chunk.
CHUNK_ROWS, CHUNK_BYTES = 4096, 4 << 20
#: Fix-up passes after which chunks that still change are settled by composing their transfer matrices.
MOST_PASSES = 6
_SPACE = r"\x20\x09-\x0D"

#: Costs of edits. Fixed values.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: What has been read so far: nothing, a system turn, ends with user, ends with assistant.
START, SYSTEM, USER, REPLY = range(4)
INITIALS = "sua"
#: The state behind a turn of an initial (s, u, a, any other); -1: not allowed there.
NEXT = np.array([[SYSTEM, USER, -1, -1], [-1, USER, -1, -1], [-1, -1, REPLY, -1], [-1, USER, -1, -1]])
#: The state behind an inserted or re-roled turn: each state lets only user, or only assistant, follow.
MADE = np.array([USER, USER, REPLY, USER])
#: Cost from each state to an allowed end, by insertions alone.
AT_END = np.array([0, 2 * INSERT, INSERT, 0])
FAR = 1 << 40
#: Insertions before a row, as roles by initial.
KINDS = ["", "u", "a", "ua", "au"]
ROLES = {"u": "user", "a": "assistant"}
#: Letters of edits: delete, keep, re-role to user, to assistant, none (the end).
OPS = ["D", "K", "R", "R", ""]
#: Pairs of initials that may stand side by side.
LEGAL = np.array([[False, True, False, False], [False, False, True, False], [False, True, False, False], [False] * 4])

# a row's code: 0 must be deleted, else 1 + 2 * initial + truncated
_CODE_KEEP = np.array([[-1] * 4] + [[NEXT[q][i] for q in range(4)] for i in range(4) for _ in range(2)])
_CODE_COST = np.array([0] + [TRUNCATED * t for _ in range(4) for t in range(2)])


def _steps() -> np.ndarray:
    """Costs from state to state over a row of each code, insertions before it included."""
    out = np.full((9, 4, 4), FAR)
    for code in range(9):
        bare = np.full((4, 4), FAR)
        for q in range(4):
            bare[q, q] = DELETE
            if code:
                bare[q, MADE[q]] = min(bare[q, MADE[q]], REROLE + _CODE_COST[code])
                if _CODE_KEEP[code, q] >= 0:
                    bare[q, _CODE_KEEP[code, q]] = min(bare[q, _CODE_KEEP[code, q]], _CODE_COST[code])
        for q in range(4):
            out[code, q] = np.minimum(bare[q], np.minimum(INSERT + bare[MADE[q]], 2 * INSERT + bare[MADE[MADE[q]]]))
    return out


STEP = _steps()


def _offsets(lengths: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])


def cost_vectors(codes: np.ndarray, lengths: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Costs to the end, by state, before each row of each chunk and behind its last one: chunk i's begin at its first row's place plus i."""
    offsets = _offsets(lengths)
    base = offsets[:-1] + np.arange(len(lengths))
    vectors = np.empty((len(codes) + len(lengths), 4), np.int64)
    vectors[base + lengths] = ends
    order = np.argsort(-lengths, kind="stable")
    shorter = -lengths[order]
    for j in range(int(lengths.max(initial=0))):
        live = order[: np.searchsorted(shorter, -j)]
        row = lengths[live] - 1 - j
        at = base[live] + row
        vectors[at] = (STEP[codes[offsets[live] + row]] + vectors[at + 1][:, None, :]).min(2)
    return vectors


def start_vectors(codes: np.ndarray, lengths: np.ndarray, ends: np.ndarray, before: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """Costs before each chunk's first row, given those behind its last one.

    With `before`, the end and start vectors of the pass before, a chunk is rerun
    only as far as its vectors differ from that pass's by more than a constant.
    """
    last = _offsets(lengths)[1:] - 1
    new = ends.copy()
    old = None if before is None else before[0].copy()
    live, j = np.flatnonzero(lengths), 0
    while len(live):
        step = STEP[codes[last[live] - j]]
        new[live] = (step + new[live][:, None, :]).min(2)
        j += 1
        more = lengths[live] > j
        if old is not None:
            old[live] = (step + old[live][:, None, :]).min(2)
            gap = new[live] - old[live]
            parallel = (gap == gap[:, :1]).all(1)
            new[live[parallel]] = before[1][live[parallel]] + gap[parallel, :1]
            more &= ~parallel
        live = live[more]
    return new


def traced(vectors: np.ndarray, codes: np.ndarray, lengths: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The edit of each row (its place in OPS plus 5 times that of the insertions before it in KINDS), and each chunk's state behind its last row, from its state before the first."""
    offsets = _offsets(lengths)
    base = offsets[:-1] + np.arange(len(lengths))
    edits, state = np.zeros(len(codes), np.uint8), starts.copy()
    order = np.argsort(-lengths, kind="stable")
    shorter = -lengths[order]
    for r in range(int(lengths.max(initial=0))):
        live = order[: np.searchsorted(shorter, -r)]
        row, at, every = offsets[live] + r, base[live] + r, np.arange(len(live))
        here, after = vectors[at], vectors[at + 1]
        first = q = state[live]
        inserted = np.zeros(len(live), np.int64)
        for _ in range(2):
            v = here[every, q]
            more = (v != DELETE + after[every, q]) & (v == INSERT + here[every, MADE[q]])
            inserted += more
            q = np.where(more, MADE[q], q)
        v, code = here[every, q], codes[row]
        delete = v == DELETE + after[every, q]
        to = _CODE_KEEP[code, q]
        keep = ~delete & (to >= 0) & (v == _CODE_COST[code] + after[every, to])
        state[live] = np.where(delete, q, np.where(keep, to, MADE[q]))
        op = np.where(delete, 0, np.where(keep, 1, np.where(MADE[q] == USER, 2, 3)))
        edits[row] = op + 5 * _kind(first, inserted)
    return edits, state


def _kind(state: np.ndarray, inserted: np.ndarray) -> np.ndarray:
    """Place in KINDS of so many insertions from a state."""
    return np.where(inserted == 0, 0, 2 * inserted - (MADE[state] == USER))


def end_edits(state: np.ndarray) -> np.ndarray:
    """The edit that stands for the insertions behind a conversation's last row."""
    return (4 + 5 * _kind(state, AT_END[state] // INSERT)).astype(np.uint8)


_LETTERS = pa.array(["I" * len(kind) + op for kind in KINDS for op in OPS])
_INSERTED = pa.array([None if not kind else "\n".join(f"{ROLES[c]}:" for c in kind) for kind in KINDS for _ in OPS])
_REROLED = pa.array([{2: "user", 3: "assistant"}.get(k % 5) for k in range(5 * len(KINDS))])


def rendered(edits: np.ndarray, lengths: np.ndarray, roles: pa.Array, texts: pa.Array, ends: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """Each chunk's part of the audit, and a list of its repaired `role:text` lines; `ends` are the edits behind the last rows."""
    n = len(lengths)
    offsets = _offsets(lengths)
    at_end = offsets[1:] + np.arange(n)
    places = np.ones(len(edits) + n, bool)
    places[at_end] = False
    every = np.empty(len(places), np.int64)
    every[places], every[at_end] = edits, ends
    row = np.cumsum(places) - 1
    source = pa.array(row, mask=~places)
    code = pa.array(every)
    kept = pa.array(places & (every % 5 != 0))
    own = pc.binary_join_element_wise(pc.coalesce(_REROLED.take(code), roles.take(source)), texts.take(source), ":")
    own = pc.if_else(kept, own, pa.scalar(None, own.type))
    inserted = _INSERTED.take(code).cast(own.type)
    lines = pc.coalesce(pc.binary_join_element_wise(inserted, own, "\n"), inserted, own)
    some = lines.is_valid()
    counted = _offsets(some.to_numpy(zero_copy_only=False))
    bounds = np.concatenate([[0], at_end + 1])
    audit = pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), _LETTERS.take(code)), "")
    return audit, pa.ListArray.from_arrays(pa.array(counted[bounds], pa.int32()), lines.filter(some))


def damaged(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv, turn, role, text and dropped of each row after damage by crc32(`conv:turn`) modulo 20; nulls of role, text and in the checksum are one space. Dropped rows stay, without a text."""
    some = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    h = F.pmod(F.crc32(F.concat(some(conv), F.lit(":"), some(turn)).cast("binary")), F.lit(20))
    rows = rows.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), some(role).alias("role"), some(text).alias("text"), h.alias("h"))
    new_text = F.when(F.col("h").isin(0, 1), "").when(F.col("h") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("h") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    rows = rows.select("conv", "turn", F.when(F.col("h") == 4, "user").otherwise(F.col("role")).alias("role"), new_text.alias("text"), (F.col("h") == 0).alias("dropped"), copies.alias("_copy"))
    return rows.drop("_copy")


def as_turns(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows of any table as repair() takes them, undamaged; nulls of role and text are one space."""
    some = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    return rows.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), some(role).alias("role"), some(text).alias("text"), F.lit(False).alias("dropped"))


def _ordered(turns: DataFrame) -> DataFrame:
    """turns with key (a digest of role and text), blank and truncated, in ranges of conversation and turn; rows of one turn stand by key. Rows that tie in all are dealt by row number and stand for each other."""
    blank = ~F.col("text").rlike(f"[^{_SPACE}]")
    truncated = ~F.col("text").rlike(rf"[.!?][{_SPACE}]*\z")
    key = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"))
    rows = turns.select("conv", "turn", "role", "text", "dropped", key.alias("key"), blank.alias("blank"), truncated.alias("truncated"), F.monotonically_increasing_id().alias("at"))
    order = ["conv", "turn", "key", "at"]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("at").withColumn("part", F.spark_partition_id())


_RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_PAYLOAD = "lines array<string>, roles array<string>, texts array<string>, keys array<string>, marks binary, first_turn long, last_turn long, turns long"


def _schema(conv: T.DataType, fields: str) -> T.StructType:
    return T.StructType([T.StructField("conv", conv), T.StructField("chunk", T.LongType()), *T.StructType.fromDDL(fields).fields])


def _runs(column: pa.Array) -> np.ndarray:
    """Where a column's value differs from the one before, and 0; nulls equal each other."""
    codes = column.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.flatnonzero(np.diff(codes)) + 1]).astype(np.int64)


def _marks(b: pa.RecordBatch) -> np.ndarray:
    """A byte a row: initial (0 to 3), 4 if blank, 8 if truncated."""
    first = pc.utf8_slice_codeunits(b.column("role"), 0, 1)
    initial = np.full(b.num_rows, 3, np.uint8)
    for k, c in enumerate(INITIALS):
        initial[pc.equal(first, c).to_numpy(zero_copy_only=False)] = k
    flag = lambda c: b.column(c).to_numpy(zero_copy_only=False).astype(np.uint8)
    return initial + 4 * flag("blank") + 8 * flag("truncated")


def _codes(marks: np.ndarray, duplicate: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Codes of rows, and which are blank, duplicate and truncated, by their first fault."""
    blank = (marks & 4) > 0
    duplicate = duplicate & ~blank
    truncated = ((marks & 8) > 0) & ~blank & ~duplicate
    return np.where(blank | duplicate, 0, 1 + 2 * (marks & 3) + truncated), blank, duplicate, truncated


def _sum_by(values: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(of[values], minlength=n).astype(np.int64)


class _Turns:
    """Turns of each chunk: smallest, largest and how many different ones, from rows sorted by turn, nulls first; and pairs of neighbours that may not be."""

    def __init__(self, turns: pa.Array, marks: np.ndarray, of: np.ndarray, n: int) -> None:
        known = turns.is_valid().to_numpy(zero_copy_only=False)
        value, owner = turns.filter(pa.array(known)).to_numpy(), of[known]
        new = np.ones(len(value), bool)
        new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
        self.different = _sum_by(new, owner, n)
        self.none = self.different == 0
        self.first, self.last = np.zeros(n, np.int64), np.zeros(n, np.int64)
        self.last[owner] = value
        self.first[owner[::-1]] = value[::-1]
        initial = marks & 3
        bad = np.zeros(len(of), bool)
        bad[1:] = (of[1:] == of[:-1]) & ~LEGAL[initial[:-1], initial[1:]]
        self.illegal = _sum_by(bad, of, n)

    def gaps(self) -> np.ndarray:
        return np.where(self.none, 0, self.last - self.first + 1 - self.different)


def _sha(lines: pa.Array) -> pa.Array:
    joined = pc.binary_join(lines, "\n")
    return pa.array([hashlib.sha256(x.as_buffer() or b"").hexdigest() for x in joined])


def _chunks(conv: pa.DataType, keep_lines: bool, chunk_rows: int, chunk_bytes: int):
    """Batches of sorted rows into a row a chunk: solved where the conversation lies within it, else (open) with what the passes need."""

    def solved(b: pa.RecordBatch, lengths: np.ndarray, ids: pa.Array, chunks: np.ndarray) -> pa.RecordBatch:
        n = len(lengths)
        of = np.repeat(np.arange(n), lengths)
        marks = _marks(b)
        keys = b.column("key").dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
        seen = np.ones(b.num_rows, bool)
        seen[np.unique(of * (keys.max(initial=0) + 1) + keys, return_index=True)[1]] = False
        codes, blank, duplicate, truncated = _codes(marks, seen)
        vectors = cost_vectors(codes, lengths, np.tile(AT_END, (n, 1)))
        edits, state = traced(vectors, codes, lengths, np.zeros(n, np.int64))
        audit, lines = rendered(edits, lengths, b.column("role"), b.column("text"), end_edits(state))
        turns = _Turns(b.column("turn"), marks, of, n)
        cost = vectors[_offsets(lengths)[:-1] + np.arange(n), START]
        done = [turns.gaps(), _sum_by(blank, of, n), _sum_by(duplicate, of, n), _sum_by(truncated, of, n), turns.illegal, cost]
        return made(ids, chunks, False, [pa.array(x) for x in done] + [audit, _sha(lines)], [lines] if keep_lines else [])

    def opened(b: pa.RecordBatch, lengths: np.ndarray, ids: pa.Array, chunks: np.ndarray) -> pa.RecordBatch:
        n = len(lengths)
        of, bounds = np.repeat(np.arange(n), lengths), pa.array(_offsets(lengths), pa.int32())
        marks = _marks(b)
        turns = _Turns(b.column("turn"), marks, of, n)
        lists = [pa.ListArray.from_arrays(bounds, b.column(c)) for c in ("role", "text", "key")]
        data = marks.tobytes()
        ends = _offsets(lengths)
        marked = pa.array([data[i:j] for i, j in zip(ends[:-1], ends[1:], strict=True)], pa.binary())
        known = [pa.array(x, mask=turns.none) for x in (turns.first, turns.last)]
        return made(ids, chunks, True, [None] * 4 + [pa.array(turns.illegal)], [None, *lists, marked, *known, pa.array(turns.different)])

    def made(ids: pa.Array, chunks: np.ndarray, is_open: bool, results: list, payload: list) -> pa.RecordBatch:
        values = [ids, pa.array(chunks), pa.array([is_open] * len(chunks)), *results, *[None] * (8 - len(results)), *payload, *[None] * (8 - len(payload))]
        return pa.RecordBatch.from_arrays([pa.nulls(len(chunks), f.type) if v is None else v.cast(f.type) for v, f in zip(values, fields, strict=True)], schema=fields)

    listed, number, text = pa.list_(pa.string()), pa.int64(), pa.string()
    types = [conv, number, pa.bool_(), *[number] * 6, text, text, *[listed] * 4, pa.binary(), *[number] * 3]
    names = "conv chunk open gaps blank duplicate truncated illegal cost audit repaired_sha256 lines roles texts keys marks first_turn last_turn turns".split()
    fields = pa.schema(list(zip(names, types, strict=True)))

    def emit(rows: pa.RecordBatch, starts: np.ndarray, is_open: np.ndarray, counter: int) -> Iterator[pa.RecordBatch]:
        live = ~rows.column("dropped").to_numpy(zero_copy_only=False)
        run = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, rows.num_rows)))
        ids, part = rows.column("conv").take(pa.array(starts)), rows.column("part")[0].as_py()
        for kind, solve in ((False, solved), (True, opened)):
            some = np.flatnonzero(is_open == kind)
            if len(some):
                lengths = np.bincount(run[live], minlength=len(starts))[some].astype(np.int64)
                chosen = rows.filter(pa.array(live & (is_open[run] == kind)))
                yield solve(chosen, lengths, ids.take(pa.array(some)), (part << 32) + counter + some)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry, torn, counter = None, True, 0
        for b in batches:
            if not b.num_rows:
                continue
            rows = b if carry is None else pa.concat_batches([carry, b])
            starts = _runs(rows.column("conv"))
            last = int(starts[-1])
            if last:
                # the first run may have begun in the partition before, or in an earlier chunk
                is_open = np.zeros(len(starts) - 1, bool)
                is_open[0] = torn
                yield from emit(rows.slice(0, last), starts[:-1], is_open, counter)
                counter, torn = counter + len(starts), False
            carry = rows.slice(last)
            if carry.num_rows >= chunk_rows or carry.nbytes >= chunk_bytes:
                cuts = np.arange(0, carry.num_rows, chunk_rows)
                yield from emit(carry, cuts, np.ones(len(cuts), bool), counter)
                counter, torn, carry = counter + len(cuts), True, None
        if carry is not None:
            yield from emit(carry, np.zeros(1, np.int64), np.ones(1, bool), counter)

    return run


def _flat(b: pa.RecordBatch, name: str, dtype: str) -> tuple[np.ndarray, np.ndarray]:
    """All values of a binary column, and each row's number of them."""
    parts = [np.frombuffer(x.as_buffer() or b"", dtype) for x in b.column(name)]
    return np.concatenate(parts) if parts else np.zeros(0, dtype), np.array([len(x) for x in parts], np.int64)


def _vec(b: pa.RecordBatch, name: str) -> np.ndarray:
    return b.column(name).flatten().to_numpy().astype(np.int64).reshape(-1, 4)


def _four(v: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, v.size + 1, 4), pa.int32()), pa.array(v.ravel()))


def _light(opens: DataFrame) -> DataFrame:
    """chunk, codes (a byte a row) and counts of faults of each open chunk: first places of a role and text are found over all chunks of its conversation."""
    keys = opens.select("conv", "chunk", F.posexplode("keys").alias("pos", "key"))
    firsts = keys.groupBy("conv", "key").agg(F.min(F.struct("chunk", "pos")).alias("f"))
    firsts = firsts.groupBy(F.col("f.chunk").alias("chunk")).agg(F.collect_list("f.pos").alias("firsts"))  # at most a chunk's rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes, counts = [], []
            for marks, first in zip(b.column("marks"), b.column("firsts"), strict=True):
                marks = np.frombuffer(marks.as_buffer(), np.uint8)
                seen = np.ones(len(marks), bool)
                seen[np.array(first.as_py() or [], np.int64)] = False
                code, *faults = _codes(marks, seen)
                codes.append(code.astype(np.uint8).tobytes())
                counts.append([int(x.sum()) for x in faults])
            yield pa.RecordBatch.from_arrays([b.column("chunk"), pa.array(codes, pa.binary()), *[pa.array([c[k] for c in counts], pa.int64()) for k in range(3)]], ["chunk", "codes", "blank", "duplicate", "truncated"])

    return opens.select("chunk", "marks").join(firsts, "chunk", "left").select("chunk", "marks", "firsts").mapInArrow(run, "chunk long, codes binary, blank long, duplicate long, truncated long")


def _pass(rows: DataFrame) -> DataFrame:
    """chunk, end and start vectors of chunks, rerun from `end`; with old_end and old_start, only as far as they are not parallel to the pass before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes, lengths = _flat(b, "codes", "u1")
            ends = _vec(b, "end")
            before = (_vec(b, "old_end"), _vec(b, "old_start")) if "old_end" in b.schema.names else None
            yield pa.RecordBatch.from_arrays([b.column("chunk"), _four(ends), _four(start_vectors(codes, lengths, ends, before))], ["chunk", "end", "start"])

    return rows.mapInArrow(run, "chunk long, end array<long>, start array<long>")


def _scaled(v: Column) -> Column:
    """A vector less its least value: what vectors that differ by a constant share."""
    return F.transform(v, lambda x: x - F.array_min(v))


def _exact_ends(chunks: DataFrame, light: DataFrame) -> DataFrame:
    """chunk and its exact end vector, by composing the chunks' transfer matrices from a conversation's last one on. A task holds a conversation's matrices, 16 numbers for up to CHUNK_ROWS of its rows."""

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes, lengths = _flat(b, "codes", "u1")
            columns = [start_vectors(codes, lengths, np.tile(np.where(np.arange(4) == k, 0, FAR), (len(lengths), 1))) for k in range(4)]
            m = np.minimum(np.stack(columns, 2), FAR).reshape(-1, 16)
            yield pa.RecordBatch.from_arrays([b.column("conv"), b.column("chunk"), pa.ListArray.from_arrays(pa.array(np.arange(0, m.size + 1, 16), pa.int32()), pa.array(m.ravel()))], ["conv", "chunk", "m"])

    conv = chunks.schema["conv"].dataType
    made = chunks.join(light, "chunk").select("conv", "chunk", "codes").mapInArrow(matrices, _schema(conv, "m array<long>"))

    def fold(table: pa.Table) -> pa.Table:
        table = table.sort_by("chunk")
        m = table.column("m").combine_chunks().flatten().to_numpy().reshape(-1, 4, 4)
        ends = np.empty((len(m), 4), np.int64)
        v = AT_END
        for k in range(len(m) - 1, -1, -1):
            ends[k] = v - v.min()
            v = (m[k] + ends[k][None, :]).min(1)
        return pa.table({"chunk": table.column("chunk"), "end": _four(ends)})

    return made.groupBy("conv").applyInArrow(fold, "chunk long, end array<long>")


def stitched(chunks: DataFrame, light: DataFrame, most_passes: int = MOST_PASSES) -> DataFrame:
    """chunk, end and start of each chunk: exact cost vectors, end less its least value.

    chunks: conv and chunk, whose order is the rows'. The first pass takes zeros
    as the end of all but a conversation's last chunk. The fix-up passes rerun
    the chunks whose successor's vector has changed by more than a constant.
    Those that still change after most_passes, as runs of one role over many
    chunks can, get theirs by composed matrices.
    """
    # ids alone: two numbers for up to CHUNK_ROWS rows
    links = stored(chunks.select("chunk", F.lead("chunk").over(Window.partitionBy("conv").orderBy("chunk")).alias("next")), "links")
    four = lambda v: F.array(*[F.lit(int(x)).cast("long") for x in v])
    guess = light.join(links, "chunk").select("chunk", "codes", F.when(F.col("next").isNull(), four(AT_END)).otherwise(four([0] * 4)).alias("end"))
    known = stored(_pass(guess), "pass")
    for k in range(most_passes + 1):
        successor = known.select(F.col("chunk").alias("next"), _scaled(F.col("start")).alias("new_end"))
        changed = links.join(successor, "next").join(known, "chunk").filter(F.col("new_end") != F.col("end")).select("chunk", F.col("end").alias("old_end"), F.col("start").alias("old_start"), F.col("new_end").alias("end"))
        changed = stored(changed, "changed")
        if changed.isEmpty():
            return known
        if k == most_passes:
            some = chunks.join(chunks.join(changed, "chunk", "left_semi").select(F.col("conv").alias("_conv")).distinct(), F.col("conv").eqNullSafe(F.col("_conv")), "left_semi")
            again = light.join(stored(_exact_ends(some, light), "exact"), "chunk").select("chunk", "codes", "end")
        else:
            again = light.join(changed, "chunk").select("chunk", "codes", "end", "old_end", "old_start")
        again = stored(_pass(again), "pass")
        known = stored(known.join(again, "chunk", "left_anti").unionByName(again), "known")
    return known


def _start_states(chunks: DataFrame, light: DataFrame, known: DataFrame) -> DataFrame:
    """chunk, state (before its first row) and is_last. Each chunk is traced from all four states; the ends so found are followed through a conversation's chunks, four small numbers each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes, lengths = _flat(b, "codes", "u1")
            vectors = cost_vectors(codes, lengths, _vec(b, "end"))
            to = [traced(vectors, codes, lengths, np.full(len(lengths), q))[1] for q in range(4)]
            yield pa.RecordBatch.from_arrays([b.column("conv"), b.column("chunk"), _four(np.stack(to, 1))], ["conv", "chunk", "to"])

    rows = chunks.join(light, "chunk").join(known, "chunk").select("conv", "chunk", "codes", "end")
    ends = rows.mapInArrow(run, _schema(chunks.schema["conv"].dataType, "to array<long>"))
    per = ends.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("chunk", "to"))).alias("c"))
    start = F.struct(F.lit(START).cast("long").alias("q"), F.array().cast("array<bigint>").alias("before"))
    walked = F.aggregate("c", start, lambda a, x: F.struct(F.get(x["to"], a["q"].cast("int")).alias("q"), F.concat(a["before"], F.array(a["q"])).alias("before")))["before"]
    each = per.select(F.posexplode(F.arrays_zip(F.col("c.chunk").alias("chunk"), walked.alias("state"))).alias("pos", "z"), F.size("c").alias("n"))
    return each.select("z.chunk", "z.state", (F.col("pos") == F.col("n") - 1).alias("is_last"))


def _traced_chunks(opens: DataFrame) -> DataFrame:
    """Open chunks, with codes, end, state and is_last, to their part of the audit and of the repaired lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes, lengths = _flat(b, "codes", "u1")
            vectors = cost_vectors(codes, lengths, _vec(b, "end"))
            edits, state = traced(vectors, codes, lengths, b.column("state").to_numpy().astype(np.int64))
            ends = np.where(b.column("is_last").to_numpy(zero_copy_only=False), end_edits(state), 4)
            audit, lines = rendered(edits, lengths, b.column("roles").flatten(), b.column("texts").flatten(), ends)
            yield pa.RecordBatch.from_arrays([b.column("conv"), b.column("chunk"), audit, lines], ["conv", "chunk", "audit", "lines"])

    rows = opens.select("conv", "chunk", "roles", "texts", "codes", "end", "state", "is_last")
    return rows.mapInArrow(frugal(run), _schema(opens.schema["conv"].dataType, "audit string, lines array<string>"))


def _joined(parts: DataFrame) -> DataFrame:
    """One row a conversation from its chunks, read in order as a stream: a chunk at a time is held, and the audit."""
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None

        def result() -> pa.RecordBatch:
            turns = state["last"] - state["first"] + 1 - state["turns"] if state["first"] is not None else 0
            done = [turns, *[state[c] for c in numbers[1:]], "".join(state["audit"]), state["sha"].hexdigest()]
            return pa.RecordBatch.from_arrays([pa.array([state["conv"]], kind), *[pa.array([x]) for x in done]], ["conv", *numbers, "audit", "repaired_sha256"])

        for b in batches:
            kind = b.schema.field("conv").type
            for i in range(b.num_rows):
                x = b.slice(i, 1).to_pylist()[0]
                if state is None or x["conv"] != state["conv"]:
                    if state is not None:
                        yield result()
                    # the true vector is this one and the least values of those behind it
                    state = {"conv": x["conv"], "first": None, "last": None, "initial": None, "empty": True, "audit": [], "sha": hashlib.sha256(), **dict.fromkeys(["turns", *numbers], 0)}
                    state["cost"] = x["start"][START] - min(x["start"])
                for c in ("blank", "duplicate", "truncated", "illegal", "turns"):
                    state[c] += x[c]
                state["cost"] += min(x["start"])
                if x["first_turn"] is not None:
                    state["turns"] -= state["last"] == x["first_turn"]
                    state["first"] = x["first_turn"] if state["first"] is None else state["first"]
                    state["last"] = x["last_turn"]
                if x["marks"]:
                    if state["initial"] is not None:
                        state["illegal"] += not LEGAL[state["initial"], x["marks"][0] & 3]
                    state["initial"] = x["marks"][-1] & 3
                state["audit"].append(x["audit"])
                for line in x["lines"]:
                    state["sha"].update(b"" if state["empty"] else b"\n")
                    state["sha"].update(line.encode())
                    state["empty"] = False
        if state is not None:
            yield result()

    kind = parts.schema["conv"].dataType
    out = T.StructType([T.StructField("conv", kind), *T.StructType.fromDDL(_RESULT).fields])
    return parts.repartition("conv").sortWithinPartitions("conv", "chunk").mapInArrow(frugal(run), out)


def _solved(turns: DataFrame, keep_lines: bool, chunk_rows: int, chunk_bytes: int, most_passes: int) -> tuple[DataFrame, DataFrame]:
    """Solved chunks, and the parts of open ones: conv, chunk, audit and lines with counts and start vectors."""
    conv = turns.schema["conv"].dataType
    arrow = pa.string() if isinstance(conv, T.StringType) else pa.int64() if isinstance(conv, T.LongType) else pa.int32()
    if not isinstance(conv, (T.StringType, T.LongType, T.IntegerType)):
        raise TypeError(f"conversations are named by strings or integers, not by {conv.simpleString()}")
    run = _chunks(arrow, keep_lines, chunk_rows, chunk_bytes)
    cut = stored(_ordered(turns).mapInArrow(frugal(run), _schema(conv, f"open boolean, {_RESULT}, {_PAYLOAD}")), "chunks")
    opens = cut.filter("open").drop("blank", "duplicate", "truncated", "audit", "lines")
    chunks = opens.select("conv", "chunk")
    light = stored(_light(opens), "light")
    known = stitched(chunks, light, most_passes)
    states = stored(_start_states(chunks, light, known), "states")
    ready = opens.join(light, "chunk").join(known, "chunk").join(states, "chunk")
    parts = _traced_chunks(ready)
    if keep_lines:
        return cut.filter("not open"), parts
    parts = stored(parts, "parts")
    counts = opens.select("chunk", "illegal", "marks", "first_turn", "last_turn", "turns").join(light.drop("codes"), "chunk").join(known.select("chunk", "start"), "chunk")
    return cut.filter("not open"), parts.join(counts, "chunk")


def repair(turns: DataFrame, chunk_rows: int = CHUNK_ROWS, chunk_bytes: int = CHUNK_BYTES, most_passes: int = MOST_PASSES) -> DataFrame:
    """conv, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 of each conversation of turns (see as_turns() and damaged()).

    Rows stand by turn, nulls first, those of one turn by the MD5 of role and
    text. A null conv is a conversation of its own. One whose rows are all
    dropped has zeros, an empty audit and the digest of nothing. Repeated rows
    are duplicates. A turn may be of any length; an empty table gives none.
    """
    closed, parts = _solved(turns, False, chunk_rows, chunk_bytes, most_passes)
    done = closed.select("conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    return done.unionByName(_joined(parts))


def repaired_lines(turns: DataFrame, chunk_rows: int = CHUNK_ROWS, chunk_bytes: int = CHUNK_BYTES, most_passes: int = MOST_PASSES) -> DataFrame:
    """conv, chunk, place and line: the repaired conversations, a `role:text` a row, in order of chunk and place. Two insertions in a row come as one line with a break."""
    closed, parts = _solved(turns, True, chunk_rows, chunk_bytes, most_passes)
    return closed.select("conv", "chunk", "lines").unionByName(parts.select("conv", "chunk", "lines")).select("conv", "chunk", F.posexplode("lines").alias("place", "line"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, damaged and repaired."""
    return repair(damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet"))).withColumnRenamed("conv", "conv_id")


#: The search as recursion over rows: costs to the end by state (nothing, system, user, assistant), then one edit a step.
OP12_SQL = r"""
WITH RECURSIVE k(i, v, step) AS (
  SELECT i, i, 0 FROM range(256) t(i)
  UNION ALL
  SELECT i, CASE WHEN v % 2 = 1 THEN xor(3988292384, v // 2) ELSE v // 2 END, step + 1 FROM k WHERE step < 8),
bytes AS (SELECT list(v ORDER BY i) AS t FROM k WHERE step = 8),
named AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations),
hashed AS (
  SELECT conv_id, turn, role, text,
         xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(name)), '..'), lambda x: ('0x' || x)::BIGINT)),
                                     lambda a, b: xor(a // 256, t[(xor(a, b) & 255) + 1]))) % 20 AS h
  FROM named, bytes),
damaged AS (
  SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
         CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN h = 3 THEN [1, 2] ELSE [1] END)
  FROM hashed WHERE h <> 0),
numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(role) || ':' || role || text)) AS i FROM damaged),
ordered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
         NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') AS cut
  FROM numbered),
faults AS (
  SELECT conv_id, i, turn, role, text, blank, again AND NOT blank AS duplicate, cut AND NOT blank AND NOT again AS truncated, blank OR again AS gone,
         CASE left(role, 1) WHEN 's' THEN 's' WHEN 'u' THEN 'u' WHEN 'a' THEN 'a' ELSE '-' END AS c, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS pair
  FROM ordered),
counts AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(blank) AS blank, count_if(duplicate) AS duplicate,
         count_if(truncated) AS truncated, count_if(pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM faults GROUP BY conv_id),
costs AS (
  SELECT conv_id, n + 1 AS i, [0, 10, 5, 0]::BIGINT[] AS b FROM counts
  UNION ALL
  SELECT conv_id, i, [least(x[1], 5 + x[3], 10 + x[4]), least(x[2], 5 + x[3], 10 + x[4]), least(x[3], 5 + x[4]), least(x[4], 5 + x[3])]
  FROM (
    SELECT f.conv_id, f.i, CASE WHEN gone THEN [2 + b[1], 2 + b[2], 2 + b[3], 2 + b[4]] ELSE
      [least(2 + b[1], 1 + p + b[3], CASE c WHEN 's' THEN p + b[2] WHEN 'u' THEN p + b[3] ELSE 1 + p + b[3] END), least(2 + b[2], 1 + p + b[3], CASE c WHEN 'u' THEN p + b[3] ELSE 1 + p + b[3] END),
       least(2 + b[3], 1 + p + b[4], CASE c WHEN 'a' THEN p + b[4] ELSE 1 + p + b[4] END), least(2 + b[4], 1 + p + b[3], CASE c WHEN 'u' THEN p + b[3] ELSE 1 + p + b[3] END)] END AS x
    FROM (SELECT *, CASE WHEN truncated THEN 5 ELSE 0 END AS p FROM faults) f JOIN costs ON f.conv_id IS NOT DISTINCT FROM costs.conv_id AND f.i = costs.i - 1)),
steps AS (
  SELECT a.conv_id, a.i, a.b AS here, z.b AS after, f.role, f.text, f.c, f.gone, CASE WHEN f.truncated THEN 5 ELSE 0 END AS p
  FROM costs a LEFT JOIN costs z ON a.conv_id IS NOT DISTINCT FROM z.conv_id AND z.i = a.i + 1 LEFT JOIN faults f ON a.conv_id IS NOT DISTINCT FROM f.conv_id AND f.i = a.i),
walk AS (
  SELECT conv_id, 1::BIGINT AS i, 1 AS q, '' AS audit, []::VARCHAR[] AS lines FROM counts
  UNION ALL
  SELECT conv_id, CASE WHEN e = 'I' THEN i ELSE i + 1 END, CASE WHEN e = 'D' THEN q WHEN e = 'K' AND c = 's' THEN 2 WHEN q = 3 THEN 4 ELSE 3 END, audit || e,
         CASE e WHEN 'D' THEN lines WHEN 'K' THEN list_append(lines, role || ':' || text) ELSE list_append(lines, CASE WHEN q = 3 THEN 'assistant:' ELSE 'user:' END || CASE WHEN e = 'R' THEN text ELSE '' END) END
  FROM (
    SELECT w.*, s.role, s.text, s.c,
           CASE WHEN here[q] = 2 + after[q] THEN 'D'
                WHEN here[q] = 5 + here[CASE WHEN q = 3 THEN 4 ELSE 3 END] THEN 'I'
                WHEN after IS NULL THEN NULL
                WHEN c = 's' AND q = 1 AND here[q] = p + after[2] OR c = 'u' AND q <> 3 AND here[q] = p + after[3] OR c = 'a' AND q = 3 AND here[q] = p + after[4] THEN 'K' ELSE 'R' END AS e
    FROM walk w JOIN steps s ON w.conv_id IS NOT DISTINCT FROM s.conv_id AND w.i = s.i)
  WHERE e IS NOT NULL),
done AS (SELECT conv_id, arg_max(audit, length(audit)) AS audit, arg_max(lines, length(audit)) AS lines FROM walk GROUP BY conv_id)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(costs.b[1], 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counts ON o.conv_id IS NOT DISTINCT FROM counts.conv_id
LEFT JOIN costs ON o.conv_id IS NOT DISTINCT FROM costs.conv_id AND costs.i = 1
LEFT JOIN done ON o.conv_id IS NOT DISTINCT FROM done.conv_id"""
