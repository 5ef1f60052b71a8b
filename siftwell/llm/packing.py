"""Best-fit packing of token pieces into sequences of a fixed size.

Hierarchical residual packing: groups of items are packed by best fit on their
own; bins that are nearly full leave; the underfull bins of several groups meet
as items of the next, smaller round, until a round no longer helps. The number
of groups of a round follows the number of its items, so no task holds more
than about GROUP_ITEMS of them whatever the input.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.llm.common import frugal, slices, stored
from siftwell.llm.tokens import BATCH_BYTES, crc32, encoder, tokenizer_path

CAPACITY = 4096
#: A bin with at most this much room left leaves at once.
SLACK = 8
#: Items of a group, on average.
GROUP_ITEMS = 4000
#: Rounds go on while a round saves at least this share of its bins.
LEAST_GAIN = 0.01


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Best fit of sizes, largest first (ties in their order): the bin and the place in it of each item."""
    order = np.argsort(-sizes, kind="stable")
    bins, places = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    with_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, n = 0, 0  # bit r of rooms: some bin has r left
    for i, size in zip(order.tolist(), sizes[order].tolist(), strict=True):
        fits = rooms >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            b = with_room[room].pop()
            if not with_room[room]:
                rooms ^= 1 << room
        else:
            room, b, n = capacity, n, n + 1
        bins[i], places[i] = b, capacity - room
        left = room - size
        if left:
            with_room[left].append(b)
            rooms |= 1 << left
    return bins, places


def token_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of the pieces of each document's ids (null text: empty, which is the end id alone)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in slices(batches, "text", BATCH_BYTES):
            offsets, ids = enc.encode(b.column("text"))
            n = np.diff(offsets)
            pieces = -(-n // capacity)
            doc = np.repeat(np.arange(len(n)), pieces)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start = piece * capacity
            length = np.minimum(capacity, n[doc] - start)
            at = offsets[doc] + start
            crc = [crc32(ids[i:j]) for i, j in zip(at, at + length, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(frugal(run), "doc_id long, piece int, start long, length long, ids_crc32 long")


_PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, bin long, offset long, fill long"


def _pack_round(items: DataFrame, groups: int, level: int, capacity: int) -> DataFrame:
    """Best fit of the bins within each of so many groups. A bin's rows share `bin`; its group comes from that number, so all of them meet."""
    base = level << 58

    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["bin", "offset", "doc_id", "piece", "ids_crc32"], kind="stable").reset_index(drop=True)
        heads = np.flatnonzero(np.r_[True, np.diff(pdf["bin"].to_numpy()) != 0])
        fill = np.add.reduceat(pdf["length"].to_numpy(), heads)
        at = np.repeat(np.arange(len(heads)), np.diff(np.r_[heads, len(pdf)]))
        bins, places = best_fit(fill, capacity)
        total = np.bincount(bins, fill).astype(np.int64)
        # 26 bits for the group, 32 for the bin in it
        return pdf.assign(bin=(base | (int(key[0]) << 32)) + bins[at], offset=pdf["offset"].to_numpy() + places[at], fill=total[bins[at]])

    grouped = items.withColumn("grp", F.pmod(F.xxhash64("bin", F.lit(level)), F.lit(groups)).cast("int"))
    return grouped.groupBy("grp").applyInPandas(lambda key, pdf: pack(key, pdf.drop(columns="grp")), _PACKED)


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, slack: int = SLACK, group_items: int = GROUP_ITEMS) -> DataFrame:
    """pieces (doc_id, piece, start, length up to capacity, ids_crc32) with sequence_id and offset, gapless from 0 in each sequence.

    Pieces of full length are sequences of their own. Equal rows are packed
    each by itself. Ties fall by doc_id and piece, so reruns agree. No rows
    give no rows.
    """
    # every row starts as a bin of one item; the stored numbers stay as they are through retries
    numbered = pieces.withColumn("bin", F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long")).withColumn("fill", F.col("length"))
    rows = stored(numbered, "pieces")
    full, level = [rows.filter(F.col("length") >= capacity)], 1
    items = rows.filter(F.col("length") < capacity)
    bins = items.count()
    while bins:
        groups = max(1, -(-bins // group_items))
        packed = stored(_pack_round(items, groups, level, capacity), f"packed{level}")
        closed = F.col("fill") >= capacity - slack
        counts = packed.groupBy(closed.alias("closed")).agg(F.countDistinct("bin").alias("n")).collect()
        n = {r["closed"]: r["n"] for r in counts}
        before, bins = bins, n.get(False, 0)
        if groups == 1 or bins == 0 or sum(n.values()) > (1 - LEAST_GAIN) * before and level > 1:
            full.append(packed)
            break
        full.append(packed.filter(closed))
        items, level = packed.filter(~closed), level + 1
    out = full[0]
    for f in full[1:]:
        out = out.unionByName(f)
    return out.withColumnRenamed("bin", "sequence_id").drop("fill")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' tokens in sequences of at most 4096."""
    return pack_pieces(token_pieces(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path()))
