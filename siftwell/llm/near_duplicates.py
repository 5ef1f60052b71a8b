"""Near-duplicate documents by a multi-index Hamming join of b-bit MinHash signatures.

A document's set is that of its shingles of some words (64-bit hashes of
lower-cased words). Documents whose sets have the same 128-bit digest form a
class; classes are what is joined.

A signature has 32 positions of 16 bits. It is cut into 8 chunks of 4 positions,
and each chunk is indexed with one error allowed, by its 4 choices of 3
positions. Two signatures that differ in at most 15 positions have a chunk with
at most one error (8 chunks of 2 errors make 16), so they share a key: all such
pairs meet. Sets of Jaccard similarity 0.8 differ in 6.4 positions on average;
that no chunk of theirs has at most one error happens once in a million pairs.

Members of a key are first linked to one of them alone, that which shares most
keys with most classes, and links are confirmed on full sets. Keys whose members are then one component are done.
In the others, members outside the largest component meet those of other
components that have one of their rarest shingles, which similar sets must. So
no key gives all its pairs, and none that could join two components is left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftwell.llm.common import BROADCAST_ROWS, Scratch, frugal, gathered, join_unique, slices, small_batches
from siftwell.llm.words import coded_words, ragged

SHINGLE = 4
LEAST_PERCENT = 80
POSITIONS, CHUNK = 32, 4
#: Pairs whose signatures differ in more positions are not confirmed, which saves reading their sets; sets of similarity 0.8 do so once in 10^12 pairs.
MOST_DISTANCE = 24
#: Bytes of text whose sets are made at a time; of shingle numbers it takes some ten times as many.
BATCH_BYTES = 2 << 20
#: A shingle in more sets than this is looked up by blocks of sets, not by pairs; and the sets of a block.
CROWD = 48
PROBE_BLOCK, OTHER_BLOCK = 256, 512

#: Bytes of a row at most, for how many files a table takes: of numbers alone, and of those with a signature or digest.
SHORT_ROW, SIGNED_ROW = 48, 160

_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every bit over the word."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Offsets of each text's set, and the distinct shingle hashes of all, ascending within a text. Texts of fewer words have their whole sequence, texts of none nothing."""
    import xxhash

    offsets, codes, words = coded_words(pc.ascii_lower(pc.fill_null(texts, "")))
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words))[codes]
    n = np.diff(offsets)
    count = np.where(n >= size, n - size + 1, (n > 0).astype(np.int64))
    at = ragged(offsets[:-1], count)
    length = np.repeat(np.minimum(n, size), count)
    padded = np.concatenate([hashes, np.zeros(size, np.uint64)])
    mixed = length.astype(np.uint64) * _MIX[-1]
    for k in range(size):
        mixed = _mixed(mixed + np.where(length > k, padded[at + k], np.uint64(0)) * _MIX[k % len(_MIX)])
    ends = np.concatenate([[0], np.cumsum(count)])
    sets = [np.unique(mixed[i:j]) for i, j in zip(ends[:-1], ends[1:], strict=True)]
    return np.concatenate([[0], np.cumsum([len(s) for s in sets], dtype=np.int64)]), np.concatenate(sets) if sets else mixed


def signatures(offsets: np.ndarray, hashes: np.ndarray, positions: int = POSITIONS) -> np.ndarray:
    """The low 16 bits of each position's least hash: texts x positions. Texts without shingles have zeros."""
    out = np.zeros((len(offsets) - 1, positions), np.uint16)
    full = np.flatnonzero(np.diff(offsets))
    if len(full):
        factors = np.random.default_rng(17).integers(0, 1 << 63, (positions, 2), dtype=np.uint64) | np.uint64(1)
        for k, (a, b) in enumerate(factors):
            values = ((hashes * a + b) >> np.uint64(32)).astype(np.uint32)
            out[full, k] = np.minimum.reduceat(values, offsets[:-1][full]).astype(np.uint16)
    return out


def chunk_keys(sig: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
    """Keys of each signature: every chunk without one of its positions, the chunk's and the position's number mixed in. rows x positions."""
    rows, positions = sig.shape
    out = np.empty((rows, positions), np.uint64)
    wide = sig.astype(np.uint64)
    for p in range(positions):
        c = p // chunk
        others = [q for q in range(c * chunk, (c + 1) * chunk) if q != p]
        key = np.full(rows, p + 1, np.uint64) * _MIX[5]
        for q in others:
            key = _mixed(key + (wide[:, q] + np.uint64(1)) * _MIX[q % 5])
        out[:, p] = key
    return out.view(np.int64)


def _binary(flat: np.ndarray, width: int) -> pa.Array:
    """Rows of fixed width as binary values."""
    rows = flat.reshape(-1, width).view(np.uint8) if flat.size else np.zeros((0, 1), np.uint8)
    n = len(rows)
    ends = pa.py_buffer((np.arange(n + 1) * rows.shape[1]).astype(np.int32).tobytes())
    return pa.Array.from_buffers(pa.binary(), n, [None, ends, pa.py_buffer(np.ascontiguousarray(rows).tobytes())])


def _digests_of(offsets: np.ndarray, hashes: np.ndarray) -> pa.Array:
    """128 bits of a digest of each set."""
    data = hashes.astype("<u8")
    return pa.array([hashlib.blake2b(data[i:j], digest_size=16).digest() for i, j in zip(offsets[:-1], offsets[1:], strict=True)], pa.binary())


def _read(docs: DataFrame, text: str) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))


def signed_documents(docs: DataFrame, text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, digest (of the set) and sig (32 times 16 bits) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", BATCH_BYTES):
            offsets, hashes = shingle_sets(b.column("text"), shingle)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.diff(offsets)), _digests_of(offsets, hashes), _binary(signatures(offsets, hashes), POSITIONS)], ["doc_id", "n_shingles", "digest", "sig"])

    return _read(docs, text).mapInArrow(frugal(run), "doc_id long, n_shingles long, digest binary, sig binary")


def _sig_matrix(column: pa.Array) -> np.ndarray:
    whole = b"".join(column.to_pylist())
    return np.frombuffer(whole, np.uint16).reshape(-1, POSITIONS)


def memberships(classes: DataFrame) -> DataFrame:
    """key and cls: a row for each key of each class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                keys = chunk_keys(_sig_matrix(b.column("sig")))
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), b.column("cls").take(pa.array(np.repeat(np.arange(b.num_rows), POSITIONS)))], ["key", "cls"])

    return classes.select("cls", "sig").mapInArrow(frugal(run), "key long, cls long")


def _near_pairs(pairs: DataFrame, classes: DataFrame, total: int, percent: int) -> DataFrame:
    """The pairs a, b whose signatures differ in at most MOST_DISTANCE positions and whose set sizes allow the similarity."""
    degree = pairs.groupBy("a").agg(F.count("*").alias("deg"))
    left = classes.select(F.col("cls").alias("a"), F.col("sig").alias("sig_a"), F.col("n_shingles").alias("n_a")).join(degree, "a")
    with_a = join_unique(pairs, left, "a", "deg", total, how="inner", whole=True)
    right = classes.select(F.col("cls").alias("b"), F.col("sig").alias("sig_b"), F.col("n_shingles").alias("n_b"))
    both = with_a.drop("deg").join(right, "b").filter((F.col("n_a") * 100 >= F.col("n_b") * percent) & (F.col("n_b") * 100 >= F.col("n_a") * percent))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                near = (_sig_matrix(b.column("sig_a")) != _sig_matrix(b.column("sig_b"))).sum(1) <= MOST_DISTANCE
                yield b.select(["a", "b"]).filter(pa.array(near))

    return gathered(both.select("a", "b", "sig_a", "sig_b"), total * SIGNED_ROW).mapInArrow(frugal(run), "a long, b long")


def _sets(docs: DataFrame, needed: DataFrame, text: str, shingle: int) -> DataFrame:
    """cls and its whole set (ascending 64-bit hashes) for the needed classes (doc_id, cls, digest), from their documents' texts."""
    ids = needed.select("doc_id").filter("doc_id is not null").distinct()
    rows = _read(docs, text)
    found = rows.join(F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids, "doc_id", "left_semi")
    if not needed.filter("doc_id is null").isEmpty():  # the set of a class without any id is looked for among all rows without one
        found = found.unionByName(rows.filter("doc_id is null"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", BATCH_BYTES):
            offsets, hashes = shingle_sets(b.column("text"), shingle)
            data = hashes.astype("<u8")
            sets = [data[i:j].tobytes() for i, j in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([_digests_of(offsets, hashes), pa.array(sets, pa.binary())], ["digest", "hashes"])

    made = found.mapInArrow(frugal(run), "digest binary, hashes binary")
    # rows that repeat, or share the id with another text, are sorted out by their digest
    return made.join(needed.select("digest", "cls"), "digest").groupBy("cls").agg(F.first("hashes").alias("hashes"))


def confirmed(pairs: DataFrame, docs: DataFrame, classes: DataFrame, total: int, percent: int, text: str, shingle: int, n_hashes: int, shelf: Scratch) -> DataFrame:
    """The pairs whose full sets have an intersection of at least `percent` of their union."""
    ends = pairs.select(F.col("a").alias("cls")).unionAll(pairs.select(F.col("b").alias("cls"))).distinct()
    needed = shelf.stored(classes.join(ends, "cls").select(F.col("rep").alias("doc_id"), "cls", "digest"), "needed", total * SIGNED_ROW)
    sets = shelf.stored(_sets(docs, needed, text, shingle), "sets", 8 * n_hashes)
    degree = pairs.groupBy("a").agg(F.count("*").alias("deg"))
    # few keys may be broadcast here: a set is as long as its text
    with_a = join_unique(pairs, sets.select(F.col("cls").alias("a"), F.col("hashes").alias("set_a")).join(degree, "a"), "a", "deg", total, how="inner", parts=64)
    both = with_a.drop("deg").join(sets.select(F.col("cls").alias("b"), F.col("hashes").alias("set_b")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = []
            for x, y in zip(b.column("set_a"), b.column("set_b"), strict=True):
                p, q = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
                common = len(p) + len(q) - len(np.union1d(p, q))
                good.append(100 * common >= percent * (len(p) + len(q) - common))
            yield b.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return both.select("a", "b", "set_a", "set_b").mapInArrow(frugal(run), "a long, b long")


def components(links: DataFrame, most: int, shelf: Scratch) -> DataFrame:
    """cls and comp, the smallest class reachable, of every class that has one of the at most `most` links (a, b).

    Alternates two steps until each class has one link to a class that has none
    to a smaller one: neighbours of a class, first the larger and then the
    smaller ones, are linked to its smallest neighbour instead. Degrees may be any; a hub's links are never gathered in one task.
    """
    own = Scratch(links.sparkSession)
    edges = own.stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "links", most * SHORT_ROW)
    total = edges.count()

    def star(pairs: DataFrame, total: int) -> DataFrame:
        least = pairs.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("deg")).withColumn("m", F.least("u", "m"))
        return join_unique(pairs, least, "u", "deg", total, how="inner", whole=True)

    # links of a class to smaller ones, and all; in the end it has one link to a smaller one, or links to larger ones alone
    ends = F.explode(F.array(F.struct(F.col("u").alias("cls"), F.lit(1).alias("down")), F.struct(F.col("v").alias("cls"), F.lit(0).alias("down"))))
    while total:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = star(both, 2 * total).filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = own.stored(large.filter("u <> v").distinct(), "large-star", total * SHORT_ROW)
        small = star(large, total).select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e")).select(F.col("e.v").alias("u"), F.col("e.m").alias("v"))
        edges = own.stored(small.filter("u <> v").distinct(), "small-star", 2 * total * SHORT_ROW)
        own.drop(edges)
        per = edges.select(ends.alias("e")).select("e.*").groupBy("cls").agg(F.sum("down").alias("down"), F.count("*").alias("deg"))
        open_, degrees = per.agg(F.count_if((F.col("down") > 0) & (F.col("deg") > 1)), F.coalesce(F.sum("deg"), F.lit(0))).first()
        total = degrees // 2
        if not open_:
            break
    found = edges.select(F.col("u").alias("cls"), F.col("v").alias("comp")).unionAll(edges.select(F.col("v").alias("cls"), F.col("v").alias("comp")).distinct())
    found = shelf.stored(found, "labels", 2 * total * SHORT_ROW)
    own.drop()
    return found


def _shingles(sets: DataFrame) -> DataFrame:
    """shingle, cls and probe: a row for each shingle of each set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [np.frombuffer(x, "<i8") for x in b.column("hashes").to_pylist()]
            if found:
                at = pa.array(np.repeat(np.arange(len(found)), [len(x) for x in found]))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found)), b.column("cls").take(at), b.column("probe").take(at)], ["shingle", "cls", "probe"])

    return sets.select("hashes", "cls", "probe").mapInArrow(frugal(run), "shingle long, cls long, probe boolean")


def _remaining_pairs(members: DataFrame, labels: DataFrame, classes: DataFrame, tested: DataFrame, docs: DataFrame, percent: int, text: str, shingle: int, n_classes: int, n_hashes: int, shelf: Scratch) -> tuple[DataFrame, DataFrame]:
    """Pairs a < b of different components, both of open keys, that were not tested and may be similar enough; and links already confirmed.

    A key is open if its members are more than one component. Members outside
    its largest component are probes. Of two sets with n and m shingles and the
    similarity, c = percent * (n + m) / (100 + percent) are common, so one of
    the first n - c + 1 shingles of a probe, rarest first, stands in the other
    set. That is exact, and the rarest shingles of an edited copy or of a
    passage's bearer are its own, so hardly any pair is left. Where the shingle
    stands in many sets, these are compared in blocks instead.
    """
    sizes = classes.select("cls", F.col("n_shingles").alias("size"))
    placed = shelf.stored(members.join(sizes, "cls").join(labels, "cls", "left").withColumn("comp", F.coalesce("comp", "cls")), "placed", n_classes * POSITIONS * SHORT_ROW)
    per = placed.groupBy("key", "comp").agg(F.count("*").alias("n"))
    keys = per.groupBy("key").agg(F.sum("n").alias("n"), F.max(F.struct("n", "comp")).alias("top"), F.count("*").alias("comps")).filter("comps > 1").select("key", "n", F.col("top.comp").alias("top"))
    rows = join_unique(placed, keys, "key", "n", placed.count(), how="inner")
    chosen = shelf.stored(rows.groupBy("cls").agg(F.first("comp").alias("comp"), F.first("size").alias("size"), F.bool_or(F.col("comp") != F.col("top")).alias("probe")), "open", n_classes * SHORT_ROW)
    total = chosen.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    texts_of = shelf.stored(classes.join(chosen, "cls").select(F.col("rep").alias("doc_id"), "cls", "digest"), "open-documents", n_classes * SIGNED_ROW)
    # few rows, so the classes' columns are joined here and not to each shingle
    sets = shelf.stored(_sets(docs, texts_of, text, shingle).join(chosen, "cls"), "open-sets", 8 * n_hashes)
    shingles = _shingles(sets)

    # shingles of one set alone come first and find nothing
    common = shingles.groupBy("shingle").agg(F.count("*").alias("df"), F.count_if(F.col("probe")).alias("times")).filter("df > 1 and times > 0")
    asked = shingles.filter("probe").select("shingle", "cls")
    counted = join_unique(asked, shelf.stored(common, "common", total * SHORT_ROW), "shingle", "times", total).withColumn("df", F.coalesce("df", F.lit(1)))
    rarest = Window.partitionBy("cls").orderBy("df", "shingle")
    ranked = counted.withColumn("rank", F.row_number().over(rarest)).filter("df > 1").select("shingle", F.col("cls").alias("x"), "rank", "df")
    most = F.expr(f"nx - (({percent} * nx + 99) div 100) + 1")
    first = ranked.join(sets.select(F.col("cls").alias("x"), F.col("comp").alias("cx"), F.col("size").alias("nx")), "x").filter(F.col("rank") <= most)
    first = shelf.stored(first, "prefixes", total * SHORT_ROW)
    # df is how many rows of `shingles` the shingle has
    held = join_unique(shingles.select("shingle", "cls"), first.groupBy("shingle").agg(F.first("df").alias("df")), "shingle", "df", total, how="inner").drop("df")
    others = shelf.stored(held.join(sets.select("cls", F.col("comp").alias("cy"), F.col("size").alias("ny")), "cls").withColumnRenamed("cls", "y"), "holders", total * SHORT_ROW)

    least = F.expr(f"({percent} * (nx + ny) + {99 + percent}) div {100 + percent}")
    fits = (F.col("nx") * 100 >= F.col("ny") * percent) & (F.col("ny") * 100 >= F.col("nx") * percent) & (F.col("rank") <= F.col("nx") - least + 1)
    # a rare shingle has few holders and no more probes
    rare = first.filter(F.col("df") <= CROWD)
    pairs = rare.join(others, "shingle").filter((F.col("cx") != F.col("cy")) & fits).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    return pairs.join(tested, ["a", "b"], "left_anti"), _crowd_links(first.filter(F.col("df") > CROWD), others, sets, percent, total, shelf)


def _crowd_links(probes: DataFrame, others: DataFrame, sets: DataFrame, percent: int, total: int, shelf: Scratch) -> DataFrame:
    """Links a, b between probes and the many other sets that hold a shingle of their prefix, one for each probe and component.

    The sets of a shingle meet in blocks of bounded size, each set moved once a
    block and not once a pair, and are compared there whole.
    """
    # sizes of other sets for which the shingle's rank is within the probe's prefix
    upper = F.expr(f"((nx - rank + 1) * {100 + percent}) div {percent} - nx")
    left = probes.select("shingle", "x", "cx", "df", F.expr(f"({percent} * nx + 99) div 100").alias("lo"), upper.alias("hi"))
    counts = left.groupBy("shingle").agg(F.count("*").alias("n"), F.max("df").alias("df"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    right = join_unique(others, counts.select("shingle", "df", "lo", "hi"), "shingle", "df", total, how="inner").filter(F.col("ny").between(F.col("lo"), F.col("hi"))).select("shingle", "y", "cy")
    blocks = counts.select("shingle", "n").join(right.groupBy("shingle").agg(F.count("*").alias("m")), "shingle")
    blocks = shelf.stored(blocks.select("shingle", "n", "m", F.ceil(F.col("n") / PROBE_BLOCK).alias("nb"), F.ceil(F.col("m") / OTHER_BLOCK).alias("mb")), "blocks", total * SHORT_ROW)
    upto = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    of = lambda c, n: F.pmod(F.xxhash64(c), F.col(n))
    left = join_unique(left.select("shingle", "x", "cx"), blocks, "shingle", "n", total, how="inner")
    right = join_unique(right, blocks, "shingle", "m", total, how="inner")
    left = left.select("shingle", "x", "cx", of("x", "nb").alias("i"), upto("mb").alias("j")).join(sets.select(F.col("cls").alias("x"), F.col("hashes").alias("hx")), "x")
    right = right.select("shingle", "y", "cy", of("y", "mb").alias("j"), upto("nb").alias("i")).join(sets.select(F.col("cls").alias("y"), F.col("hashes").alias("hy")), "y")

    def compare(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int]] = []
        if len(a) and len(b):
            own, other = ([np.frombuffer(x, "<u8") for x in c] for c in (a["hx"], b["hy"]))
            size = np.array([len(x) for x in other])
            start = np.cumsum(size) - size
            known, code = np.unique(np.concatenate(other), return_inverse=True)
            comp, ids = b["cy"].to_numpy(), b["y"].to_numpy()
            for x, cx, s in zip(a["x"].to_numpy(), a["cx"].to_numpy(), own, strict=True):
                at = np.minimum(np.searchsorted(known, s), len(known) - 1)
                mark = np.zeros(len(known), np.int32)
                mark[at[known[at] == s]] = 1
                common = np.add.reduceat(mark[code], start)
                good = np.flatnonzero((100 * common >= percent * (len(s) + size - common)) & (comp != cx))
                out += [(x, ids[good[k]]) for k in np.unique(comp[good], return_index=True)[1]]
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    key = ["shingle", "i", "j"]
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(compare, "a long, b long").distinct()


def _same_ids(full: DataFrame, classes: DataFrame, total: int, shelf: Scratch) -> DataFrame:
    """Links a, b between the classes of rows that share a doc_id."""
    one = F.xxhash64("digest")
    shared = full.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(one).alias("low"), F.max(one).alias("high"), F.count("*").alias("n")).filter("low <> high").select("doc_id", "n")
    several = join_unique(full.select("doc_id", "digest"), shared, "doc_id", "n", total, how="inner", whole=True).select("doc_id", "digest").distinct()
    held = shelf.stored(several.join(classes.select("digest", "cls"), "digest").select("doc_id", "cls"), "several", total * SHORT_ROW)
    first = held.groupBy("doc_id").agg(F.min("cls").alias("a"), F.count("*").alias("n"))
    return join_unique(held, first, "doc_id", "n", total, how="inner", whole=True).filter("cls <> a").select("a", F.col("cls").alias("b"))


def near_duplicates(docs: DataFrame, text: str = "text", percent: int = LEAST_PERCENT, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each row, for sets of shingles of so many words.

    component_id is the smallest doc_id reachable over links, kept whether it is
    the row's own. Texts without words (null: none) are linked with nothing.
    Rows that share a doc_id are one document with the links of all of them;
    rows without a doc_id are linked like others but are never the smallest,
    and are kept if no document with an id is in their component. Other columns
    are left out.
    """
    small_batches(docs.sparkSession)
    shelf = Scratch(docs.sparkSession)
    rows = shelf.stored(signed_documents(docs, text, shingle), "signed")
    full = rows.filter(F.col("n_shingles") > 0)
    n_rows, n_hashes = rows.agg(F.count("*"), F.coalesce(F.sum("n_shingles"), F.lit(0))).first()
    per = full.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("rows"), F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig"))
    # classes are numbered once, as they are stored
    classes = shelf.stored(per.withColumn("cls", F.monotonically_increasing_id()), "classes", n_rows * SIGNED_ROW)
    total = classes.count()

    keys = memberships(classes)
    crowds = keys.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    crowded = shelf.stored(join_unique(keys, crowds.withColumn("m", F.col("n")), "key", "n", total * POSITIONS, how="inner"), "crowded", total * POSITIONS * SHORT_ROW)
    # the original of edited copies shares most keys with most of them
    central = crowded.join(crowded.groupBy("cls").agg(F.sum("m").alias("score")), "cls")
    hubs = central.groupBy("key").agg(F.max(F.struct("score", "cls"))["cls"].alias("hub"), F.count("*").alias("n"))
    members = shelf.stored(join_unique(crowded.select("key", "cls"), hubs, "key", "n", total * POSITIONS, how="inner"), "members", total * POSITIONS * SHORT_ROW)
    star = shelf.stored(members.filter("hub <> cls").select(F.col("hub").alias("a"), F.col("cls").alias("b")).distinct(), "star", total * POSITIONS * SHORT_ROW)
    n_star = star.count()
    near = shelf.stored(_near_pairs(star, classes, n_star, percent), "near")
    links = confirmed(near, docs, classes, n_star, percent, text, shingle, n_hashes, shelf).unionAll(_same_ids(full, classes, n_rows, shelf))
    labels = components(links, n_star + n_rows, shelf)
    shelf.drop(rows, classes, members, star, labels)

    more, extra = _remaining_pairs(members.select("key", "cls"), labels, classes, star, docs, percent, text, shingle, total, n_hashes, shelf)
    more = shelf.stored(more, "more")
    n_more = more.count()
    if n_more:
        near = shelf.stored(_near_pairs(more, classes, n_more, percent), "more-near")
        extra = extra.unionAll(confirmed(near, docs, classes, n_more, percent, text, shingle, n_hashes, shelf))
    # components so far are stars already; of a crowd there are few links
    known = labels.filter("cls <> comp").select(F.col("comp").alias("a"), F.col("cls").alias("b"))
    labels = components(known.unionAll(extra), total + n_more + n_rows, shelf)
    shelf.drop(rows, classes, labels)

    labelled = classes.join(labels, "cls", "left").withColumn("comp", F.coalesce("comp", "cls")).select("digest", "rep", "rows", "comp")
    groups = labelled.groupBy("comp").agg(F.min("rep").alias("component_id"), F.sum("rows").alias("all_rows"), F.count("*").alias("n")).filter("all_rows > 1").select("comp", "component_id", "n")
    grouped = shelf.stored(join_unique(labelled, groups, "comp", "n", total, how="inner", whole=True).select("digest", "rows", "component_id"), "grouped", total * SIGNED_ROW)
    shelf.drop(rows, grouped)
    out = join_unique(rows.select("doc_id", "n_shingles", "digest"), grouped, "digest", "rows", n_rows, whole=True)
    component = F.when(F.col("n_shingles") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every document."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
