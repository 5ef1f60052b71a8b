"""Token ids of whole texts, and their table: sorted parquet with delta-encoded id lists.

The table holds a row per document: doc_id, shard, shard_start, n_tokens, ids.
Files are written by Spark's own parquet writer (format version 2: ids without
a dictionary are DELTA_BINARY_PACKED; row groups and pages of stated size, with
column and offset indexes), in ascending doc_id order within and across files,
so a read of some doc_ids or of the metadata columns alone skips the rest.
"""

from __future__ import annotations

import json
import unicodedata
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwell.llm.common import frugal, join_dimension, new_path, slices, stored
from siftwell.llm.words import ascii_words, ragged

END_ID = 1
#: Frequent words, other than those of LETTERS, whose ids a worker remembers, some 10 MB. A bound on memory, not on results.
REMEMBERED_WORDS = 50_000
#: A word is frequent if a batch has it so many times.
FREQUENT = 4
#: Bytes of text that are encoded at a time.
BATCH_BYTES = 8 << 20
#: Bytes of text of a token file, on average.
FILE_TEXT_BYTES = 12 << 20

_TAIL = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Words of these letters alone are one word to the tokenizer, whose lower-case form is its normal one.
LETTERS = "^[a-zß-öø-ÿÀ-ÖØ-Þ]+$"
#: Words that are encoded as one text, and texts whose encodings, which are larger than their ids, stand in memory at a time.
JOINED, JOINED_TEXTS = 64, 128


def tokenizer_path() -> str:
    """The public vocabulary file that the queries use."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class TextEncoder:
    """Ids of whole texts by a vocabulary whose words never cross white space and that ignores case.

    Each distinct word of a batch is encoded once by the tokenizers library and
    its ids are gathered to where it stands. Added special tokens stand within
    one word too, so a text has the ids that encoding it whole gives. Words of
    letters are encoded many at a time, as a text without normalizing, and told
    apart by the ids that end a word.
    """

    def __init__(self, path: str) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, list[int]] = {}
        self._prepare(Tokenizer.from_file(path))

    def _prepare(self, joined) -> None:
        """The tokenizer of joined words, and the ids that end a word; none if the vocabulary has no such ids or takes words of letters otherwise."""
        from tokenizers import pre_tokenizers as pre

        self.joined, spec = None, json.loads(joined.to_str())
        steps = [x["type"] for part, key in (("normalizer", "normalizers"), ("pre_tokenizer", "pretokenizers")) for x in (spec[part] or {}).get(key, [])]
        suffix = spec["model"].get("end_of_word_suffix")
        if not suffix or steps != ["NFC", "Replace", "Lowercase", "Split", "ByteLevel"] or "|[\\p{L}]+|" not in str(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"].get("Regex")):
            return
        joined.normalizer = None
        joined.pre_tokenizer = pre.Sequence([pre.CharDelimiterSplit(" "), pre.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.joined = joined
        self.is_last = np.array([(joined.id_to_token(i) or "").endswith(suffix) for i in range(joined.get_vocab_size())])

    def _split(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """Two pieces of each word, as places in an array of pieces: a tail of ASCII marks after a letter or number is a word of its own to the tokenizer."""
        core = pc.ascii_rtrim(words, characters=_TAIL)
        size, whole = pc.binary_length(core).to_numpy(zero_copy_only=False), pc.binary_length(words).to_numpy(zero_copy_only=False)
        cut = (size < whole) & (size > 0) & ~pc.match_substring(words, "<|").to_numpy(zero_copy_only=False)
        at = np.flatnonzero(cut & ~pc.match_substring_regex(core, "[0-9A-Za-z]$").to_numpy(zero_copy_only=False))
        for i, x in zip(at.tolist(), core.take(pa.array(at)).to_pylist(), strict=True):
            cut[i] = unicodedata.category(x[-1])[0] in "LN"
        coded = pc.if_else(pa.array(cut), core, words).dictionary_encode()
        none = len(coded.dictionary)  # the place of the empty piece
        first, second = coded.indices.to_numpy(zero_copy_only=False), np.full(len(words), none)
        at = np.flatnonzero(cut)
        tails = _ends_of(words.take(pa.array(at)), (whole - size)[at].astype(np.int64)).dictionary_encode()
        second[at] = none + 1 + tails.indices.to_numpy(zero_copy_only=False)
        return first, second, pa.concat_arrays([coded.dictionary, pa.array([""]), tails.dictionary])

    def _ids(self, pieces: pa.Array, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of all pieces, and where those of each begin and how many it has."""
        letters = pc.match_substring_regex(pieces, LETTERS).to_numpy(zero_copy_only=False) if self.joined else np.zeros(len(pieces), bool)
        size = np.zeros(len(pieces), np.int64)
        ids, ends = self._joined_ids(pc.utf8_lower(pieces.filter(pa.array(letters)))) if letters.any() else (np.zeros(0, "<u4"), np.zeros(0, np.int64))
        if len(ends) != letters.sum():  # some word has no id that ends it
            letters[:], ids, ends = False, ids[:0], ends[:0]
        size[letters] = np.diff(ends, prepend=0)
        rest = np.flatnonzero(~letters)
        found = self._single_ids(pieces.take(pa.array(rest)).to_pylist(), times[rest])
        size[rest] = np.fromiter(map(len, found), np.int64, len(found))
        starts = np.empty(len(pieces), np.int64)
        starts[letters] = ends - size[letters]
        starts[rest] = len(ids) + np.cumsum(size[rest]) - size[rest]
        return np.concatenate([ids, np.fromiter(chain.from_iterable(found), "<u4")]), starts, size

    def _joined_ids(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of lower-case words of letters, one after another, and where each one's end."""
        bounds = pa.array(np.append(np.arange(0, len(words), JOINED), len(words)).astype(np.int32))
        texts = pc.binary_join(pa.ListArray.from_arrays(bounds, words), " ").to_pylist()
        parts = (texts[i : i + JOINED_TEXTS] for i in range(0, len(texts), JOINED_TEXTS))
        ids = np.concatenate([np.array(e.ids, "<u4") for part in parts for e in self.joined.encode_batch_fast(part, add_special_tokens=False)])
        return ids, np.flatnonzero(self.is_last[ids]) + 1

    def _single_ids(self, pieces: list[str], times: np.ndarray) -> list[list[int]]:
        """The ids of each piece."""
        known = self.known
        found = [known.get(x) for x in pieces]
        other = [i for i, x in enumerate(found) if x is None]
        for i, e in zip(other, self.tokenizer.encode_batch_fast([pieces[i] for i in other], add_special_tokens=False), strict=True):
            found[i] = e.ids
        for i in np.flatnonzero(times >= FREQUENT).tolist():
            if len(known) >= REMEMBERED_WORDS:
                break
            known[pieces[i]] = found[i]
        return found

    def encode(self, texts: pa.Array, end_id: int | None = END_ID) -> tuple[np.ndarray, np.ndarray]:
        """Offsets of each text's ids, and all ids (uint32), each text's followed by end_id."""
        texts = pc.fill_null(texts, "")
        marked = pc.match_substring(texts, "<|")  # special tokens are told by case
        offsets, flat = ascii_words(pc.if_else(marked, texts, pc.ascii_lower(texts)))
        coded = flat.dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False)
        first, second, pieces = self._split(coded.dictionary)
        # each word's core and tail, one after another; most tails are empty
        order = np.stack([first[codes], second[codes]], 1).ravel() if len(codes) else np.zeros(0, np.int64)
        ids, starts, size = self._ids(pieces, np.bincount(order, minlength=len(pieces)))
        order = order[size[order] > 0] if len(order) else order
        n = size[order]
        found = ids[ragged(starts[order], n)] if len(order) else np.zeros(0, "<u4")
        # a word's ids are those of its two pieces
        per_word = size[first[codes]] + size[second[codes]] if len(codes) else np.zeros(0, np.int64)
        ends = np.concatenate([[0], np.cumsum(per_word)])[offsets]
        if end_id is None:
            return ends, found
        rows = len(texts)
        out = np.empty(len(found) + rows, "<u4")
        stops = ends[1:] + np.arange(rows)
        mask = np.ones(len(out), bool)
        mask[stops] = False
        out[mask], out[stops] = found, end_id
        return np.concatenate([[0], stops + 1]), out


def _ends_of(words: pa.Array, size: np.ndarray) -> pa.Array:
    """The last `size` bytes of each word, which begin a character."""
    last = np.cumsum(pc.binary_length(words).to_numpy(zero_copy_only=False), dtype=np.int64)
    data = np.frombuffer(b"".join(words.cast(pa.binary()).to_pylist()), np.uint8)
    bounds = pa.py_buffer(np.concatenate([[0], np.cumsum(size)]).astype(np.int32).tobytes())
    return pa.Array.from_buffers(pa.string(), len(words), [None, bounds, pa.py_buffer(data[ragged(last - size, size)].tobytes())])


_ENCODERS: dict[str, TextEncoder] = {}


def encoder(path: str) -> TextEncoder:
    """One encoder per worker process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = TextEncoder(path)
    return _ENCODERS[path]


def crc32(ids: np.ndarray) -> int:
    return zlib.crc32(memoryview(np.ascontiguousarray(ids, "<u4")).cast("B"))


def encode_documents(docs: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id", end_id: int = END_ID) -> DataFrame:
    """doc_id, n_tokens and ids of each row's whole text (null: empty), with end_id at the end. Other columns are left out; rows repeat as they do in docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in slices(batches, "text", BATCH_BYTES):
            offsets, ids = enc.encode(b.column("text"), end_id)
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids.view("<i4")))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.diff(offsets)), lists], ["doc_id", "n_tokens", "ids"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(frugal(run), "doc_id long, n_tokens long, ids array<int>")


def write_tokens(
    docs: DataFrame, out: str, path: str, files: int | None = None, row_group_bytes: int = 32 << 20, page_bytes: int = 256 << 10, dictionary: bool = False, **columns: str
) -> None:
    """Encode docs and write their token table to `out`, in ascending doc_id order (null ids first).

    files: how many, by default one for FILE_TEXT_BYTES of text. dictionary:
    encode ids by a dictionary rather than by deltas. Rows that share a doc_id
    stand together, shortest text first. An empty table gives a folder that
    read_tokens reads as no rows.
    """
    doc_id, text = columns.get("doc_id", "doc_id"), columns.get("text", "text")
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    n = files or -(-(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 1) // FILE_TEXT_BYTES)
    # the length and a hash of the text tell apart rows that share a doc_id, so those spread too
    ordered = rows.repartitionByRange(int(n), F.col("doc_id").asc_nulls_first(), F.length("text"), F.xxhash64("text")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.length("text"), F.xxhash64("text"), "text")
    shard = ordered.withColumn("shard", F.spark_partition_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, at = encoder(path), 0
        for b in slices(batches, "text", BATCH_BYTES):
            offsets, ids = enc.encode(b.column("text"))
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids.view("<i4")))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("shard"), pa.array(at + offsets[:-1]), pa.array(np.diff(offsets)), lists], ["doc_id", "shard", "shard_start", "n_tokens", "ids"]
            )
            at += int(offsets[-1])

    (
        shard.mapInArrow(frugal(run), "doc_id long, shard int, shard_start long, n_tokens long, ids array<int>")
        .write.option("parquet.writer.version", "v2")
        .option("parquet.enable.dictionary", str(dictionary).lower())
        .option("parquet.block.size", row_group_bytes)
        .option("parquet.page.size", page_bytes)
        .option("compression", "zstd")
        .parquet(out)
    )


TOKEN_SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("shard", T.IntegerType()), T.StructField("shard_start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType()))]
)


def read_tokens(spark: SparkSession, path: str, first: int | None = None, last: int | None = None, ids: bool = True) -> DataFrame:
    """Rows of a token table, of the doc_ids first to last (the filter reaches row groups and pages); without ids, the metadata columns alone."""
    rows = spark.read.schema(TOKEN_SCHEMA).parquet(path)
    if first is not None:
        rows = rows.filter(F.col("doc_id") >= first)
    if last is not None:
        rows = rows.filter(F.col("doc_id") <= last)
    return rows if ids else rows.drop("ids")


#: Files whose starts one task adds up.
SHARDS_A_BLOCK = 4096


def shard_starts(tokens: DataFrame) -> DataFrame:
    """shard and the number of ids before it, from the metadata columns alone: within blocks of files, and over the blocks, so a task sees some thousand rows of either."""
    per = tokens.groupBy("shard").agg(F.sum("n_tokens").alias("n")).withColumn("block", F.floor(F.col("shard") / SHARDS_A_BLOCK))
    upto = Window.rowsBetween(Window.unboundedPreceding, -1)
    blocks = per.groupBy("block").agg(F.sum("n").alias("n"))
    starts = blocks.select("block", F.coalesce(F.sum("n").over(upto.orderBy("block")), F.lit(0)).alias("start"))
    within = F.coalesce(F.sum("n").over(upto.partitionBy("block").orderBy("shard")), F.lit(0))
    return per.withColumn("within", within).join(starts, "block").select("shard", (F.col("start") + F.col("within")).alias("before"))


def token_digests(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each row, from the ids that the files hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("ids")
            offsets = lists.offsets.to_numpy()
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype("<u4", copy=False)
            offsets = offsets - offsets[0]
            crc = [crc32(flat[i:j]) for i, j in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("shard"), b.column("shard_start"), pa.array(np.diff(offsets).astype(np.int64)), pa.array(crc, pa.int64())], ["doc_id", "shard", "shard_start", "n_tokens", "ids_crc32"])

    read = tokens.select("doc_id", "shard", "shard_start", "ids").mapInArrow(frugal(run), "doc_id long, shard int, shard_start long, n_tokens long, ids_crc32 long")
    starts = stored(shard_starts(tokens.drop("ids")), "starts")
    return join_dimension(read, starts, "shard").select("doc_id", (F.col("before") + F.col("shard_start")).alias("start"), "n_tokens", "ids_crc32")


def op2_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids, written to files in doc_id order and read back."""
    out = new_path(spark, "tokens")
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), out, tokenizer_path())
    return token_digests(read_tokens(spark, out))
