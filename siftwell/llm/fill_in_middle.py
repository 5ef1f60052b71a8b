"""Fill-in-middle transformation of whole texts: a pipeline of Arrow kernels.

A batch's texts are cut into units (a run of ASCII letters, or any other one
code point) as list arrays, flattened beside their parents' indices, numbered
within their parent, filtered by role (prefix, middle, suffix), rebuilt into
lists and joined, so no Python code runs on a unit. Cuts, form and order come
from a hash of the document's key alone: reruns agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.llm.common import frugal, slices

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = "1"
#: Texts of a batch, in bytes: a unit takes some 40 bytes while it is sorted by role.
BATCH_BYTES = 1 << 20
#: A unit in bytes of UTF-8, and the byte, which no UTF-8 text has, that ends it.
_UNIT = rb"([A-Za-z]+|[\x00-\x40\x5b-\x60\x7b-\x7f]|[\xc0-\xff][\x80-\xbf]*)"
_END = b"\xff"
SCHEMA = "doc_id long, n long, form string, output string, prefix_chars long, middle_chars long"


def units(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All units of texts (no nulls), in order, and for each the place of its text."""
    marked = pc.replace_substring_regex(texts.cast(pa.large_binary()), _UNIT, rb"\1" + _END)
    lists = pc.split_pattern(marked, _END)
    flat, parents = pc.list_flatten(lists), pc.list_parent_indices(lists)
    full = pc.greater(pc.binary_length(flat), 0)
    return flat.filter(full), parents.filter(full).to_numpy().astype(np.int64)


def _offsets(counts: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])


def pieces(flat: pa.Array, parents: np.ndarray, first: np.ndarray, second: np.ndarray, n: np.ndarray) -> list[pa.Array]:
    """Prefix, middle and suffix of each text: its units before `first`, up to `second`, and the rest of its n."""
    ordinals = np.arange(len(parents), dtype=np.int64) - _offsets(n)[:-1][parents]
    role = pa.array((ordinals >= first[parents]).astype(np.int8) + (ordinals >= second[parents]).astype(np.int8))
    out = []
    for k, counts in enumerate((first, second - first, n - second)):
        kept = flat.filter(pc.equal(role, k)).cast(pa.large_string())
        out.append(pc.binary_join(pa.LargeListArray.from_arrays(pa.array(_offsets(counts)), kept), pa.scalar("", pa.large_string())))
    return out


def arranged(texts: pa.Array, h: list[np.ndarray], plain_from: int, spm_below: int) -> list[pa.Array]:
    """n, form, output, prefix_chars and middle_chars of texts (no nulls), by their four hashes."""
    texts = texts.cast(pa.large_string())
    flat, parents = units(texts)
    n = np.bincount(parents, minlength=len(texts)).astype(np.int64)
    one, two = h[0] % (n + 1), h[1] % (n + 1)
    prefix, middle, suffix = pieces(flat, parents, np.minimum(one, two), np.maximum(one, two), n)
    marked = pc.match_substring(texts, PREFIX)
    for mark in (SUFFIX, MIDDLE):
        marked = pc.or_(marked, pc.match_substring(texts, mark))
    plain = pc.or_(marked, pa.array((n == 0) | (h[2] % 100 >= plain_from)))
    spm = pa.array(h[3] % 100 < spm_below)
    p, s, m, none = (pa.scalar(x, pa.large_string()) for x in (PREFIX, SUFFIX, MIDDLE, ""))
    forms = pc.make_struct(plain, spm, field_names=["plain", "spm"])
    output = pc.case_when(forms, texts, pc.binary_join_element_wise(s, suffix, p, prefix, m, middle, none), pc.binary_join_element_wise(p, prefix, s, suffix, m, middle, none))
    form = pc.case_when(forms, pa.scalar("plain"), pa.scalar("spm"), pa.scalar("psm"))
    chars = [pc.if_else(plain, pa.scalar(None, pa.int64()), pc.utf8_length(x).cast(pa.int64())) for x in (prefix, middle)]
    return [pa.array(n), form.cast(pa.string()), output.cast(pa.string()), *chars]


def fill_in_middle(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: str = SEED, plain_from: int = 90, spm_below: int = 20) -> DataFrame:
    """doc_id (the key), n (units), form (plain, psm or spm), output, prefix_chars and middle_chars (code points; null if plain) of each row of docs.

    The first four groups of eight digits of the hexadecimal SHA-256 of
    `seed:key` set the two cuts, whether the text stays plain (third, modulo
    100, from plain_from on) and whether the suffix comes first (fourth, below
    spm_below). Empty texts, and those that hold a marker, stay plain, so
    restored() gives every text back.

    A null text counts as empty, and a null key as empty in the hash. Repeated
    rows give repeated rows. Texts are never cut: one longer than BATCH_BYTES
    comes alone. An empty table gives none; other columns of docs, whatever
    their names, are not read.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256)
    groups = [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long").alias(f"h{k}") for k in range(4)]
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), *groups)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", BATCH_BYTES):
            h = [b.column(f"h{k}").to_numpy() for k in range(4)]
            made = arranged(b.column("text"), h, plain_from, spm_below)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *made], ["doc_id", "n", "form", "output", "prefix_chars", "middle_chars"])

    return rows.mapInArrow(frugal(run), SCHEMA)


def restored(form: Column, output: Column) -> Column:
    """The text that an output of this form was made from: neither prefix nor suffix holds a marker, so the first two marks behind the leading one end them."""
    body = F.substring(output, len(PREFIX) + 1, 2**31 - 1)
    psm, spm = F.split(body, f"{SUFFIX}|{MIDDLE}", 3), F.split(body, f"{PREFIX}|{MIDDLE}", 3)
    joined = lambda x, order: F.concat(*[F.get(x, F.lit(k)) for k in order])
    return F.when(form == "plain", output).when(form == "psm", joined(psm, (0, 2, 1))).otherwise(joined(spm, (1, 2, 0)))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document rearranged, with digests of the output and of the text rebuilt from it."""
    made = fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("form"), F.col("output")), 256).alias("restored_sha256"))


OP11_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
         sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h
  FROM documents),
c AS (
  SELECT doc_id, text, u, len(u)::BIGINT AS n,
         ('0x' || h[1:8])::BIGINT % (len(u) + 1) AS a, ('0x' || h[9:16])::BIGINT % (len(u) + 1) AS b,
         ('0x' || h[17:24])::BIGINT % 100 AS c3, ('0x' || h[25:32])::BIGINT % 100 AS c4
  FROM d),
p AS (
  SELECT doc_id, text, n, array_to_string(u[1:least(a, b)], '') AS pre,
         array_to_string(u[least(a, b) + 1:greatest(a, b)], '') AS mid, array_to_string(u[greatest(a, b) + 1:], '') AS suf,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR c3 >= 90 THEN 'plain'
              WHEN c4 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
                        ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p"""
