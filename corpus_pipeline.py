"""Corpus pipeline: raw documents to packed training sequences.

The stages, in order: documents that quality rules reject go; one document of
each group of near duplicates stays; secrets are masked in the texts; sources
are mixed to target weights, so documents leave or repeat; the rest is packed
into sequences of tokens. Each stage takes what its predecessor kept, read
again from the table it was written to. All but the last return the columns of
documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.llm.common import stored
from siftwell.llm.mixing import mix, sizes, source_targets
from siftwell.llm.near_duplicates import near_duplicates
from siftwell.llm.packing import pack_pieces, token_pieces
from siftwell.llm.quality import by_rejection_per_cost, cascade, standard_rules
from siftwell.llm.secret_scan import learned, scan
from siftwell.llm.tokens import tokenizer_path


#: Words of a shingle, for near-duplicates among training documents.
SHINGLE = 5


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return cascade(docs, by_rejection_per_cost(docs, standard_rules()))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that of the smallest doc_id. Rows that repeat a doc_id leave one, that of the least text; rows without one all stay."""
    found = near_duplicates(docs.select("doc_id", "text"), shingle=SHINGLE)
    dropped = stored(found.filter(~F.col("kept") & F.col("doc_id").isNotNull()).select("doc_id").distinct(), "dropped")
    kept = docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)
    repeated = stored(docs.groupBy("doc_id").count().filter((F.col("count") > 1) & F.col("doc_id").isNotNull()).select("doc_id"), "repeated")
    if repeated.isEmpty():
        return kept
    once = kept.join(repeated, "doc_id", "left_anti").select(*docs.columns)
    # the least row of each repeated doc_id, aggregated before the shuffle
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    again = kept.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(row, F.struct("text", F.to_json(row))).alias("least"))
    return once.unionByName(again.select("least.*"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret replaced by a mask; n_chars follows the new text."""
    masked = scan(docs, learned(docs), redact=True)
    changed = F.length("text").cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None
    return masked if changed is None else masked.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(changed)).select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: once for each whole epoch of the source, and once more if the drawn rest takes at least half of its words.

    A document of no words has no say in the target and stays as often as there
    are whole epochs, but at least once.
    """
    rows = stored(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *sizes(docs)), "sized")
    mixed = mix(rows, source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size"))))
    copies = F.col("epochs") + ((F.col("size") > 0) & (F.col("drawn") * 2 >= F.col("size"))).cast("long")
    copies = F.when(F.col("size") > 0, copies).otherwise(F.greatest(F.lit(1), F.col("epochs"))).cast("int")
    return mixed.select("row", copies.alias("copies")).filter("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's token pieces in sequences of at most 4096 tokens."""
    return pack_pieces(token_pieces(docs, tokenizer_path()))


STAGES = [
    ("quality rules", quality_stage),
    ("near-duplicates", dedup_stage),
    ("secret scan", secrets_stage),
    ("source mixing", mixing_stage),
    ("best-fit packing", packing_stage),
]

#: Tokens, a learned field and packing aren't SQL; tests hold run() against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each stored before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
