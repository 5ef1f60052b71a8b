"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

A source's target is its share of all words by weight, at most MOST_EPOCHS
times its own words. Whole epochs take every document; the rest of the target
is drawn without replacement: each document has an exponential key over its
quality weight, documents stand in key order, and the first ones up to the
budget are taken, the last of them in part. Sums of key buckets place the
budget's end, so only the one bucket that holds it is ever sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftwell.llm.common import join_dimension, stored

MOST_EPOCHS = 3
SEED = 11
#: Rows of a key bucket, on average: what one task sorts at a time.
BUCKET_ROWS = 5000
#: A word is what stands between ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Words of whole texts; null and empty texts have none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality_weight(text: Column, words: Column) -> Column:
    """A document's sampling weight, from the mean word length alone: 1 for 2.5 to 12 characters, else 0.5 (no words: 0.5)."""
    mean = F.try_divide(F.length(text) - words + 1, words)
    return F.when((words > 0) & mean.between(2.5, 12.0), 1.0).otherwise(0.5)


def source_targets(sources: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = MOST_EPOCHS) -> DataFrame:
    """source, source_size -> target: shares by weight (repeating in code point order, null last) of all words, none above `most` times its source.

    The excess is reshared by weight among the others until none is above:
    sources in ascending order of cap per weight are capped as long as the
    common level of the rest stands above theirs. One row a source; the
    windows are over that table.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    at = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    capped = sources.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (at + 1).cast("int"))).withColumn("cap", F.col("source_size") * float(most))
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    upto = order.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(upto), F.lit(0.0))) / (F.sum("w").over(every) - F.coalesce(F.sum("w").over(upto), F.lit(0.0)))
    # the first source that is not above its cap at the level left to it sets the level
    leveled = capped.withColumn("level", level).withColumn("ok", F.col("level") * F.col("w") <= F.col("cap"))
    final = leveled.withColumn("lambda", F.min(F.when(F.col("ok"), F.struct(F.col("cap") / F.col("w"), F.col("level")))).over(every)["level"])
    return final.select("source", "source_size", F.least(F.col("cap"), F.coalesce(F.col("lambda") * F.col("w"), F.col("cap"))).alias("target"))


def mix(rows: DataFrame, targets: DataFrame, seed: int = SEED, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """rows (source, size, weight, tie, and other columns) with source_size, target, epochs, drawn and taken.

    taken: words of this row in the mix, repeats counted: `size` times the whole
    epochs, and what the drawn rest takes of it. The key comes from `tie`, a
    hash of the row's id and text, so reruns agree, and rows that share an id or
    have none still have keys of their own; rows of equal keys are ordered by
    size, and equal rows stand for each other. Rows of no words take part and
    take 0.
    """
    uniform = (F.xxhash64(F.col("tie"), F.lit(seed)).bitwiseAND(F.lit((1 << 52) - 1)) + 0.5) / float(1 << 52)
    key = -F.log(uniform) / F.greatest(F.col("weight"), F.lit(1e-6))
    n_rows = rows.groupBy("source").agg(F.count("*").alias("source_rows"))
    dims = targets.join(n_rows.withColumnRenamed("source", "s2"), F.col("source").eqNullSafe(F.col("s2"))).drop("s2")
    dims = dims.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.try_divide("target", "source_size"))).otherwise(0).cast("long"))
    dims = stored(dims.withColumn("rest", F.greatest(F.lit(0), F.round(F.col("target")).cast("long") - F.col("epochs") * F.col("source_size"))), "targets")
    keyed = join_dimension(rows.withColumn("_key", key), dims, "source")
    # 1 - exp(-key) grows with the key and spreads it over 0 to 1
    n_buckets = F.ceil(F.col("source_rows") / float(bucket_rows))
    keyed = keyed.withColumn("_bucket", F.floor((1 - F.exp(-F.col("_key"))) * n_buckets).cast("long"))
    sums = keyed.groupBy("source", "_bucket").agg(F.sum("size").alias("n"), F.first("rest").alias("rest"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # the bucket in which the budget ends, one a source
    ends = sums.withColumn("before", before).filter((F.col("before") < F.col("rest")) & (F.col("before") + F.col("n") >= F.col("rest")))
    ends = stored(ends.select("source", F.col("_bucket").alias("end_bucket"), (F.col("rest") - F.col("before")).alias("end_rest")), "ends")
    placed = join_dimension(keyed, ends, "source")
    at_end = F.col("_bucket").eqNullSafe(F.col("end_bucket"))
    inside = placed.filter(at_end)
    by_key = Window.partitionBy("source").orderBy("_key", "size", "tie").rowsBetween(Window.unboundedPreceding, -1)
    drawn = F.greatest(F.lit(0), F.least(F.col("size"), F.col("end_rest") - F.coalesce(F.sum("size").over(by_key), F.lit(0))))
    whole = F.when(F.col("_bucket") < F.col("end_bucket"), F.col("size")).otherwise(F.lit(0))
    taken = inside.withColumn("_drawn", drawn).unionByName(placed.filter(~at_end).withColumn("_drawn", whole))
    out = taken.withColumn("taken", (F.col("size") * F.col("epochs") + F.col("_drawn")).cast("long"))
    return out.select(*rows.columns, "source_size", "target", "epochs", F.col("_drawn").alias("drawn"), "taken")


def sizes(docs: DataFrame) -> list[Column]:
    """The columns source, size, weight and tie that mix() needs, of docs with doc_id, source and text."""
    words = word_count(F.col("text"))
    return [F.col("source").cast("string").alias("source"), words.alias("size"), quality_weight(F.col("text"), words).alias("weight"), F.xxhash64("doc_id", "text").alias("tie")]


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, weight and tie of each row."""
    rows = docs.select("doc_id", "source", "text", word_count(F.col("text")).alias("_size"))
    return rows.select("doc_id", F.col("source").cast("string").alias("source"), F.col("_size").alias("size"), quality_weight(F.col("text"), F.col("_size")).alias("weight"), F.xxhash64("doc_id", "text").alias("tie"))


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to weights 1, 2, 3 repeating over the sources."""
    rows = stored(sized(spark.read.parquet(f"{sf_dir}/documents.parquet")), "sized")
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    return mix(rows, source_targets(sources)).select("doc_id", "size", "source_size", "target", "taken", "source", "epochs")
