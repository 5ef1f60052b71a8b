"""Texts hidden in texts: encoded runs and invisible messages as virtual files, to a fixpoint.

What a run decodes to becomes a file of its own, whose findings and signals
stand at the run's place in the real file; it is opened again, layer by layer.
Each layer is one pass over the layer before, and lineage is two columns: the
run that a virtual file came from, and its place in the real file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.functions.ranks import demote
from siftwell.functions.text import looks_like_id, one_of, printable_ratio, settled
from siftwell.operators.spans import text_matches
from siftwell.operators.unicode_runs import is_suspect, unicode_runs
from siftwell.session import stored

#: Layers that are opened, characters of a base64 or hexadecimal run at least, escapes, numbers in a call and in a list, characters and readable share of what counts as text, and the most of it that is opened. Fixed values.
DEPTH, LEAST_RUN, LEAST_ESCAPES, LEAST_CALL, LEAST_LIST, LEAST_TEXT, LEAST_PRINTABLE, MOST_TEXT, MOST_RUNS = 2, 80, 16, 9, 16, 8, 0.85, 64 * 1024, 50

_BASE64 = rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/]{{{LEAST_RUN - 2},}}+={{0,2}}+(?!=)"
_HEX = rf"(?<![0-9A-Fa-f])[0-9A-Fa-f]{{{LEAST_RUN},}}+"
_ESCAPES = rf"(?:\\x[0-9A-Fa-f]{{2}}){{{LEAST_ESCAPES},}}+"
_CODES = rf"(?:\b(?:fromCharCode|chr)\s*\(|\[)\s*\d{{2,3}}(?:\s*,\s*\d{{2,3}}){{{LEAST_CALL - 1},}}+\s*[)\]]"
ENCODINGS = {"base64": _BASE64, "escapes": _ESCAPES, "hex": _HEX, "charcode": _CODES}
#: Letters and digits of base64, which those of hexadecimal are among, as many as the shortest run has. Fixed value.
_LONG = rf"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{{{LEAST_RUN - 2}}}"


def may_hide(text: Column) -> Column:
    """Whether a text has a run to decode or a character that shows nothing. Cheaper tests of what a run can't do without come first."""
    long = text.rlike(_LONG) & (text.rlike(_BASE64) | text.rlike(_HEX))
    escapes = text.contains("\\x") & text.rlike(_ESCAPES)
    codes = (text.contains("[") | text.contains("fromCharCode") | text.contains("chr")) & text.rlike(_CODES)
    return F.coalesce(long | escapes | codes | is_suspect(text), F.lit(False))


def decoded(encoding: str, run: Column) -> Column:
    """The text that a run's bytes or codes are, null where they are none. Bytes have to be UTF-8; ids and digests are no base64."""
    if encoding == "base64":
        whole = (F.length(run) >= LEAST_RUN) & (F.length(run) % 4 == 0) & ~looks_like_id(run)
        text = F.when(whole, F.try_validate_utf8(F.try_to_binary(run, F.lit("base64")).cast("string")))
    elif encoding == "charcode":
        numbers = F.transform(F.regexp_extract_all(run, F.lit(r"\d+"), F.lit(0)), lambda x: x.cast("int"))
        enough = F.size(numbers) >= F.when(run.startswith("["), LEAST_LIST).otherwise(LEAST_CALL)
        closed = F.when(run.startswith("["), run.endswith("]")).otherwise(run.endswith(")"))
        plain = F.forall(numbers, lambda x: x.between(9, 0x7E))
        text = F.when(enough & closed & plain, F.array_join(F.transform(numbers, lambda x: F.char(x)), ""))
    else:
        digits = F.regexp_replace(run, r"\\x", "")
        text = F.when(F.length(digits) % 2 == 0, F.try_validate_utf8(F.try_to_binary(digits, F.lit("hex")).cast("string")))
    return text


def encoded_runs(files: DataFrame) -> DataFrame:
    """files' columns without text, with line (from 1), at (code points before it in its line), encoding and decoded of each run that decodes to readable text; at most the first MOST_RUNS of a file and encoding, as the engine opens no more. Texts are matched whole, so a list of codes may run over lines."""
    kept = [c for c in files.columns if c != "text"]
    names, patterns = list(ENCODINGS), list(ENCODINGS.values())
    held = F.filter(F.array(*[F.when(F.col("text").rlike(p), F.lit(k)) for k, p in enumerate(patterns)]), lambda k: k.isNotNull())
    rows = text_matches(settled(files, _which=held).filter(F.size("_which") > 0), patterns, "_which", "text")
    each = rows.select(*kept, "text", F.explode("hits").alias("r"))
    text = one_of(F.col("r.rule"), [decoded(n, F.col("r.matched")) for n in names])
    found = settled(each, _decoded=text).filter((F.length("_decoded") >= LEAST_TEXT) & (printable_ratio(F.col("_decoded")) >= LEAST_PRINTABLE))
    before = F.expr("substring(text, 1, r.offset)")
    line = F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1
    run = found.select(*kept, line.cast("int").alias("line"), F.length(F.substring_index(before, "\n", -1)).alias("at"), F.get(F.array(*[F.lit(n) for n in names]), F.col("r.rule")).alias("encoding"), F.substring("_decoded", 1, MOST_TEXT).alias("decoded"), F.col("r.offset").alias("_offset"))
    first = F.row_number().over(Window.partitionBy("file_id", "encoding").orderBy("_offset"))
    return run.withColumn("_n", first).filter(F.col("_n") <= MOST_RUNS).drop("_n", "_offset")


def invisible_messages(files: DataFrame) -> DataFrame:
    """As encoded_runs(), of runs of code points that show nothing and spell a message."""
    kept = tuple(c for c in files.columns if c not in ("text", "file_id"))
    found = unicode_runs(files, keep=kept).filter(F.col("decoded").isNotNull() & (F.length("decoded") >= LEAST_TEXT))
    return found.select("file_id", *kept, "line", (F.col("column") - 1).alias("at"), F.col("issue").alias("encoding"), "decoded")


def virtual_files(files: DataFrame, depth: int = DEPTH) -> DataFrame | None:
    """All texts hidden in files, layer by layer, as files (scripts, of the outer file's bundle, path and path context) with layer, parent (the file_id it was found in), encoding, line and at (its outermost run's place in the real file). None where nothing is hidden.

    Stored a layer; a layer without any ends the search. Texts that decode to themselves don't exist, and each layer is shorter than the one before, so depth is a bound on work and not on truth.
    """
    columns, layer, out = files.columns, files, None
    for k in range(1, depth + 1):
        runs = encoded_runs(layer).unionByName(invisible_messages(layer), allowMissingColumns=True)
        outer = ("line", "at") if k == 1 else ("_line", "_at")
        rows = runs.select(
            "bundle_id", F.xxhash64("file_id", "encoding", "line", "at").alias("file_id"), "path", F.lit("script").alias("kind"), F.lit("code").alias("role"), "path_context", F.col("decoded").alias("text"),
            F.lit(k).alias("layer"), F.col("file_id").alias("parent"), "encoding", F.col(outer[0]).alias("_line"), F.col(outer[1]).alias("_at"),
        )
        made = stored(rows, "virtual-files")
        if made.isEmpty():
            break
        out = made if out is None else out.unionByName(made)
        layer = made.select(*columns, "_line", "_at")
    return None if out is None else out.withColumnsRenamed({"_line": "line", "_at": "at"})


def relocated(matches: DataFrame, virtual: DataFrame) -> DataFrame:
    """Matches of virtual files at the place of the run in the real file."""
    places = virtual.select(F.col("file_id").alias("_id"), F.col("line").alias("_line"), F.col("at").alias("_at"))
    rows = matches.join(places, F.col("file_id") == F.col("_id"))
    return rows.withColumns({"line": F.col("_line"), "at": F.col("_at")}).select(*matches.columns)


def payload_grades(matches: DataFrame, virtual: DataFrame, depth: int = DEPTH) -> DataFrame:
    """virtual's columns with sev, conf and rules of each virtual file that hides a finding of medium severity or more, its own or of a file hidden in it.

    Critical if what it hides is high or worse, else high; a step lower and of
    low confidence in a file of tests or write-ups, of low confidence in one of
    a container. Deepest layers first: a hidden payload counts as a finding of
    the file that it lies in.
    """
    own = matches.filter(~F.col("rule_id").startswith("signal/") & (F.col("sev") >= 2)).select("file_id", "rule_id", "sev")
    light = virtual.drop("text")
    out, inner = None, None
    for k in range(depth, 0, -1):
        seen = own if inner is None else own.unionByName(inner)
        of = seen.groupBy("file_id").agg(F.max("sev").alias("_top"), F.array_sort(F.collect_set("rule_id")).alias("rules"))  # at most as many as the catalog
        rows = light.filter(F.col("layer") == k).join(of, "file_id")
        where = F.col("path_context") if k == 1 else F.lit(None).cast("string")
        sev = F.when(F.col("_top") >= 3, 4).otherwise(3)
        graded = rows.withColumns({"sev": F.when(F.coalesce(where.isin("dev", "educational"), F.lit(False)), demote(sev)).otherwise(sev).cast("int"), "conf": F.when(where.isNotNull(), 0).otherwise(2)}).drop("_top")
        out = graded if out is None else out.unionByName(graded)
        named = F.array_union("rules", F.array(F.lit("obfuscation/encoded-payload")))
        inner = graded.select(F.col("parent").alias("file_id"), F.explode(named).alias("rule_id"), "sev")
    return out
