"""Findings and verdicts as reports: SARIF results, table rows, summaries.

A report stays a DataFrame: one row a finding or a bundle, so it is written by
Spark's own writers (`write_lines`) and no report is gathered in one place. A
summary quotes a few findings of a bundle, limited before they are collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.functions import text as X
from siftwell.functions.ranks import CONFIDENCES, SEVERITIES, VERDICTS, name_of
from siftwell.session import stored
from siftwell.operators.rollup import order, worst

#: Level and score of a code scanning alert by severity rank. Fixed values.
LEVELS = ["note", "note", "warning", "error", "error"]
SCORES = ["1.0", "3.0", "5.0", "7.5", "9.5"]

#: Characters of a summary, of one of its lines, and kept for its last line. Fixed values.
SUMMARY, LINE, TAIL = 1500, 300, 40

#: What Java's encoder escapes and a URI component may hold as it is.
_UNESCAPED = {r"\+": "%20", "%21": "!", "%7E": "~", "%27": "'", "%28": "(", "%29": ")"}


def rule_name(rule_id: Column) -> Column:
    """`exec/download-and-run` as `DownloadAndRun`."""
    words = F.filter(F.split(F.regexp_replace(rule_id, "^[^/]*/", ""), "[^A-Za-z0-9]+"), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2)))), "")


def rule_anchor(rule_id: Column) -> Column:
    """A rule's id as an anchor of a page."""
    return F.replace(rule_id, F.lit("/"), F.lit("-"))


def uri(file: Column, prefix: str = "") -> Column:
    """A path as a relative URI: forward slashes, empty and `.` parts left out, percent-encoded; a virtual file is the file that holds it."""
    path = F.concat(F.lit(prefix.rstrip("/") + "/"), F.split_part(F.translate(file, "\\", "/"), F.lit("#"), F.lit(1)))
    parts = F.filter(F.split(path, "/"), lambda p: ~p.isin("", "."))

    def encoded(part: Column) -> Column:
        out = F.url_encode(part)
        for escaped, plain in _UNESCAPED.items():
            out = F.regexp_replace(out, escaped, plain)
        return out

    return F.when(F.size(parts) == 0, ".").otherwise(F.array_join(F.transform(parts, encoded), "/"))


def fingerprint(rule_id: Column, file: Column, snippet: Column) -> Column:
    """SHA-256 of what tells a finding apart wherever its line moves."""
    return F.sha2(F.concat_ws("|", rule_id, file, F.coalesce(snippet, F.lit(""))), 256)


def location(file: Column, line: Column) -> Column:
    """file:line, or the file alone where no line is known."""
    return F.when(line > 0, F.concat_ws(":", file, line.cast("string"))).otherwise(file)


def sarif_results(findings: DataFrame, prefix: str = "", tool: str = "siftwell") -> DataFrame:
    """bundle_id and result, a struct with the names of SARIF 2.1.0, a row a finding.

    findings: bundle_id, rule_id, sev, conf, file, line, column, snippet and
    message. No line: no region; no snippet: none in the region. Ranks outside
    their lists give nulls.
    """
    line = F.col("line")
    snippet = F.when(F.length("snippet") > 0, F.struct(X.reveal_invisible(F.col("snippet")).alias("text")))
    region = F.when(line > 0, F.struct(line.alias("startLine"), F.when(F.col("column") > 0, F.col("column")).alias("startColumn"), snippet.alias("snippet")))
    artifact = F.struct(uri(F.col("file"), prefix).alias("uri"), F.lit("%SRCROOT%").alias("uriBaseId"))
    place = F.struct(F.struct(artifact.alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))
    result = F.struct(
        F.col("rule_id").alias("ruleId"),
        name_of(F.col("sev"), LEVELS).alias("level"),
        F.struct(X.reveal_invisible(F.col("message")).alias("text")).alias("message"),
        F.array(place).alias("locations"),
        F.struct(fingerprint(F.col("rule_id"), F.col("file"), F.col("snippet")).alias(f"{tool}/v1")).alias("partialFingerprints"),
        F.struct(
            name_of(F.col("sev"), SEVERITIES).alias("severity"), name_of(F.col("conf"), CONFIDENCES).alias("confidence"), F.col("bundle_id").alias("bundle"), F.when(F.contains("file", F.lit("#")), F.col("file")).alias("path")
        ).alias("properties"),
    )
    return findings.select("bundle_id", result.alias("result"))


def sarif_rules(rules: DataFrame) -> DataFrame:
    """The rules of a run's tool, from rule_id, title, category, sev and conf."""
    return rules.select(
        F.col("rule_id").alias("id"),
        rule_name(F.col("rule_id")).alias("name"),
        F.struct(F.col("title").alias("text")).alias("shortDescription"),
        F.struct(name_of(F.col("sev"), LEVELS).alias("level")).alias("defaultConfiguration"),
        F.struct(F.array(F.lit("security"), F.col("category")).alias("tags"), name_of(F.col("sev"), SCORES).alias("security-severity"), name_of(F.col("conf"), CONFIDENCES).alias("precision")).alias("properties"),
    )


def write_lines(rows: DataFrame, path: str) -> None:
    """Rows as JSON lines under path, as many files as tasks."""
    rows.write.mode("overwrite").json(path)


def sarif_log(findings: DataFrame, rules: DataFrame, prefix: str = "", tool: str = "siftwell", version: str = "0.3.0") -> DataFrame:
    """place and line: one SARIF 2.1.0 document of a target as lines of text, in order of place, worst findings first.

    findings as in sarif_results, rules as in sarif_rules. Lines are made in
    parallel, a result a line; write_document() puts them into one file.
    """
    listed = F.array_sort(F.collect_list(F.struct("id", F.to_json(F.struct("*")).alias("json"))))
    head = sarif_rules(rules).agg(F.array_join(F.transform(listed, lambda x: x["json"]), ",").alias("rules"))  # a row a rule
    head = head.select(
        F.lit(0).cast("long").alias("place"),
        F.concat(F.lit(f'{{"$schema":"https://json.schemastore.org/sarif-2.1.0.json","version":"2.1.0","runs":[{{"tool":{{"driver":{{"name":"{tool}","version":"{version}","rules":['), "rules", F.lit("]}},"), F.lit('"columnKind":"unicodeCodePoints","results":[')).alias("line"),
    )
    ordered = numbered(findings, [*order(), F.col("bundle_id"), F.coalesce("column", F.lit(0))])
    results = sarif_results(ordered.withColumn("bundle_id", F.struct("bundle_id", "place")), prefix, tool)
    result = F.to_json(F.col("result").withField("properties", F.col("result.properties").withField("bundle", F.col("bundle_id.bundle_id"))))
    body = results.select(F.col("bundle_id.place").alias("place"), F.concat(F.when(F.col("bundle_id.place") > 1, ",").otherwise(""), result).alias("line"))
    foot = findings.sparkSession.range(1).select(F.lit(2**62).alias("place"), F.lit("]}]}").alias("line"))
    return head.unionByName(body).unionByName(foot)


def text_report(verdicts: DataFrame, findings: DataFrame, most: int = 20) -> DataFrame:
    """bundle_id, place and line: a report for people, flagged bundles first by name, each with its verdict, its worst findings and how many more there are."""
    head = one_line(verdicts).join(verdicts.select("bundle_id", "verdict"), "bundle_id").select("bundle_id", "verdict", F.lit(0).alias("place"), F.col("summary").alias("line"))
    said = F.concat(F.lit("  "), F.rpad(name_of(F.col("sev"), SEVERITIES), 9, " "), F.col("rule_id"), F.lit("  "), X.reveal_invisible(location(F.col("file"), F.col("line"))), F.lit("  "), X.reveal_invisible(F.col("message")))
    top = worst(findings, most).withColumn("place", F.row_number().over(Window.partitionBy("bundle_id").orderBy(*order(), "ord")))
    rows = top.join(verdicts.select("bundle_id", "verdict"), "bundle_id").select("bundle_id", "verdict", "place", said.alias("line"))
    more = findings.groupBy("bundle_id").agg((F.count("*") - most).alias("n")).filter("n > 0").join(verdicts.select("bundle_id", "verdict"), "bundle_id")
    rest = more.select("bundle_id", "verdict", F.lit(most + 1).alias("place"), F.concat(F.lit("  and "), F.col("n").cast("string"), F.lit(" more")).alias("line"))
    every = head.unionByName(rows).unionByName(rest)
    return numbered(every, [F.desc("verdict"), F.col("bundle_id"), F.col("place")], "at").select("bundle_id", F.col("at").alias("place"), "line")


def numbered(rows: DataFrame, by: list[Column], name: str = "place") -> DataFrame:
    """rows with their place, from 1, in an order over all of them: counts of ranges place a range, so no task holds more than one."""
    ranged = stored(rows.repartitionByRange(*by).withColumn("_part", F.spark_partition_id()), "ranged")
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"))  # a row a range
    starts = sizes.select(F.col("_part").alias("_range"), (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_start"))
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*by))
    placed = ranged.withColumn("_within", within).join(starts, F.col("_part") == F.col("_range"))
    return placed.withColumn(name, (F.col("_start") + F.col("_within")).cast("long")).select(*rows.columns, name)


def write_document(lines: DataFrame, path: str) -> None:
    """Lines (place, line) as one text file in order of place. One task writes it, as one file must be, and holds a line at a time."""
    lines.repartitionByRange(1, "place").sortWithinPartitions("place").select("line").write.mode("overwrite").text(path)


def counts_phrase() -> Column:
    """`2 critical, 1 high` of the columns n_<severity>, worst first; empty for none."""
    return F.concat_ws(", ", *[F.when(F.col(f"n_{s}") > 0, F.concat_ws(" ", F.col(f"n_{s}").cast("string"), F.lit(s))) for s in reversed(SEVERITIES)])


def one_line(verdicts: DataFrame, tool: str = "siftwell") -> DataFrame:
    """bundle_id and summary, a line a bundle, of bundle_verdicts."""
    counts = counts_phrase()
    return verdicts.select("bundle_id", F.concat(F.lit(f"{tool}: "), name_of(F.col("verdict"), VERDICTS), F.lit(" for "), F.col("bundle_id"), F.when(counts == "", "").otherwise(F.concat(F.lit(" ("), counts, F.lit(")")))).alias("summary"))


def agent_summary(verdicts: DataFrame, findings: DataFrame, most: int = 5, tool: str = "siftwell") -> DataFrame:
    """bundle_id and summary of every bundle: verdict, counts and its worst findings, a line each, within SUMMARY characters.

    A bundle that passes has its counts alone. Lines end before the first that
    no longer fits; the last line says how many findings are not listed.
    """
    line = X.clip(F.concat(F.lit("- ["), name_of(F.col("sev"), SEVERITIES), F.lit("] "), F.col("rule_id"), F.lit(" at "), X.reveal_invisible(location(F.col("file"), F.col("line"))), F.lit(": "), X.reveal_invisible(F.col("message"))), LINE)
    top = worst(findings, most).groupBy("bundle_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(*[c.alias(f"k{i}") for i, c in enumerate(_ascending())], line.alias("line")))), lambda x: x["line"]).alias("lines"))
    counts = counts_phrase()
    total = sum((F.col(f"n_{s}") for s in SEVERITIES[1:]), F.col(f"n_{SEVERITIES[0]}"))
    head = X.clip(F.concat(F.lit(f"{tool} "), F.when(F.col("verdict") == 2, "blocked ").otherwise("flagged "), F.col("bundle_id"), F.lit(": "), counts, F.lit(".")), SUMMARY - TAIL)
    start = F.struct(head.alias("text"), F.lit(0).alias("listed"), F.lit(True).alias("open"))

    def step(acc: Column, x: Column) -> Column:
        fits = acc["open"] & (F.length(acc["text"]) + 1 + F.length(x) <= SUMMARY - TAIL)
        return F.struct(F.when(fits, F.concat_ws("\n", acc["text"], x)).otherwise(acc["text"]).alias("text"), (acc["listed"] + fits.cast("int")).alias("listed"), fits.alias("open"))

    told = F.aggregate(F.coalesce("lines", F.array().cast("array<string>")), start, step)
    passed = F.when(total == 0, F.concat(F.lit(f"{tool} found no issues in "), F.col("bundle_id"), F.lit("."))).otherwise(
        F.concat(F.lit(f"{tool} passed "), F.col("bundle_id"), F.lit(" ("), counts, F.lit(", below the warning threshold)."))
    )
    rest = total - F.col("told.listed")
    more = F.when(rest > 0, F.concat(F.lit("\n- and "), rest.cast("string"), F.lit(" more."))).otherwise("")
    return verdicts.join(top, "bundle_id", "left").withColumn("told", told).select("bundle_id", F.when(F.col("verdict") == 0, passed).otherwise(F.concat(F.col("told.text"), more)).alias("summary"))


def _ascending() -> list[Column]:
    """The order of findings as values to sort upwards, as in rollup.order."""
    return [-F.col("sev"), -F.col("conf"), F.col("file"), F.coalesce("line", F.lit(0)), F.col("rule_id"), F.col("ord")]


def markdown_rows(findings: DataFrame, most: int) -> DataFrame:
    """bundle_id, place and row: the most worst findings of a bundle as rows of a Markdown table. Pipes and backslashes are escaped, line ends become spaces."""
    cell = lambda c: F.regexp_replace(X.one_line(X.reveal_invisible(c)), r"([\\|])", r"\\$1")
    cells = [name_of(F.col("sev"), SEVERITIES), F.concat(F.lit("`"), F.col("rule_id"), F.lit("`")), cell(location(F.col("file"), F.col("line"))), cell(F.col("message"))]
    placed = worst(findings, most).withColumn("place", F.row_number().over(Window.partitionBy("bundle_id").orderBy(*order(), "ord")))
    return placed.select("bundle_id", "place", F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("row"))
