"""The probabilistic reviewer around its scores: the text it reads, doubt of findings, and a finding of its own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUDGET = 96_000
DOUBT_UNDER, THREAT_FROM = 0.05, 0.075


def states(parts: DataFrame, by: str, order: list[str], header: Column, text: Column, budget: int = BUDGET) -> DataFrame:
    """by, state and n_chars: all parts of a bundle in order, each under a header; state is null beyond the budget and never cut.

    Sizes are summed first, so only bundles within the budget are put together.
    """
    part = F.concat(header, F.lit("\n"), F.coalesce(text, F.lit("")), F.lit("\n"))
    rows = parts.select(by, *order, part.alias("_p"))
    size = rows.groupBy(by).agg(F.sum(F.length("_p")).cast("long").alias("n_chars"))
    fits = size.filter(F.col("n_chars") <= budget).select(by)
    joined = rows.join(fits, by, "left_semi").groupBy(by).agg(F.array_sort(F.collect_list(F.struct(*order, "_p"))).alias("_all"))
    return size.join(joined.select(by, F.array_join(F.transform("_all", lambda x: x["_p"]), "").alias("state")), by, "left")


def doubt(findings: DataFrame, scores: DataFrame, under: float = DOUBT_UNDER) -> DataFrame:
    """findings with p_true and effect: confidence falls to low below `under`, but not of hard or critical ones. scores has one row a (bundle_id, category)."""
    rows = findings.join(scores.select("bundle_id", "category", "p_true"), ["bundle_id", "category"], "left")
    doubted = (F.col("p_true") < under) & ~F.col("hard") & (F.col("sev") < 4)
    effect = F.when(F.col("p_true").isNull(), "none").when(doubted, "doubted").otherwise("confirmed")
    return rows.withColumn("effect", effect).withColumn("conf", F.when(F.col("effect") == "doubted", 0).otherwise(F.col("conf")))


#: Probes of intent, whose mean counts, and the probe that counts as much as that mean. Fixed values.
INTENT_PROBES = ["hidden_instructions", "purpose_mismatch", "hidden_agenda", "unexpected_behavior", "malicious_intent"]
DOWNLOAD_PROBE = "unofficial_download"
#: The review probe that a category's findings are held against; other categories have none. Fixed values.
PROBE_FOR_CATEGORY = {
    "exfiltration": "data_exfiltration", "network": "data_exfiltration", "destructive": "destructive_command", "obfuscation": "obfuscation", "hidden-content": "obfuscation", "prompt-injection": "prompt_injection", "deception": "prompt_injection",
    "remote-execution": "remote_hidden_execution", "privilege": "security_control_change", "persistence": "security_control_change", "credential-access": "sensitive_data_access", "secrets": "sensitive_data_access", "supply-chain": "supply_chain",
}


def scores_by_category(probes: DataFrame) -> DataFrame:
    """bundle_id, category and p_true for doubt(), from (bundle_id, probe, p): each category by its probe."""
    pairs = probes.sparkSession.createDataFrame(list(PROBE_FOR_CATEGORY.items()), "category string, probe string")
    return probes.join(F.broadcast(pairs), "probe").select("bundle_id", "category", F.col("p").alias("p_true"))


def threat_scores(probes: DataFrame, at_least: float = THREAT_FROM, intent: list[str] | None = None, download: str = DOWNLOAD_PROBE) -> DataFrame:
    """bundle_id, score and flagged from (bundle_id, probe, p), a row a probe: half the mean of the intent probes and half the download probe; a probe without a row counts 0."""
    names = intent or INTENT_PROBES
    p = lambda name: F.coalesce(F.max(F.when(F.col("probe") == name, F.col("p"))), F.lit(0.0))
    total = p(names[0])
    for name in names[1:]:
        total = total + p(name)
    per = probes.groupBy("bundle_id").agg((total / len(names)).alias("mean"), p(download).alias("down"))
    score = (F.col("mean") + F.col("down")) / 2
    return per.select("bundle_id", score.alias("score"), (score >= at_least).alias("flagged"))


def threat_findings(probes: DataFrame, at_least: float = THREAT_FROM, reasons: int = 3, least_reason: float = 0.1) -> DataFrame:
    """A finding of medium severity for each flagged bundle, naming its largest probes of at least least_reason, at most `reasons` of them."""
    flagged = threat_scores(probes, at_least).filter("flagged")
    ranked = probes.filter(F.col("p") >= least_reason).groupBy("bundle_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("p")).alias("q"), "probe"))).alias("top"))  # a row a probe
    named = F.array_join(F.transform(F.slice("top", 1, reasons), lambda x: F.concat(x["probe"], F.lit(" "), F.format_number(-x["q"], 2))), ", ")
    rows = flagged.join(ranked, "bundle_id", "left")
    return rows.select(
        "bundle_id", F.lit("judge/malicious-skill").alias("rule_id"), F.lit("The reviewer finds the whole suspicious").alias("title"), F.lit("prompt-injection").alias("category"), F.lit(2).alias("sev"), F.lit(1).alias("conf"), F.lit(False).alias("hard"),
        F.lit(None).cast("string").alias("file"), F.lit(None).cast("int").alias("line"), F.lit(1).alias("column"), F.coalesce(named, F.lit("")).alias("snippet"), F.lit(40_000).alias("ord"), F.lit("judge").alias("source"),
    )


def dropped(before: DataFrame, after: DataFrame) -> DataFrame:
    """Findings (bundle_id, rule_id, file, line) that a review has lost: none may be, or the review is refused."""
    key = ["bundle_id", "rule_id", "file", "line"]
    return before.select(*key).exceptAll(after.select(*key))


def replay(findings: DataFrame, probes: DataFrame, family: dict[str, str], adding: dict[str, float], doubt_below: float, confirm_at: float) -> DataFrame:
    """findings as a review under another policy leaves them, from recorded probes (bundle_id, probe, p; a row a probe).

    family names the probe of a category. A finding whose probe is below
    doubt_below falls to low confidence, unless it is hard or critical; from
    confirm_at on it gains a step. A probe of `adding` that reaches its threshold
    adds a finding of medium severity where no finding of the bundle has it as
    its probe. Without a recorded probe a finding stays as it is.
    """
    named = F.lit(None).cast("string")
    for category, probe in family.items():
        named = F.when(F.col("category") == category, probe).otherwise(named)
    rows = findings.withColumn("_probe", named).join(probes.select("bundle_id", F.col("probe").alias("_probe"), F.col("p").alias("_p")), ["bundle_id", "_probe"], "left")
    conf = F.when((F.col("_p") < doubt_below) & (F.col("sev") < 4) & ~F.col("hard"), 0).when(F.col("_p") >= confirm_at, F.least(F.col("conf") + 1, F.lit(2))).otherwise(F.col("conf"))
    reviewed = rows.withColumn("conf", conf)
    reached = F.lit(False)
    for probe, least in adding.items():
        reached = reached | ((F.col("probe") == probe) & (F.col("p") >= least))
    open_ = probes.filter(reached).join(reviewed.select("bundle_id", F.col("_probe").alias("probe")).distinct(), ["bundle_id", "probe"], "left_anti")
    added = open_.select("bundle_id", F.concat(F.lit("judge/"), "probe").alias("rule_id"), F.lit(2).alias("sev"), F.lit(1).alias("conf"), F.lit(False).alias("hard"))
    return reviewed.drop("_probe", "_p").unionByName(added, allowMissingColumns=True)


def to_ask(states: DataFrame, questions: list[str], answers: DataFrame) -> DataFrame:
    """state_hash and question, once each, that no recorded answer (state_hash, question) covers; states without a hash are asked nothing."""
    every = states.filter(F.col("state_hash").isNotNull()).select("state_hash").distinct().select("state_hash", F.explode(F.array(*[F.lit(q) for q in questions])).alias("question"))
    return every.join(answers.select("state_hash", "question").distinct(), ["state_hash", "question"], "left_anti")
