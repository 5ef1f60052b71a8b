"""Install guard over tables of shell commands: intents, decisions and the trust gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.functions.ranks import VERDICTS

ACTIONS = ["allow", "ask", "deny"]

#: How commands install agent extensions: kind, pattern of one simple command, and the group that is the source. Fixed values.
INTENTS = [
    ("skills-cli", r"^(?:npx|bunx|pnpm dlx|yarn dlx)\s+(?:-y\s+|--yes\s+)?skills(?:@\S+)?\s+(?:add|install)\s+(\S+)", 1),
    ("git-clone", r"^git\s+(?:-\S+\s+(?:\S+\s+)?)*clone\s+(?:-\S+\s+)*(\S+)", 1),
    ("git-update", r"^git\s+(?:-C\s+(\S+)\s+)?(?:pull|fetch|checkout|switch|submodule\s+update)\b", 1),
    ("claude-plugin", r"^claude\s+plugin\s+(?:install|add|marketplace\s+add)\s+(\S+)", 1),
    ("codex-plugin", r"^codex\s+plugin\s+(?:install|add)\s+(\S+)", 1),
    ("pi-install", r"^pi\s+install\s+(\S+)", 1),
    ("opencode-plugin", r"^opencode\s+plugin\s+(?:install|add)\s+(\S+)", 1),
    ("archive-extract", r"^(?:unzip|tar)\s+[^;]*?(\S*\.(?:claude|codex|agents)/\S*)", 1),
    ("copy-into-skills", r"^(?:cp|mv|rsync|ln)\s+(?:-\S+\s+)*(\S+)\s+\S*\.(?:claude|codex|cursor|opencode|gemini|agents)/(?:skills|plugins)\b", 1),
    ("download-into-skills", r"^(?:curl|wget)\s+[^;]*?(https?://\S+)[^;]*\.(?:claude|codex|agents)/skills", 1),
    ("tamper", r"^(?:export\s+|unset\s+|env\s+)?([A-Z_]*(?:SKILL_GUARD|GUARD_DISABLE)[A-Z_]*)\b", 1),
]


def simple_commands(command: Column) -> Column:
    """A command line's simple commands: split at ; && || | & and newlines outside quotes, wrappers and assignments taken off."""
    # operators inside quotes are hidden by doubling, split, and shown again
    cut = F.regexp_replace(command, r"""((?:[^;&|\n"'\\]|\\.|"(?:[^"\\]|\\.)*"|'[^']*')+)""", "$1\u0001")
    parts = F.transform(F.split(cut, "\u0001[;&|\n]*"), lambda x: F.btrim(F.regexp_replace(x, r"^[;&|\s]+", "")))
    bare = F.transform(parts, lambda x: F.regexp_replace(x, r"^(?:(?:sudo|command|exec|time|nohup|env)\s+(?:-\S+\s+)*|[A-Za-z_]\w*=\S*\s+)+", ""))
    return F.filter(bare, lambda x: x != "")


def intents(commands: DataFrame, key: str = "command_id", command: str = "command") -> DataFrame:
    """key, ord, kind and source of every install intent; the text of sh -c and of $( ) counts as commands too (one level)."""
    inner = F.regexp_extract_all(F.col(command), F.lit(r"""(?:\b(?:ba|z)?sh\s+-l?c\s+(?:"([^"]*)"|'([^']*)'))|\$\(([^()]*)\)"""), F.lit(0))
    inner = F.transform(inner, lambda x: F.regexp_replace(x, r"""^(?:(?:ba|z)?sh\s+-l?c\s+["']|\$\()|["')]$""", ""))
    every = F.flatten(F.transform(F.concat(F.array(F.col(command)), inner), simple_commands))
    rows = commands.select(key, F.posexplode(every).alias("ord", "simple"))
    found = None
    for kind, pattern, group in INTENTS:
        hit = F.when(F.col("simple").rlike(pattern), F.struct(F.lit(kind).alias("kind"), F.nullif(F.regexp_extract("simple", pattern, group), F.lit("")).alias("source")))
        found = hit if found is None else F.coalesce(found, hit)
    return rows.withColumn("i", found).filter("i is not null").select(key, "ord", "i.kind", "i.source")


def most_severe(decisions: DataFrame, by: str) -> DataFrame:
    """by, action (rank), reason and guard_required: the greatest action, the reasons of the decisions that have it, in order.

    The greatest action is found first, and only its decisions go on.
    """
    top = decisions.groupBy(by).agg(F.max("action").alias("action"), F.bool_or("guard_required").alias("guard_required"))
    own = decisions.select(by, "action", "ord", "reason").join(top.select(by, "action"), [by, "action"])
    reasons = own.distinct().groupBy(by).agg(F.array_sort(F.collect_list(F.struct("ord", "reason"))).alias("all"))
    return top.join(reasons, by).select(by, "action", F.array_join(F.transform("all", lambda x: x["reason"]), "; ").alias("reason"), "guard_required")


def trust_gate(risky: DataFrame, trusted: DataFrame) -> DataFrame:
    """report_id and allowed: whether every risky digest of a report is trusted."""
    known = trusted.select("digest").distinct().withColumn("_t", F.lit(True))
    return risky.join(known, "digest", "left").groupBy("report_id").agg(F.bool_and(F.coalesce("_t", F.lit(False))).alias("allowed"))


def decide(found: DataFrame, reports: DataFrame, trusted: DataFrame, key: str = "command_id") -> DataFrame:
    """found (key, ord, kind, source) with action, reason and guard_required: by the verdict of the source's report.

    reports has a row a source (source, verdict, digest). A source whose digest
    is trusted is allowed, one without a report is asked about, and a command
    that touches the guard itself is denied.
    """
    known = trusted.select("digest").distinct().withColumn("_t", F.lit(True))
    rows = found.join(reports.select("source", "verdict", "digest"), "source", "left").join(known, "digest", "left")
    tamper, trusts = F.col("kind") == "tamper", F.coalesce("_t", F.lit(False))
    action = F.when(tamper, 2).when(trusts, 0).when(F.col("verdict").isNull(), 1).otherwise(F.col("verdict"))
    why = F.when(tamper, "touches the guard").when(trusts, "trusted").when(F.col("verdict").isNull(), "not scanned").otherwise(F.element_at(F.array(*[F.lit(f"verdict {v}") for v in VERDICTS]), F.col("verdict") + 1))
    return rows.select(key, "ord", "kind", "source", action.cast("int").alias("action"), F.concat_ws(": ", "source", why).alias("reason"), tamper.alias("guard_required"))


#: Kinds whose content changes only as the command runs, so it can't be scanned before: they run under the guard alone. Fixed values.
UPDATES = ["git-update"]
MOST_REASONS = 3


def decide_commands(commands: DataFrame, reports: DataFrame, trusted: DataFrame, guarded: bool = False, key: str = "command_id", command: str = "command") -> DataFrame:
    """key, action, reason and guard_required of whole commands, a row a command.

    A command without installs is allowed. One that also touches the guard is
    refused with all its installs, whatever their reports say. An update can't
    be scanned before it runs: without the guard around it (guarded) it is
    refused, with it allowed. Else the gravest install decides, and its first
    reasons are given. A command has as many installs as simple commands.
    """
    found = decide(intents(commands, key, command), reports, trusted, key)
    update = F.col("kind").isin(*UPDATES)
    action = F.when(update, 0 if guarded else 2).otherwise(F.col("action"))
    reason = F.when(update, F.concat(F.lit("can only be scanned as it lands"), F.lit("" if guarded else ", so it has to run under the guard"))).otherwise(F.col("reason"))
    rows = found.select(key, "ord", (F.col("kind") == "tamper").alias("_tamper"), update.alias("_update"), action.alias("action"), reason.alias("reason"))
    per = rows.groupBy(key).agg(
        F.bool_or("_tamper").alias("_tampered"), F.bool_and("_tamper").alias("_only"), F.bool_or("_update").alias("guard_required"), F.max("action").alias("_top"), F.array_sort(F.collect_list(F.struct((-F.col("action")).alias("a"), "ord", "reason"))).alias("_all")
    )
    gravest = F.transform(F.slice(F.filter("_all", lambda x: x["a"] == -F.col("_top")), 1, MOST_REASONS), lambda x: x["reason"])
    refused = F.col("_tampered") & ~F.col("_only")
    told = F.when(refused, "touches the guard that its installs rely on").when(F.col("_top") == 0, "").otherwise(F.array_join(gravest, "; "))
    decided = per.select(key, F.when(refused, 2).otherwise(F.col("_top")).alias("_action"), told.alias("_reason"), "guard_required")
    every = commands.select(key).distinct().join(decided, key, "left")
    return every.select(key, F.coalesce("_action", F.lit(0)).cast("int").alias("action"), F.coalesce("_reason", F.lit("")).alias("reason"), F.coalesce("guard_required", F.lit(False)).alias("guard_required"))


def flagged_untrusted(flagged: DataFrame, trusted: DataFrame) -> DataFrame:
    """Flagged entries (path, digest) less those whose digest is trusted."""
    return flagged.join(trusted.select("digest").distinct(), "digest", "left_anti")


def quarantinable(installed: DataFrame, trusted: DataFrame) -> DataFrame:
    """Installed (kind, digest, verdict rank) that may be moved away: blocked skills whose digest nobody trusts; no kind counts as a skill."""
    blocked = installed.filter((F.col("verdict") == 2) & (F.coalesce("kind", F.lit("skill")) == "skill"))
    return blocked.join(trusted.select("digest").distinct(), "digest", "left_anti").select(*installed.columns)


def edited(text: Column, edits: Column) -> Column:
    """text after edits, an array of structs of old, new and every (all places, else the first), in order.

    Null where one can't be applied: old is empty or absent from the text. On a
    null text, an edit of an empty old makes the file.
    """

    def step(now: Column, e: Column) -> Column:
        at = F.position(e["old"], now["text"])
        once = F.concat(F.left(now["text"], at - 1), e["new"], F.substr(now["text"], at + F.length(e["old"])))
        done = F.when(now["text"].isNull(), F.when(e["old"] == "", e["new"])).when((e["old"] != "") & (at > 0), F.when(e["every"], F.replace(now["text"], e["old"], e["new"])).otherwise(once))
        return F.struct(F.when(now["applies"], done).alias("text"), (now["applies"] & done.isNotNull()).alias("applies"))

    return F.aggregate(edits, F.struct(text.alias("text"), F.lit(True).alias("applies")), step)["text"]


def with_writes(files: DataFrame, writes: DataFrame) -> DataFrame:
    """files (bundle_id, path, text) as they would be after writes, of the same columns with one row a path: what a scan before the write reads."""
    return files.join(writes.select("bundle_id", "path"), ["bundle_id", "path"], "left_anti").select("bundle_id", "path", "text").unionByName(writes.select("bundle_id", "path", "text"))
