"""The reviewer's answers, addressed by content: what has been asked of a text under a policy is never asked again.

An answer's key is a hash of the text it was about, the question and the
policy, so a moved or renamed text keeps its answers, and a changed text, rule
or setting asks anew. Answers are keyed state in hash buckets: recording some
rewrites their buckets alone, and looking some up reads theirs alone.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.operators.catalog import RULES, Rule
from siftwell.operators.judge import DOWNLOAD_PROBE, INTENT_PROBES, PROBE_FOR_CATEGORY
from siftwell.streaming import keyed

#: The questions: one a probe of review, one a probe of intent, and that about downloads.
QUESTIONS = [*sorted(set(PROBE_FOR_CATEGORY.values())), *INTENT_PROBES, DOWNLOAD_PROBE]
SCHEMA = "key string, state_hash string, question string, policy string, p double, asked_at long"
BUCKETS = 256


def policy_fingerprint(settings: dict, rules: list[Rule] = RULES, version: str = "1") -> str:
    """What a cached result depends on besides content: version, rules with their grades, and the user's settings."""
    said = {"version": version, "rules": [[r.id, r.sev, r.conf] for r in rules], "settings": settings}
    return hashlib.sha256(json.dumps(said, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def answer_key(state_hash: Column, question: Column, policy: str) -> Column:
    return F.sha2(F.concat_ws("\n", state_hash, question, F.lit(policy)), 256)


def asked(states: DataFrame, policy: str, questions: list[str] = QUESTIONS) -> DataFrame:
    """key, state_hash, question and policy of every question about each different state; states without a hash are asked nothing."""
    rows = states.filter(F.col("state_hash").isNotNull()).select("state_hash").distinct().select("state_hash", F.explode(F.array(*[F.lit(q) for q in questions])).alias("question"))
    return rows.select(answer_key(F.col("state_hash"), F.col("question"), policy).alias("key"), "state_hash", "question", F.lit(policy).alias("policy"))


def known(spark: SparkSession, path: str, number: int) -> DataFrame:
    """All answers recorded up to batch `number` (below 0: none)."""
    return keyed.state(spark, path, number, SCHEMA)


def to_ask(states: DataFrame, policy: str, path: str, number: int, questions: list[str] = QUESTIONS) -> DataFrame:
    """The questions (see asked) that no answer recorded up to batch `number` covers."""
    return asked(states, policy, questions).join(known(states.sparkSession, path, number).select("key"), "key", "left_anti")


def record(answers: DataFrame, path: str, number: int) -> None:
    """Record answers (see SCHEMA) as batch `number`; of two to one question the later counts. Recording a batch again changes nothing."""
    keyed.merge_batch(answers.select("key", "state_hash", "question", "policy", "p", "asked_at"), number, path, "key", ["asked_at", "p"], BUCKETS)


def probes(states: DataFrame, policy: str, path: str, number: int) -> DataFrame:
    """bundle_id, probe and p of the recorded answers to each bundle's state (bundle_id, state_hash), as doubt, threat_scores and replay take them."""
    answers = known(states.sparkSession, path, number).filter(F.col("policy") == policy)
    return states.select("bundle_id", "state_hash").join(answers.select("state_hash", F.col("question").alias("probe"), "p"), "state_hash").select("bundle_id", "probe", "p")
