"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from siftwell.llm.mixing import op10_source_mixing
from siftwell.llm.classifier import op3_quality_classifier
from siftwell.llm.conversations import OP12_SQL, op12_conversation_repair
from siftwell.llm.fill_in_middle import OP11_SQL, op11_fill_in_middle
from siftwell.llm.licenses import op5_license_scan
from siftwell.llm.near_duplicates import op9_near_duplicates
from siftwell.llm.near_duplicates_sql import OP9_SQL
from siftwell.llm.neighbours import op8_nearest_neighbours
from siftwell.llm.packing import op1_best_fit_packing
from siftwell.llm.quality import OP7_SQL, op7_quality_rules
from siftwell.llm.secret_scan import op6_secret_scan
from siftwell.llm.sharding import OP13_SQL, op13_sharding
from siftwell.llm.tokens import op2_token_output
from siftwell.llm.warc import OP4_SQL, op4_warc_index

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_token_output": op2_token_output,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_warc_index": op4_warc_index,
    "op5_license_scan": op5_license_scan,
    "op6_secret_scan": op6_secret_scan,
    "op7_quality_rules": op7_quality_rules,
    "op8_nearest_neighbours": op8_nearest_neighbours,
    "op9_near_duplicates": op9_near_duplicates,
    "op10_source_mixing": op10_source_mixing,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_sharding": op13_sharding,
}
SQL: dict[str, str] = {"op4_warc_index": OP4_SQL, "op7_quality_rules": OP7_SQL, "op9_near_duplicates": OP9_SQL, "op11_fill_in_middle": OP11_SQL, "op12_conversation_repair": OP12_SQL, "op13_sharding": OP13_SQL}
