"""A PySpark-native engine that scans corpora of text bundles; see README.

The names below are what most jobs need; `siftwell.llm` stands by itself.
"""

from siftwell.operators.catalog import RULES, Rule
from siftwell.operators.scan import as_files, scan_bundles
from siftwell.operators.target import Scan, scan_files, scan_folder
from siftwell.session import local_session
from siftwell.sources.bundles import read_tree
from siftwell.sources.selection import read_selected

__all__ = ["RULES", "Rule", "Scan", "as_files", "local_session", "read_selected", "read_tree", "scan_bundles", "scan_files", "scan_folder"]
