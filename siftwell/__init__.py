"""siftwell: a PySpark engine that sanitises untrusted web content, and operators that prepare training data."""

from .operators.urls import blocklist_rows, classify_urls, protected_table
from .plans.fetch import acquired, process_all
from .plans.pipeline import process, report_json, responses, run_summary, write_reports
from .plans.subresources import sanitise_whole
from .policy import Policy, load_policy, parse_policy
from .sources.inputs import gather, read_sized
from .sources.packs import write_packs

__all__ = [
    "Policy", "acquired", "blocklist_rows", "classify_urls", "gather", "load_policy", "parse_policy", "process", "process_all", "protected_table", "read_sized", "report_json", "responses", "run_summary",
    "sanitise_whole", "write_packs", "write_reports",
]
