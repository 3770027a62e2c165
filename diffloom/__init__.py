"""Code-change analytics on Spark; see README.md for the physical design."""

from diffloom.operators.architecture import arch_facts
from diffloom.operators.control_flow import code_flow_charts, flow_nodes
from diffloom.operators.parse import diff_lines, hunk_table, parse_patches
from diffloom.operators.pieces import piece_file_stats
from diffloom.operators.redaction import strip_files
from diffloom.operators.risk import file_risk, riskiest_files
from diffloom.operators.statistics import file_stats, file_tokens, patch_tokens, patch_totals
from diffloom.operators.symbols import symbol_table
from diffloom.plans.package import export_file_diffs, export_review_package
from diffloom.plans.reports import ReviewOptions, review_rows
from diffloom.sources.compare_report import load_report
from diffloom.sources.patches import load_patches, patch_table, read_patch_files
from diffloom.sources.snapshots import (
    as_change_set,
    compare_file_pairs,
    compare_snapshots,
    read_snapshot,
)

__all__ = [
    "ReviewOptions",
    "arch_facts",
    "as_change_set",
    "code_flow_charts",
    "compare_file_pairs",
    "compare_snapshots",
    "diff_lines",
    "export_file_diffs",
    "export_review_package",
    "file_risk",
    "file_stats",
    "file_tokens",
    "flow_nodes",
    "hunk_table",
    "load_patches",
    "load_report",
    "parse_patches",
    "patch_table",
    "patch_tokens",
    "patch_totals",
    "piece_file_stats",
    "read_patch_files",
    "read_snapshot",
    "review_rows",
    "riskiest_files",
    "strip_files",
    "symbol_table",
]
