"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the data folder, BENCH_CPUS the local cores, BENCH_QUERIES
optionally a comma-separated list of other query names. The three preparation
steps (extracts, capture, pages) are timed as entries of their own.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from cartulary import queries as registered  # noqa: E402
from cartulary.session import local_session  # noqa: E402

HEADLINE = [
    "scan_columns", "scan_foreign_keys", "scan_indexes", "relation_hashes", "snapshot_revisions", "snapshot_diff", "documentation_diff",
    "column_lines", "ddl_lines", "page_notes", "rule_warnings", "overview", "search", "search_pages", "resolve_names", "neighbors", "detail",
    "drift_verdicts", "refresh_summary", "human_context", "size_report", "ordered_children", "clean_documents", "latency_summary", "document_sizes",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    chosen = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = local_session(cores, max(int(cores), 8))
    seconds: dict[str, float] = {}

    def timed(name, action) -> None:
        start = time.time()
        action()
        seconds[name] = round(time.time() - start, 3)

    timed("prepare_extracts", lambda: registered.raw(spark, folder))
    timed("capture_snapshots", lambda: registered.snapshot(spark, folder))
    timed("prepare_pages", lambda: registered.notes(spark, folder))
    for name in chosen:
        timed(name, lambda: registered.REGISTRY[name](spark, folder).write.format("noop").mode("overwrite").save())
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": seconds, "sf": Path(folder).name.removeprefix("sf")}))


if __name__ == "__main__":
    main()
