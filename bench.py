"""Time the headline queries and print one JSON line.

    BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8)
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "security_findings", "pack_findings", "js_loop_findings", "ast_findings", "import_findings_js",
    "scan_summary", "scan_findings", "project_context", "deep_findings", "persona_findings", "persona_signals",
    "file_index", "top_files", "incremental_files", "quality_delta", "lifecycle", "unsuppressed_findings",
    "fidelity", "journey_scores", "step_history", "file_reviews", "report_markdown",
]


def main() -> None:
    from sievework.plans.catalog import QUERIES
    from sievework.session import get_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_session(
        "bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        t = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - t

    run("security_findings")  # start the JVM's and Python's machinery
    times = {name: round(min(run(name), run(name)), 3) for name in HEADLINE}
    sf = re.search(r"sf([0-9.]+)", sf_dir)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                "queries": times, "sf": float(sf.group(1)) if sf else sf_dir,
            }
        )
    )


if __name__ == "__main__":
    main()
