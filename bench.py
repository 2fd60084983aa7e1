"""Headline timings: one JSON line.

Shared stages (input entities, snapshot views) are built once and timed on their own as ``prepare``;
``screen_formulations`` builds everything below the entities again.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from assayer.plans import adapters, registry  # noqa: E402
from assayer.session import build_session  # noqa: E402

HEADLINE = (
    "screen_formulations",
    "formulation_summary",
    "evaluate_rules",
    "compare_snapshots",
    "normalize_rules",
    "normalize_names",
    "ranked_catalogue_search",
    "duplicate_rows",
    "stitch_continuation_rows",
    "words_to_glossary_rows",
    "upload_cells",
    "ground_references",
    "apply_answers",
    "session_expiry",
    "revision_conflicts",
    "stream_sessions",
)
ENTITIES = ("rules", "substances", "catalogue", "ingredients", "records", "grid_rows")


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]", **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = registry.queries()
    seconds: dict[str, float] = {}
    started = time.time()
    for name in ENTITIES:
        adapters.entity(spark, folder, name)
    seconds["prepare"] = round(time.time() - started, 3)
    for name in HEADLINE:
        started = time.time()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - started, 3)
    total = round(sum(seconds.values()), 3)
    print(
        json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": seconds, "sf": os.path.basename(folder)})
    )
    spark.stop()


if __name__ == "__main__":
    main()
