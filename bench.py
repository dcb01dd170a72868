"""Time the headline queries and print one JSON line.

Every query is run over its whole tables; all rows are computed and dropped. The given tables are one file
each, which one task reads. They are laid out in as many files as there are cores first, as the tables of a
cluster are; that copy is not timed with the queries, and its seconds are printed. The first run of a query
is the headline: it also compiles the plans. The second run is beside it.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from counterfact.session import get_session  # noqa: E402
from counterfact.staging import new_folder  # noqa: E402
from registry.queries import QUERIES  # noqa: E402

HEADLINES = (
    "swap_terms",
    "env_assign",
    "single_hit_filter",
    "fit_per_env",
    "bias_cell",
    "bias_grid",
    "line_bias",
    "model_eval",
    "build_vocab",
    "encode_tokens",
    "pack_blocks",
    "mlm_mask",
    "shuffled_batches",
    "round_robin_schedule",
    "running_epoch_loss",
    "best_checkpoint",
)
TABLES = ("documents", "conversations", "benchmark", "events")


def laid_out(spark, sf_dir: str) -> str:
    """Folder with the tables of the headline queries in as many files as there are cores."""
    folder = new_folder(spark, "tables")
    for table in TABLES:
        rows = spark.read.parquet(f"{sf_dir}/{table}.parquet")
        rows.repartition(spark.sparkContext.defaultParallelism).write.parquet(f"{folder}/{table}.parquet")
    return folder


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = sys.argv[1:] or HEADLINES
    spark = get_session("bench")
    spark.sparkContext.setLogLevel("ERROR")
    start = time.perf_counter()
    folder = laid_out(spark, sf_dir)
    layout = round(time.perf_counter() - start, 3)
    first, again = {}, {}
    for name in names:
        for attempt in (first, again):
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            attempt[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline queries, total of first runs",
                "value": round(sum(first.values()), 3),
                "unit": "sec",
                "queries": first,
                "second_run": again,
                "layout_sec": layout,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
