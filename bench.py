"""Bench: headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``, one JSON line.

Times are from building the plan to the last row written to a sink that drops rows."""

from __future__ import annotations

import json
import os
import sys
import time

from catalog.queries import QUERIES
from quadloom.session import local_session

HEADLINE = (
    "cell_reading_relational",
    "cell_reading_nested",
    "alignment_steps_relational",
    "alignment_steps_nested",
    "cell_independent_parts",
    "cell_fresh_nodes",
    "graph_pattern_match",
    "jsonld_read",
    "jsonld_write_payload",
    "channel_routing",
    "functions_arithmetic",
    "registry_add_channels",
    "quality_report",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    names = sys.argv[1:] or HEADLINE
    # One warm-up query, so that the first measured one does not pay for starting the session.
    QUERIES["registry_key_hash"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    took = {}
    for name in names:
        start = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - start, 2)
        print(name, took[name], file=sys.stderr, flush=True)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "total time of the headline queries", "value": round(sum(took.values()), 2), "unit": "sec", "queries": took, "sf": sf}))


if __name__ == "__main__":
    main()
