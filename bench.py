"""Bench: headline queries at $BENCH_SF_DIR (default /root/testdata/sf0.1) on
local[$BENCH_CPUS]; prints one JSON line.

Each query is fully evaluated: every output column is folded into one
checksum (so nothing is pruned away), timed after one warm-up of the JVM.
"""
from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from quillmask.plans.catalog import QUERIES  # noqa: E402
from quillmask.session import local_session  # noqa: E402

HEADLINE = ["anonymize_text", "tokenize", "annotate_rare_ngrams", "weighted_sentence_vec", "prf",
            "mask_text", "corpus_stats", "project_spans"]


def run(df):
    h = F.pmod(F.xxhash64(F.to_json(F.struct(*df.columns))), F.lit(1 << 31))
    return df.select(h.alias("h")).agg(F.sum("h"), F.count(F.lit(1))).collect()


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, partitions=int(cpus) * 2 if cpus.isdigit() else 16, app="quillmask-bench")
    run(QUERIES["tokenize"](spark, sf_dir))  # warm-up (JIT, file listing)
    times = {}
    for name in names:
        t0 = time.time()
        run(QUERIES[name](spark, sf_dir))
        times[name] = round(time.time() - t0, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "total_headline_query_time", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": float(m.group(1)) if m else sf_dir}))


if __name__ == "__main__":
    main()
