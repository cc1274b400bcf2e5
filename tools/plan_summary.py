"""Physical-plan summary of queries: exchanges, broadcasts, scan schemas.

    python tools/plan_summary.py [sf_dir] [name ...]
"""
from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def main():
    from quillmask.plans.catalog import QUERIES
    from quillmask.session import local_session
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or ["anonymize_text", "tokenize", "annotate_rare_ngrams", "weighted_sentence_vec",
                              "prf", "mask_text", "corpus_stats", "project_spans"]
    spark = local_session(8)
    for n in names:
        df = QUERIES[n](spark, sf)
        plan = df._jdf.queryExecution().executedPlan().toString()
        ex = len(re.findall(r"Exchange (hashpartitioning|rangepartitioning|SinglePartition|RoundRobin)", plan))
        bc = plan.count("BroadcastExchange")
        schemas = sorted(set(re.findall(r"ReadSchema: (struct<[^>]*>)", df._jdf.queryExecution().explainString(
            spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")))))
        print(f"{n:26s} shuffles={ex} broadcasts={bc} scans={schemas}")


if __name__ == "__main__":
    main()
