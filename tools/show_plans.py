"""Print the physical plans of the headline queries (``explain`` after the
query ran, so AQE's final plan is shown) into docs/PLANS.md.

usage: python tools/show_plans.py [sf_dir]
"""

from __future__ import annotations

import os
import re
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

NAMES = ["filter_version_locale", "unique_products", "embed_hashed", "knn_flat", "search_flat",
         "knn_ivf", "bm25_pairs", "eval_metrics", "error_breakdown_rows"]


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    from quarry.plans import registry as R
    from quarry.session import local_session
    spark = local_session(8, 8)
    out = ["# Physical plans (final AQE plans after execution, sf0.01)\n",
           "Generated by `tools/show_plans.py`. Scratch paths are shortened.\n"]
    for name in NAMES:
        df = R.QUERIES[name](spark, sf_dir)
        df.write.format("noop").mode("overwrite").save()
        plan = df._jdf.queryExecution().executedPlan().toString()
        plan = re.sub(r"file:/[^\]\s,]*quarry/", "<shared>/", plan)
        plan = re.sub(r"#\d+L?", "", plan)
        out.append(f"## {name}\n\n```\n{plan.strip()}\n```\n")
    os.makedirs(os.path.join(ROOT, "docs"), exist_ok=True)
    with open(os.path.join(ROOT, "docs", "PLANS.md"), "w") as f:
        f.write("\n".join(out))
    spark.stop()


if __name__ == "__main__":
    main()
