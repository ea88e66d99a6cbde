"""Write the final (adaptive) physical plans of key queries to docs/PLANS.md.

Usage: python tools/plans.py [sf_dir]
Each query is executed once (collect) so the adaptive plan shows the
runtime choices (broadcast vs sort-merge, coalesced partitions).
"""
from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

KEY = ["j1_num_indiv", "j2_indiv_semi_join", "a4_mean_median", "r3_stratified_kfold", "r2_upsample",
       "e4_one_hot", "e1_standardize_own", "v7_roc_auc", "a14_class_kde", "a17_mean_over_folds"]


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    from hearth.catalog import REGISTRY
    from hearth.session import get_spark
    spark = get_spark("local[8]", 8)
    out = ["# Physical plans of key queries", "",
           f"Final adaptive plans after one execution at `{os.path.basename(sf)}` on local[8] "
           "(generated by `tools/plans.py`).", ""]
    for name in KEY:
        df = REGISTRY[name].fn(spark, sf)
        df.collect()
        plan = spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
        head = plan.split("\n\n(1)")[0]
        out += [f"## {name}", "", (REGISTRY[name].fn.__doc__ or "").strip(), "", "```", head.strip(), "```", ""]
    with open(os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "docs", "PLANS.md"),
              "w") as f:
        f.write("\n".join(out))
    spark.stop()


if __name__ == "__main__":
    main()
