"""Command line: ``python -m hearth submit|cv --data DIR --out DIR``.

``submit``: the all-countries driver (household sizes staged once, one model
per country, test households scored) written as one CSV with a header
``id,country,poor``. ``cv``: stratified k-fold cross-validation of every
country's recipe, metrics written as JSON rows ``(country, fold, metric, value)``.
``--recipes reference`` reads the survey's own files
``{A,B,C}_{hhold,indiv}_{train,test}.csv`` in the data folder and runs the
reference's recipes on them. Run it with spark-submit on a cluster (the cluster's configuration is kept)
or locally with ``--master local[8]``.
"""

from __future__ import annotations

import argparse

from pyspark.sql import functions as F

from hearth.operators import schema
from hearth.plans import cv, train
from hearth.plans.recipes import reference_recipes, standin_recipes
from hearth.session import get_spark
from hearth.sources import io, tables


def main(argv: list[str] | None = None) -> None:
    ap = argparse.ArgumentParser(prog="hearth")
    ap.add_argument("command", choices=["submit", "cv"])
    ap.add_argument("--data", required=True, help="folder with the input parquet tables")
    ap.add_argument("--out", required=True, help="output folder (shared storage on a cluster)")
    ap.add_argument("--master", default=None, help="e.g. local[8]; unset under spark-submit")
    ap.add_argument("--trees", type=int, default=None, help="override the recipes' number of trees")
    ap.add_argument("--folds", type=int, default=3)
    ap.add_argument("--recipes", choices=["standin", "reference"], default="standin")
    args = ap.parse_args(argv)

    spark = get_spark(args.master)
    if args.recipes == "reference":
        recipes = reference_recipes()
        for r in recipes.values():
            r.model |= {"n_estimators": args.trees} if args.trees else {}
        if args.command == "submit":
            io.write_submission(train.submit_survey(spark, args.data, recipes), args.out)
        else:
            out = schema.union_frames([
                cv.cross_validate(r, train.read_country(spark, args.data, r.country, "hhold").where(
                    F.col("_split") == "train"), train.read_country(spark, args.data, r.country, "indiv").drop("_split"),
                    k=args.folds) for r in recipes.values()])
            io.write_metrics(out, args.out, fmt="json")
        return
    recipes = standin_recipes({"n_estimators": args.trees} if args.trees else None)
    hh, ind = tables.households(spark, args.data), tables.individuals(spark, args.data)
    if args.command == "submit":
        io.write_submission(train.run_all(recipes, hh, ind, parallel=True), args.out)
    else:
        tr = hh.where(F.col("_split") == "train")
        frames = [cv.cross_validate(r, tr, ind, k=args.folds) for r in recipes.values()]
        out = frames[0]
        for f in frames[1:]:
            out = out.unionByName(f)
        io.write_metrics(out, args.out, fmt="json")


if __name__ == "__main__":
    main()
