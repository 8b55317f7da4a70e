"""``python -m surfparc <project>``: run a project from its configuration and tables."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from surfparc.plans.pipeline import Pipeline
from surfparc.sources.project import read_prior

INPUTS = ("bold", "vertices", "faces", "coarse_vertices", "coarse_faces", "group_vertices", "group_faces", "theta", "parcel")


def main() -> None:
    p = argparse.ArgumentParser(prog="surfparc")
    p.add_argument("project", help="folder with pipeline_config.json and an inputs/ folder of Parquet tables")
    p.add_argument("--seed-order", type=int, default=3, help="subdivision order of the seed mesh")
    p.add_argument("--seeds", type=int, required=True, help="number of cortical seed vertices")
    p.add_argument("--prior", help="project folder of the training run whose prior is used")
    args = p.parse_args()
    spark = SparkSession.builder.appName("surfparc").getOrCreate()
    found = {}
    for name in INPUTS:
        try:
            found[name] = spark.read.parquet(f"{args.project}/inputs/{name}")
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e):
                raise
    if args.prior:
        found |= read_prior(spark, args.prior)
    Pipeline(spark, args.project).run(found, args.seed_order, args.seeds)


if __name__ == "__main__":
    main()
