"""Time headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import time

from surfparc.plans.queries import QUERIES
from surfparc.session import local_session

HEADLINE = [
    "bold_zscore", "run_mean_correlation", "run_correlation_profile", "fc_similarity", "top_fraction_binarize", "bit_profile_pack", "cohort_mean_profile",
    "parcel_centroids", "soft_assign", "argmax_labels", "weighted_group_sum", "em_cost", "assignment_round", "potts_term", "khop_neighbours", "components",
    "remove_isolated", "radius_mask", "gauss_smooth", "surface_gradient", "geodesic_distance", "mode_smallest", "cohort_merge",
    "two_sided_profile", "smoothing_weights", "watershed_labels", "connectedness", "component_distance",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session("bench", os.environ.get("BENCH_CPUS", "8"))
    QUERIES["value_extent"](spark, folder).write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    sf = folder.rstrip("/").rsplit("sf", 1)[-1]
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()
