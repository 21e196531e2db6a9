"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the tables, BENCH_CPUS the cores, BENCH_QUERIES (comma separated, or
"all") the queries. Every query runs to its last row into a sink that keeps nothing.
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = ("haversine_haul box_filter point_in_polygon zonal_balance planar_distance_join "
            "spherical_distance_join orders_near_supplier nearest_others nearest_suppliers "
            "square_counts hex_counts density moran local_moran ripley variogram dbscan "
            "track_steps stays raster_focal").split()


def main() -> None:
    from plumbgrid.plans import QUERIES
    from plumbgrid.session import local_session

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    wanted = os.environ.get("BENCH_QUERIES", "")
    names = list(QUERIES) if wanted == "all" else wanted.split(",") if wanted else HEADLINE
    QUERIES["group_extents"](spark, folder).collect()
    times = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "total_query_time", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": os.path.basename(folder.rstrip("/"))}))


if __name__ == "__main__":
    main()
