"""Times the headline queries on local[$BENCH_CPUS] over $BENCH_SF_DIR and prints one JSON line.

`queries` are the library's times, `by_hand` those of the same results by Spark SQL written by hand, taken in turn with them.
"""

import json
import os
import time

from pyspark.sql import SparkSession

from sedge.plans import registry

#: The headline queries, as one would write them in Spark SQL.
BY_HAND = {
    "q1_pricing_summary": "SELECT l_returnflag, l_linestatus, count(*) n, round(sum(l_quantity), 2) qty, round(avg(l_discount), 6) disc FROM lineitem WHERE l_quantity < 40 GROUP BY 1, 2",
    "summ_stats": """SELECT l_suppkey, round(median(l_extendedprice), 4) med, round(stddev_samp(l_quantity), 6) sd, round(var_samp(l_quantity), 5) va, min(l_quantity) lo, max(l_quantity) hi,
        count(DISTINCT l_partkey) parts, count_if(l_discount > 0.05) deep FROM lineitem GROUP BY 1""",
    "join_inner_star": "SELECT n_name, count(*) n, round(sum(o_totalprice), 2) total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1",
    "grouped_mutate_mean": "SELECT l_orderkey, l_linenumber, round(l_extendedprice - avg(l_extendedprice) OVER (PARTITION BY l_suppkey), 4) dev FROM lineitem",
    "windows_ordered": """SELECT user_id, event_id, lag(value) OVER w a, lead(value, 2, 0.0) OVER w b, row_number() OVER w r, round(sum(value) OVER u, 3) s, min(value) OVER u lo, max(value) OVER u hi
        FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id), u AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""",
    "slice_max_ties": "SELECT p_size, p_partkey FROM (SELECT *, rank() OVER (PARTITION BY p_size ORDER BY p_retailprice DESC) r FROM part) WHERE r <= 3",
    "arrange_head": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20",
    "pivot_wider": """SELECT o_orderpriority, coalesce(F, 0) F, coalesce(O, 0) O, coalesce(P, 0) P FROM (SELECT o_orderpriority, o_orderstatus FROM orders)
        PIVOT (count(*) FOR o_orderstatus IN ('F' F, 'O' O, 'P' P))""",
}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "6g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    tables = ("lineitem", "orders", "customer", "nation", "events", "part")

    def by_sql(sql):
        for table in tables:  # the library reads its tables in each query, too
            if table in sql:
                spark.read.parquet(f"{sf_dir}/{table}.parquet").createOrReplaceTempView(table)
        return spark.sql(sql)

    own, by_hand = {}, {}
    for name, sql in BY_HAND.items():
        for _ in range(4):
            for times, run in ((own, lambda: registry.queries()[name](spark, sf_dir)), (by_hand, lambda: by_sql(sql))):
                began = time.perf_counter()
                run().write.format("noop").mode("overwrite").save()
                times[name] = min(times.get(name, float("inf")), time.perf_counter() - began)
    rounded = lambda times: {k: round(v, 3) for k, v in times.items()}
    print(json.dumps({"metric": "total of the best times", "value": round(sum(own.values()), 3), "unit": "sec", "queries": rounded(own), "by_hand": rounded(by_hand), "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
