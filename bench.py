"""Times the headline queries and the data-changing statements and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, HERE)

HEADLINE = ["tpch_q01", "tpch_q03", "tpch_q04", "tpch_q05", "tpch_q10", "tpch_q15", "tpch_q17", "tpch_mq07", "clicks_count", "clicks_min_max", "clicks_avg", "clicks_point", "clicks_top_users", "join_multiway", "agg_high_cardinality", "semi_in", "anti_not_in", "top_n", "external_sort", "distinct", "dml_managed", "dml_external"]
FURTHER = ["tpch_q02", "clicks_filtered_count", "clicks_sums", "clicks_by_type", "clicks_top_texts", "clicks_top_pairs", "clicks_like_count", "clicks_like_min", "clicks_text_filter", "clicks_text_order", "clicks_time_order", "clicks_pair_sums", "clicks_all_pairs", "clicks_range"]
#: Rows of the changed table, of the joined one, and single-row inserts.
ROWS, BUCKETS, SINGLE = 20_000, 1000, 10


def changes(spark) -> dict[str, float]:
    """Seconds of each of twelve changing statements or runs of statements, each once, on a fresh database."""
    from brindle.api import Database

    value = "CAST((id * 2654435761) % 100000 AS BIGINT)"
    seconds: dict[str, float] = {}
    with tempfile.TemporaryDirectory(prefix="brindle-bench") as folder, Database(folder, spark=spark) as db:
        db.load_df(spark.range(BUCKETS).selectExpr("id AS b", "id * 7 % 1000 AS w", "concat('d', id) AS ds"), "dim")
        db.load_df(spark.range(ROWS).selectExpr("id AS fk", f"id % {BUCKETS} AS bucket", "concat('f', id) AS fs"), "fact")
        db.sql("CREATE TABLE target(k BIGINT, v BIGINT, s VARCHAR)")
        single = [f"INSERT INTO target VALUES ({ROWS + i}, {i}, 'one{i}')" for i in range(SINGLE)]
        joined = "FROM fact, dim WHERE fact.bucket = dim.b"
        keys = ", ".join(str(k) for k in range(0, 2000, 2))
        for name, statements in {
            "load": [f"INSERT INTO target SELECT id, {value}, concat('row', id) FROM range({ROWS})"],
            "update_predicate": ["UPDATE target SET v = v + 1 WHERE v < 50000"],
            "delete_predicate": ["DELETE FROM target WHERE v > 90000"],
            "update_range": ["UPDATE target SET v = 0 WHERE k >= 1000 AND k < 2000"],
            "update_in_list": [f"UPDATE target SET v = v + 1 WHERE k IN ({keys})"],
            f"insert_{SINGLE}_autocommit": single,
            f"insert_{SINGLE}_in_one_transaction": ["BEGIN", *single, "COMMIT"],
            "insert_from_join": [f"INSERT INTO target SELECT fact.fk, dim.w, fact.fs {joined} AND dim.w < 500"],
            "update_by_join": [f"UPDATE target SET v = v + 1 WHERE v > (SELECT avg(dim.w) {joined})"],
            "delete_by_join": [f"DELETE FROM target WHERE v > (SELECT max(dim.w) * 90 {joined})"],
            "update_in_join": [f"UPDATE target SET v = v + 1 WHERE k IN (SELECT fact.fk {joined} AND dim.w < 100)"],
            "delete_in_join": [f"DELETE FROM target WHERE k IN (SELECT fact.fk {joined} AND dim.w < 100)"],
        }.items():
            began = time.perf_counter()
            with db.connect() as c:
                for s in statements:
                    c.sql(s)
            seconds[name] = round(time.perf_counter() - began, 3)
    return seconds


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from brindle.plans.catalog import QUERIES
    from brindle.session import build_session

    spark = build_session("bench", f"local[{cpus}]", {"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "12g"})
    seconds = {}
    QUERIES[HEADLINE[0]](spark, sf_dir).write.format("noop").mode("overwrite").save()  # the session's own start
    for name in [*HEADLINE, *FURTHER]:
        best = float("inf")
        for _ in range(2):
            began = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            best = min(best, time.perf_counter() - began)
        seconds[name] = round(best, 3)
    total = round(sum(seconds[n] for n in HEADLINE), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": seconds, "dml": changes(spark), "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
