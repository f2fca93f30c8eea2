"""What Spark gives anyway, over the star schema and the events: windows, rollups, joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkkb.session import scratch_path, table
from sparkkb.sources.files import split_urls
from sparkkb.streaming import jobs


def event_tumbling_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def event_window_stream(spark, sf_dir):
    """The same windows as a stream over the event file, run to its end; the last windows stay open in append mode, so complete mode is used."""
    out, state = scratch_path(spark, "windows"), scratch_path(spark, "state")
    events = spark.readStream.schema(table(spark, sf_dir, "events").schema).option("pathGlobFilter", "events*.parquet").parquet(sf_dir)
    jobs.run_to_end(jobs.windowed_counts(events), out, state, "complete", lambda batch, _: batch.write.mode("overwrite").parquet(out))
    return spark.read.parquet(out).select("start", "event_type", "n", F.round("total", 4).alias("total"))


def rollup_sales(spark, sf_dir):
    l, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    joined = l.join(o, l["l_orderkey"] == o["o_orderkey"])
    return joined.rollup("o_orderpriority", "l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


def revenue_by_nation(spark, sf_dir):
    l, o, c, s, n, r = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer", "supplier", "nation", "region"))
    local = l.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(s, (F.col("l_suppkey") == F.col("s_suppkey")) & (F.col("c_nationkey") == F.col("s_nationkey")))
    return local.join(n, F.col("s_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name", "n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


def part_brands(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("p_retailprice"), 4).alias("mean_price"), F.max("p_size").alias("most"))


def url_lists(spark, sf_dir):
    """Link lists made of each reference's targets, parted again."""
    r = table(spark, sf_dir, "knowledge_file_reference").select("kid", F.concat(F.lit("https://a.example/"), "kid", F.lit("?x=1,2, http://b.example/"), "kid", F.lit(" (NOT REQUIRED for this).")).alias("urls"))
    return r.select("kid", F.posexplode(split_urls(F.col("urls"))).alias("place", "url"))


def queries() -> dict:
    return {f.__name__: f for f in (event_tumbling_window, event_window_stream, rollup_sales, revenue_by_nation, part_brands, url_lists)}


def oracle_sql() -> dict[str, str]:
    windows = "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL"
    return {
        "event_tumbling_window": windows,
        "event_window_stream": windows,
        "rollup_sales": "SELECT o_orderpriority, l_returnflag, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ROLLUP (o_orderpriority, l_returnflag)",
        "revenue_by_nation": "SELECT r_name, n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL",
        "part_brands": "SELECT p_brand, count(*) AS n, round(avg(p_retailprice), 4) AS mean_price, max(p_size) AS most FROM part GROUP BY ALL",
        "url_lists": "SELECT kid, p::int AS place, CASE p WHEN 0 THEN 'https://a.example/' || kid || '?x=1,2' ELSE 'http://b.example/' || kid END AS url FROM knowledge_file_reference, (VALUES (0), (1)) v(p)",
    }
