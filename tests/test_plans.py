"""What the plans of large joins leave out."""

from __future__ import annotations

import duckdb
from pyspark.sql import functions as F

from tessera.operators import relational
from tessera.plans import registry
from tests.compare import assert_same
from tests.conftest import SF


def _plan(spark, name: str) -> str:
    return registry.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()


def test_names_normalised_once(spark):
    """One normalisation a side, before the join."""
    plan = _plan(spark, "X81_evaluation")
    assert plan.count("[^a-z0-9& ]") == 2 and "[^a-z0-9& ]" not in plan.split("Join")[0]


def test_lone_words_stay(spark):
    """Both sides of the join by domain and word hold only words of several candidates."""
    plan = _plan(spark, "J7_N3_inferred_relationships")
    assert plan.count("> 1)") == 2 and plan.count("RepartitionByExpression") == 2


def test_attempts_dealt(spark, duck, monkeypatch):
    """The mappings and attempts of one domain meet in several tasks, small inputs are not packed into one, and no row is lost or doubled."""
    monkeypatch.setattr(relational, "ATTEMPTS", 1, raising=False)
    name = "J2_mappings_with_attempts"
    df = registry.queries()[name](spark, SF)
    assert df.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    tasks = df.withColumn("task", F.spark_partition_id()).groupBy("domain").agg(F.count_distinct("task").alias("n"))
    assert tasks.agg(F.max("n")).first()[0] > 1
    assert_same(df, duck, registry.oracle_sql()[name])


def test_mappings_dealt(spark):
    """A domain with few attempts has its mappings in several tasks all the same."""
    df = registry.queries()["J2_mappings_with_attempts"](spark, SF).withColumn("task", F.spark_partition_id())
    assert df.groupBy("domain").agg(F.count_distinct("task").alias("n")).agg(F.max("n")).first()[0] > 1


def test_attempts_without_id_dealt(spark, tmp_path, monkeypatch):
    """Attempts that no id tells apart, all of one domain, meet its mappings in several tasks, each of them once."""
    table = lambda name: spark.read.parquet(f"{SF}/{name}.parquet")
    orders = table("orders").withColumn("o_custkey", F.lit(1).cast("bigint")).withColumn("o_orderkey", F.when(F.col("o_orderkey") % 6 != 4, F.col("o_orderkey")))
    changed = {"orders": orders, "customer": table("customer").filter("c_custkey = 1").withColumn("c_mktsegment", F.lit("AUTOMOBILE"))}
    con = duckdb.connect()
    for name in ("orders", "customer", "lineitem", "supplier", "nation"):
        changed.get(name, table(name)).write.parquet(f"{tmp_path}/{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    monkeypatch.setattr(relational, "ATTEMPTS", 5)
    monkeypatch.setattr(relational, "SHARES", 1, raising=False)
    name = "J2_mappings_with_attempts"
    df = registry.queries()[name](spark, str(tmp_path))
    assert df.filter("id IS NULL").select(F.spark_partition_id()).distinct().count() > 1
    assert_same(df, con, registry.oracle_sql()[name])
