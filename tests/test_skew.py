"""A key with a third of all rows: joins are split, and nothing is lost."""

import pytest
from pyspark.sql import functions as F

from reviewloom.operators import durable, stats
from reviewloom.operators import entity_vectors as E

# Low limits, so that small data counts as skewed and is not broadcast.
LIMITS = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20kb",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20kb",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
    "spark.sql.shuffle.partitions": "16",
}


@pytest.fixture
def skewed_session(spark, monkeypatch):
    monkeypatch.setattr(durable.lookup, "__defaults__", (0,))
    monkeypatch.setattr(durable.stored_lookup, "__defaults__", (0,))
    before = {name: spark.conf.get(name, None) for name in LIMITS}
    for name, value in LIMITS.items():
        spark.conf.set(name, value)
    yield spark
    for name, value in before.items():
        if value is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, value)


def final_plan(df, capsys):
    df.explain()
    return capsys.readouterr().out


def test_statistics_of_a_hot_group(skewed_session, capsys):
    rows = skewed_session.range(0, 60000, numPartitions=8).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 500).alias("g"),
        (F.col("id") % 7).alias("r"),
        F.sha2(F.col("id").cast("string"), 256).alias("text"),
    )
    scored = stats.group_z_scores(rows, "g", "r")
    assert len(scored.collect()) == 60000
    assert "skew=true" in final_plan(scored, capsys)


def test_leave_one_out_of_a_hot_business(skewed_session, capsys):
    size = 8
    rows = skewed_session.range(0, 6000, numPartitions=8).select(
        (F.col("id") % 900).alias("user_id"),
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 200).alias("business_id"),
        F.col("id").alias("review_id"),
        F.lit(1.0).alias("user_weight"),
        F.lit(1.0).alias("business_weight"),
        F.array(*[(F.col("id") % (i + 2)).cast("double") for i in range(size)]).alias("vec"),
    )
    sums = E.ReviewSums(rows, {}, size)
    pairs = E.leave_one_out(sums, ["business"])
    found = {row["review_id"]: row["business_vec"] for row in pairs.collect()}
    assert len(found) == 6000
    assert "skew=true" in final_plan(pairs, capsys)
    hot = [i for i in range(6000) if i % 3 == 0 or i % 200 == 0]
    total = sum(i % 2 for i in hot)
    assert found[3][0] == pytest.approx((total - 1) / (len(hot) - 1))
