import math

from pyspark.sql import functions as F

from conftest import NODE_SCHEMA
from holdnet.operators import split


def test_group_split_whole_groups(spark):
    data = [(f"n{i}", (f"G{i % 13}" if i % 10 else None), "F", 1.0, "s", "small") for i in range(400)]
    nodes = spark.createDataFrame(data, NODE_SCHEMA)
    out = split.group_split(nodes)
    assert out.count() == 400
    per_group = out.groupBy(F.coalesce("grupo", F.lit("no_grupo")).alias("g")).agg(
        F.countDistinct("conjunto").alias("k"), F.first("conjunto").alias("c")).collect()
    assert all(r["k"] == 1 for r in per_group)
    n_units = len(per_group)
    assert sum(1 for r in per_group if r["c"] == "train") == math.floor(n_units * 0.8)
    again = {r["nodo"]: r["conjunto"] for r in split.group_split(nodes).collect()}
    assert again == {r["nodo"]: r["conjunto"] for r in out.collect()}


def test_one_hot_null_gives_zeros(spark):
    df = spark.createDataFrame([("a", "x"), ("b", None), ("c", "y")], "nodo string, sector string")
    out = {r["nodo"]: r for r in split.one_hot(df, ["sector"]).collect()}
    assert (out["a"]["sector_x"], out["a"]["sector_y"]) == (1, 0)
    assert (out["b"]["sector_x"], out["b"]["sector_y"]) == (0, 0)
    assert "sector" not in split.one_hot(df, ["sector"]).columns
