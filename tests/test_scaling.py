"""Plans of the relation steps: what travels through their shuffles, and the same rows as the plain joins."""

import datetime
import re
import time

import pytest
from pyspark.sql import functions as F

from conftest import REL_SCHEMA, rows
from holdnet.operators import flags, joins, shares, tables
from holdnet.plans import prediction, relations
from holdnet.session import written
from holdnet.sources import fixtures as fx


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    """Small tables with a customer and a supplier listed twice, unknown and null keys."""
    d = str(tmp_path_factory.mktemp("sf"))
    day = datetime.datetime
    tabs = {
        "nation": ([(0, "N0"), (1, "N1")], "n_nationkey int, n_name string"),
        "customer": ([(1, "c1", 0, 10.0, "BUILDING"), (2, "c2", 1, 20.0, "MACHINERY"), (2, "c2", 0, 5.0, "MACHINERY"),
                      (10, "c10", 1, 7.0, "BUILDING"), (None, "c", 0, 1.0, "BUILDING")],
                     "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"),
        "supplier": ([(1, "s1", 0, 1.0), (3, "s3", 1, 2.0), (3, "s3", 0, 3.0)],
                     "s_suppkey long, s_name string, s_nationkey int, s_acctbal double"),
        "orders": ([(1, 1, day(2020, 1, 5), 9.0), (2, 2, day(2020, 2, 5), 8.0), (2, 2, day(2020, 2, 6), 8.0),
                    (3, 10, day(2020, 2, 7), 7.0), (4, None, day(2021, 3, 7), 7.0), (5, 99, None, 1.0)],
                   "o_orderkey long, o_custkey long, o_orderdate timestamp, o_totalprice double"),
        "lineitem": ([(1, 1, 1, 1, 2.0, 3.5, "N"), (1, 1, 3, 2, 2.0, 3.5, "R"), (2, 4, 3, 1, 5.0, 1.0, "R"),
                      (3, 4, None, 1, 6.0, 1.0, "N"), (4, 4, 1, 1, 6.0, 1.0, "R"), (5, 4, 77, 1, 6.0, 1.0, None)],
                     "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
                     "l_extendedprice double, l_returnflag string"),
    }
    for name, (data, schema) in tabs.items():
        spark.createDataFrame(data, schema).write.parquet(f"{d}/{name}.parquet")
    return d


@pytest.mark.parametrize("few", [0, 500_000])
def test_attributes_equal_a_join_of_each_end(spark, sf, few, monkeypatch):
    monkeypatch.setattr(fx, "BROADCAST_SUPPLIERS", few, raising=False)
    want, nodes = fx.relations_raw(spark, sf), fx.nodos(spark, sf)
    for s in ("ini", "fin"):
        want = want.join(nodes.select(F.col("nodo").alias(f"nodo_{s}"), F.col("grupo").alias(f"grupo_{s}"),
                                      F.col("situ").alias(f"situ_{s}")), f"nodo_{s}", "left")
    cols = REL_SCHEMA.replace(" string", "").replace(" int", "").replace(" double", "").split(", ")
    got = rows(fx.relaciones(spark, sf), *cols)
    assert len(got) > 6 and got == rows(want, *cols)
    edges = rows(relations.edges(spark, sf), "src", "dst", "anho_mes", "rel_id")
    assert edges == rows(tables.edge_table(want.select(*cols)), "src", "dst", "anho_mes", "rel_id")


def test_no_join_moves_whole_relations(spark, sf):
    """The relation key is made above all joins of the reader, and edges join no company attributes."""
    plan = _plan(fx.relaciones(spark, sf)).split("\n")
    first_join = next(k for k, line in enumerate(plan) if "Join" in line)
    assert any("AS rel_id" in line for line in plan[:first_join])
    assert not any("AS rel_id" in line for line in plan[first_join:])
    assert _plan(relations.edges(spark, sf)).count("Join ") == 1


REL = [("A", "B", 2020, 1, 1.0, "r1", "G", "G", "R", "N"), ("B", "A", 2020, 1, 2.0, "r2", "G", "G", "N", "R"),
       (None, "A", 2020, 1, 2.0, "r3", None, "G", None, "R"), ("A", None, 2020, 2, 2.0, "r4", "G", None, "R", None)]


def test_attach_carries_only_columns_read_later(spark):
    df = spark.createDataFrame(REL, REL_SCHEMA)
    agg = df.groupBy("nodo_ini").agg(F.count(F.lit(1)).alias("n"))
    out = tables.attach(df, agg, ["nodo_ini"]).select("rel_id", "n")
    assert rows(out) == [("r1", 2), ("r2", 1), ("r3", None), ("r4", 2)]
    assert "situ_fin" not in _plan(out).split("Join")[1].split("LogicalRDD")[0]


def test_shares_of_companies_are_shuffled_alike_at_every_size(spark, monkeypatch):
    f = flags.same_group_flag(flags.client_flag(spark.createDataFrame(REL, REL_SCHEMA)))
    small = shares.client_and_group_shares(f)
    assert "strategy=broadcast" in _plan(small) and "strategy=merge" not in _plan(small)
    monkeypatch.setattr(shares, "SMALL_ROWS", 1, raising=False)
    mixed = shares.client_and_group_shares(f)
    assert "strategy=merge" in _plan(mixed)
    assert mixed.columns == small.columns and rows(mixed) == rows(small)


def test_a_share_of_some_thousand_companies_is_shuffled(spark):
    """16,000 companies are shuffled like 160,000, so that shuffled bytes grow as the relations do."""
    n = F.col("id").cast("string")
    df = spark.range(16_000).select(F.concat(F.lit("C"), n).alias("nodo_ini"), F.lit("S").alias("nodo_fin"), n.alias("rel_id"),
                                    (F.col("id") % 2).cast("int").alias("relacion_entre_mismo_grupo"))
    out = shares.attach_shares(df, shares.SAME_GROUP[:1])
    assert "strategy=merge" in _plan(out) and "strategy=broadcast" not in _plan(out)
    assert rows(out.groupBy("proporcion_relaciones_congrupo_ini").count()) == [(0.0, 8_000), (1.0, 8_000)]


def test_partner_counts_are_shuffled_alike_at_every_size(spark):
    f = flags.same_group_flag(flags.client_flag(spark.createDataFrame(REL, REL_SCHEMA)))
    out = shares.same_group_partner_count(f)
    assert _plan(out).count("strategy=merge") == 2
    assert rows(out, "rel_id", "conteo_relacion_mismogrupo_ini", "conteo_relacion_mismogrupo_fin") == [
        ("r1", 1, 1), ("r2", 1, 1), ("r3", 0, 1), ("r4", 1, 0)]


def test_relation_features_shuffle_relations_once_per_end(spark, monkeypatch):
    monkeypatch.setattr(shares, "SMALL_ROWS", 0)
    f = flags.same_group_flag(flags.client_flag(spark.createDataFrame(REL + [
        ("A", "B", 2020, 1, 1.0, "r0", "G", "G", "R", "N"), ("A", "A", 2020, 3, 1.0, "r5", "G", "G", "R", "R")], REL_SCHEMA)))
    out = shares.relation_features(f)
    assert _plan(out).count("strategy=merge") == 2
    want = shares.same_group_partner_count(f).join(shares.same_group_share(f).select(
        "rel_id", *[s.out for s in shares.SAME_GROUP]), "rel_id")
    assert sorted(out.columns) == sorted(want.columns)
    assert rows(out, *sorted(out.columns)) == rows(want, *sorted(out.columns)) and out.count() == 5


def test_roles_and_months_of_an_end_need_one_shuffle(spark):
    own = tables.observing_session(spark)
    own.conf.set("spark.sql.adaptive.enabled", "false")
    own.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    rel = own.createDataFrame([("A", "B", 2020, 1), ("A", "C", 2020, 2), ("A", "B", None, 1), ("B", "A", 2020, 1), (None, "Z", 2020, 1)],
                              "nodo_ini string, nodo_fin string, date_year_ini int, date_month_ini int")
    profile = own.createDataFrame([("A", 2020, 1, "x"), ("A", 2020, 1, "y"), ("A", 2020, 3, "w"), ("C", 2020, 2, None),
                                   (None, 2020, 1, "v"), ("B", None, 1, "u")], "id string, date_year_ini int, date_month_ini int, p string")
    role = own.createDataFrame([("A", "M"), ("A", "F"), ("B", "F"), ("C", "M"), (None, "M")], "id string, r string")
    features = [joins.profile_side(profile, s, ["p"]) for s in ("ini", "fin")]
    roles = [role.select(F.col("id").alias(f"nodo_{s}"), F.col("r").alias(f"r_{s}")) for s in ("ini", "fin")]
    want, sizes = rel, {}
    for name, side in zip(("roles_ini", "roles_fin", "features_ini", "features_fin"), [*roles, *features], strict=True):
        end = name[-3:]
        want = want.join(side, [f"nodo_{end}", *(joins.MONTH if side in features else [])], "left")
        sizes[name] = want.count()
    counts = {}
    out = joins.full_relation_table(rel, *features, [*rel.columns, "r_ini", "r_fin", "p_ini", "p_fin"], *roles, counts=counts)
    assert rows(out) == rows(want.select(*out.columns))
    assert tables.row_counts(counts) == sizes and [*counts] == [*sizes]
    plan = out._jdf.queryExecution().executedPlan().toString()
    # the relations once per end; the roles and the companies' months, which the other end uses again
    assert len(re.findall(r"- Exchange hashpartitioning\(nodo_", plan)) == 4


def test_partner_counts_take_both_ends_in_one_pass(spark):
    df = spark.createDataFrame(REL, REL_SCHEMA)
    out = shares.node_partner_counts(df.withColumns({f"conteo_relacion_mismogrupo_{s}": F.length(f"nodo_{s}") for s in ("ini", "fin")}))
    assert _plan(out).count("LogicalRDD") == 1
    assert rows(out) == [("A", "G", 1), ("B", "G", 1), (None, None, None)]


def _shuffle_files(spark):
    found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
    return {f for f in found.split("\n") if "/shuffle_" in f and f.endswith(".data")}


def test_a_written_table_leaves_no_shuffle_files(spark):
    before = _shuffle_files(spark)
    table = written(spark.range(1000).repartition(4).groupBy((F.col("id") % 7).alias("k")).count())
    for _ in range(50):  # executors drop the files in the background
        if not (left := _shuffle_files(spark) - before):
            break
        time.sleep(0.2)
    assert not left and sorted(r["count"] for r in table.collect()) == [142, 143, 143, 143, 143, 143, 143]


def test_model_features_read_relations_once_written(spark, sf):
    """The parts that come from relations are tables of their own: joining them reads no lines and no orders again."""
    files = prediction.company_model_features(spark, sf).inputFiles()
    assert files and not any("lineitem" in f or "orders" in f for f in files)
