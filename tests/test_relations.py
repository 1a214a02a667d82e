import time

from pyspark.sql import functions as F

from conftest import REL_SCHEMA, rows
from holdnet.operators import flags, joins, shares, tables


def rel(spark):
    data = [
        ("A", "B", 2020, 1, 1.0, "r1", "G1", "G1", "R", "N"),
        ("A", "C", 2020, 1, 2.0, "r2", "G1", "G2", "R", None),
        ("B", "A", 2020, 1, 3.0, "r3", "G1", "G1", None, "R"),
        ("A", "B", 2020, 1, 4.0, "r0", "G1", "G1", "R", "N"),   # same pair and month: r0 wins the dedupe
        ("D", "A", 2020, 2, 5.0, "r4", None, "G1", "N", "R"),   # start without group
        ("A", "B", 2020, 2, 6.0, "r5", "G1", "G1", "R", "N"),
    ]
    return spark.createDataFrame(data, REL_SCHEMA)


def test_flags_null_semantics(spark):
    out = flags.same_group_flag(flags.client_flag(rel(spark)))
    got = rows(out, "rel_id", "cliente_nocliente_ini", "cliente_nocliente_fin", "relacion_entre_mismo_grupo")
    assert got == [("r0", 1, 0, 1), ("r1", 1, 0, 1), ("r2", 1, 0, 0), ("r3", 0, 1, 1), ("r4", 0, 1, 0),
                   ("r5", 1, 0, 1)]


def test_group_client_share_null_group_stays_null(spark):
    f = flags.same_group_flag(flags.client_flag(rel(spark)))
    out = shares.group_client_share(f)
    got = dict(rows(out, "rel_id", "proporcion_cliente_ini"))
    # G1 in 2020-01 has starts r0, r1, r3 (clients: r0, r1) -> 2/3; r2 is also G1 -> 3/4
    assert abs(got["r1"] - 0.75) < 1e-12 and abs(got["r3"] - 0.75) < 1e-12
    assert got["r4"] is None  # null group: null share (Q4)
    bucket = dict(rows(shares.group_client_share(f, no_group="bucket"), "rel_id", "proporcion_cliente_ini"))
    assert bucket["r4"] == 0.0
    assert out.count() == f.count()


def test_same_group_share_and_partner_count(spark):
    f = flags.same_group_flag(flags.client_flag(rel(spark)))
    out = shares.relation_features(f)
    # one row per pair and month after the dedupe: r1 (dup of r0) is dropped
    ids = [r[0] for r in rows(out, "rel_id")]
    assert ids == ["r0", "r2", "r3", "r4", "r5"]
    got = {r["rel_id"]: r for r in out.collect()}
    # A starts 4 relations (r0, r1, r2, r5), 3 same group
    assert abs(got["r0"]["proporcion_relaciones_congrupo_ini"] - 0.75) < 1e-12
    # same-group partners: A -> {B}; B -> {A}; D has none
    assert got["r0"]["conteo_relacion_mismogrupo_ini"] == 1
    assert got["r4"]["conteo_relacion_mismogrupo_ini"] == 0
    for r in out.collect():
        for c in ("proporcion_relaciones_congrupo_ini", "proporcion_relaciones_congrupo_fin"):
            assert 0.0 <= r[c] <= 1.0


def test_edge_table_tie_break(spark):
    e = tables.edge_table(rel(spark))
    got = rows(e, "src", "dst", "anho_mes", "rel_id")
    assert got == [("A", "B", "202001", "r0"), ("A", "B", "202002", "r5"), ("A", "C", "202001", "r2"),
                   ("B", "A", "202001", "r3"), ("D", "A", "202002", "r4")]


def test_node_table_keeps_both_sides(spark):
    cols = (["nodo", "grupo"], ["nodo_ini", "grupo_ini"], ["nodo_fin", "grupo_fin"])
    nt = tables.node_table(rel(spark), *cols)
    assert nt.filter(F.col("nodo") == "A").count() == 2
    assert tables.node_table_distinct(rel(spark), *cols).filter(F.col("nodo") == "A").count() == 1


def test_latest_balance_and_profile(spark):
    bal = spark.createDataFrame([("X", 2019, 1.0, 1), ("X", 2021, 2.0, 3), ("X", 2021, 3.0, 2), ("Y", 2018, 4.0, 4)],
                                "id string, clcb_ano_ejercicio int, importe_balance double, bal_id long")
    got = rows(tables.latest_balance(bal), "id", "clcb_ano_ejercicio", "bal_id")
    assert got == [("X", 2021, 2), ("Y", 2018, 4)]
    ident = spark.createDataFrame([("X", "cx", "2020-03-01"), ("Y", "cy", "2021-11-01"), ("Z", "cz", "2021-01-01")],
                                  "id string, cif string, fechadato string")
    legal = spark.createDataFrame([("X", "SA"), ("Y", "SL")], "id string, forma string")
    prof = joins.company_profile(ident, legal, bal)
    got = rows(prof, "id", "fechadato_year", "date_month_ini", "clcb_ano_ejercicio")
    assert got == [("X", "2020", 3, 2021), ("Y", "2021", 11, 2018)]


def test_fill_unknown_all_columns(spark):
    df = spark.createDataFrame([(None, None, 1), ("a", 2, None)], "s string, n int, k int")
    out = flags.fill_unknown(df, ["s", "n"])
    assert rows(out, "s", "n") == [("a", "2"), ("desconocido_s", "desconocido_n")]
    assert flags.fill_unknown(df, []) is df


def test_observed_row_counts_cost_no_job(spark):
    spark = tables.observing_session(spark)
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # one job a query, whatever the sizes
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    keys = ["nodo_ini", "nodo_fin", *joins.MONTH]
    r = spark.createDataFrame([("A", "B", 2020, 1), ("A", "C", 2020, 1), ("B", "C", 2020, 2), (None, "C", 2020, 2)],
                              "nodo_ini string, nodo_fin string, date_year_ini int, date_month_ini int").cache()
    r.count()
    ini = spark.createDataFrame([("A", 2020, 1, "x"), ("A", 2020, 2, "y")], "nodo_ini string, date_year_ini int, date_month_ini int, p string")
    fin = spark.createDataFrame([("C", 2020, 1, "x"), ("C", 2020, 1, "y")], "nodo_fin string, date_year_ini int, date_month_ini int, q string")
    role = spark.createDataFrame([("C", "M")], "nodo_fin string, role string")
    sc, jobs = spark.sparkContext, {}
    for name, counts in (("plain", None), ("observed", {})):
        sc.setJobGroup(name, name)
        got = rows(joins.full_relation_table(r, ini, fin, [*keys, "p", "q", "role"], roles_fin=role, counts=counts))
        time.sleep(1)  # the tracker hears of jobs a little later
        jobs[name] = len(sc.statusTracker().getJobIdsForGroup(name))
        if counts is not None:
            found = tables.row_counts(counts)
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert found == {"roles_fin": 4, "features_ini": 4, "features_fin": 5} and len(got) == 5
    assert jobs == {"plain": 1, "observed": 1}
    empty = {}
    assert joins.full_relation_table(r.limit(0), ini, fin, keys, counts=empty).count() == 0


def test_models_work_after_observed_counts(spark):
    from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler
    counts = {}
    own = tables.observing_session(spark)
    tables.observed(own.range(5), "n", counts).count()
    assert tables.row_counts(counts) == {"n": 5}
    df = VectorAssembler(inputCols=["x"], outputCol="features").transform(
        spark.createDataFrame([(float(k), k % 2) for k in range(20)], "x double, label int"))
    for est in (LogisticRegression(), RandomForestClassifier(numTrees=2)):
        assert est.fit(df).transform(df).select("prediction").count() == 20
        assert len(est.fit(df).transform(df).select("prediction").collect()) == 20
