import random
from collections import defaultdict, deque

from pyspark.sql import functions as F

from conftest import NODE_SCHEMA, rows
from holdnet import session
from holdnet.operators import closeness, graph
from holdnet.plans import graphs
from holdnet.session import written

EDGE_SCHEMA = "src string, dst string, anho_mes string, value double, rel_id string"


def test_total_degree_self_loop_reciprocal_duplicate(spark):
    rel = spark.createDataFrame([("A", "B"), ("B", "A"), ("A", "B"), ("C", "C"), ("A", "C"), (None, "A")],
                                "nodo_ini string, nodo_fin string")
    out = {r["nodo"]: (r["grado"], r["centralidad"]) for r in graph.total_degree_centrality(rel).collect()}
    # undirected simple graph {A-B, C-C, A-C}: a self-loop adds 2
    assert out == {"A": (2, 1.0), "B": (1, 0.5), "C": (3, 1.5)}
    single = spark.createDataFrame([("A", "A")], "nodo_ini string, nodo_fin string")
    assert graph.total_degree_centrality(single).first()["centralidad"] == 1.0


def test_degree_sum_is_twice_the_edges(spark):
    rnd = random.Random(3)
    data = [(f"n{rnd.randrange(30)}", f"n{rnd.randrange(30)}") for _ in range(200)]
    rel = spark.createDataFrame(data, "nodo_ini string, nodo_fin string")
    und = {tuple(sorted(p)) for p in data}
    total = graph.total_degree_centrality(rel).agg(F.sum("grado")).first()[0]
    assert total == 2 * len(und)


def nodes_df(spark):
    return spark.createDataFrame([
        ("A", "G1", "M", 10.0, "s1", "small"), ("B", "G1", "F", 20.0, "s1", "small"),
        ("C", "G1", "F", None, "s2", "large"), ("D", "G2", "F", 5.0, "s2", "small"),
        ("E", "G2", "M", 7.0, "s1", "small"), ("P", "G3", "M", 1.0, "s1", "small"),
        ("Q", "G3", "M", 2.0, "s1", "small"), ("X", None, None, 3.0, "s2", "small")], NODE_SCHEMA)


def edges_df(spark):
    return spark.createDataFrame([
        ("A", "B", "202001", 1.0, "e1"), ("B", "A", "202001", 2.0, "e2"), ("A", "B", "202002", 3.0, "e3"),
        ("C", "A", "202001", 1.0, "e4"), ("A", "D", "202001", 1.0, "e5"), ("D", "E", "202001", 1.0, "e6"),
        ("X", "B", "202001", 1.0, "e7")], EDGE_SCHEMA)


def test_group_edges_and_degree(spark):
    ge = graph.group_edges(edges_df(spark), nodes_df(spark))
    g1 = rows(ge.filter(F.col("grupo") == "G1"), "src", "dst", "value")
    # latest duplicate edge value wins; the outside neighbours D and X come along
    assert g1 == [("A", "B", 3.0), ("A", "D", 1.0), ("B", "A", 2.0), ("C", "A", 1.0), ("X", "B", 1.0)]
    g2 = rows(ge.filter(F.col("grupo") == "G2"), "src", "dst")
    assert g2 == [("A", "D"), ("D", "E")]
    deg = {(r["grupo"], r["nodo"]): r["centralidad_ensu_grupo"]
           for r in graph.group_degree_centrality(ge).collect()}
    # G1 graph has 5 nodes; A: in 2 + out 2 = 4 -> 1.0 (reciprocal edges count twice)
    assert deg[("G1", "A")] == 1.0 and deg[("G1", "B")] == 0.75 and deg[("G1", "X")] == 0.25
    assert ("G3", "P") not in deg


def test_parents_and_roles(spark):
    nodes = nodes_df(spark)
    parents = dict(rows(graph.group_parent(nodes), "grupo", "matriz"))
    assert parents == {"G1": "A", "G2": "E", "G3": "P"}  # two parents: smallest id
    no_parent = spark.createDataFrame([("Z", "G9", "F", 1.0, "s", "small")], NODE_SCHEMA)
    assert graph.group_parent(no_parent).first()["matriz"] == graph.NO_PARENT
    counts = graph.groups_with_without_parent(graph.group_parent(nodes.unionByName(no_parent))).first()
    assert (counts["n_grupos_con_matriz"], counts["n_grupos_sin_matriz"]) == (3, 1)
    ge = graph.group_edges(edges_df(spark), nodes)
    roles = {r["grupo"]: (r["nodo_central"], r["clase"])
             for r in graph.central_node_role(graph.group_degree_centrality(ge), nodes).collect()}
    assert roles["G1"] == ("A", "mayor_centr_matriz")
    # G2 graph: A-D, D-E; D has degree 2 and is a subsidiary of G2
    assert roles["G2"] == ("D", "mayor_centr_no_matriz(filial)")


def test_central_node_tie_goes_to_smallest_id(spark):
    nodes = spark.createDataFrame([("B", "G", "F", 1.0, "s", "small"), ("C", "G", "F", 1.0, "s", "small"),
                                   ("Z", "H", "F", 1.0, "s", "small")], NODE_SCHEMA)
    e = spark.createDataFrame([("B", "C", "202001", 1.0, "e1"), ("C", "Z", "202001", 1.0, "e2")], EDGE_SCHEMA)
    ge = graph.group_edges(e, nodes)
    roles = {r["grupo"]: (r["nodo_central"], r["clase"])
             for r in graph.central_node_role(graph.group_degree_centrality(ge), nodes).collect()}
    assert roles["G"] == ("C", "mayor_centr_no_matriz(filial)")
    # in H's graph C and Z tie; C wins and belongs to another group
    assert roles["H"] == ("C", "mayor_centr_nogrupo")


def brute_closeness(edges):
    """networkx-style closeness with inward distances on a directed graph, per group."""
    out = {}
    by_group = defaultdict(list)
    for g, s, d in edges:
        by_group[g].append((s, d))
    for g, es in by_group.items():
        nodes = sorted({x for e in es for x in e})
        rev = defaultdict(set)
        for s, d in es:
            rev[d].add(s)
        n = len(nodes)
        for u in nodes:
            dist = {u: 0}
            q = deque([u])
            while q:
                v = q.popleft()
                for w in rev[v]:
                    if w not in dist:
                        dist[w] = dist[v] + 1
                        q.append(w)
            tot = sum(dist.values())
            r = len(dist)
            out[(g, u)] = (r - 1) / tot * (r - 1) / (n - 1) if tot > 0 and n > 1 else 0.0
    return out


def test_group_closeness_matches_brute_force(spark):
    rnd = random.Random(7)
    data = []
    for g, size, m in (("G1", 70, 160), ("G2", 12, 20), ("G3", 3, 2)):
        for _ in range(m):
            data.append((g, f"{g}_{rnd.randrange(size)}", f"{g}_{rnd.randrange(size)}"))
    data = [t for t in data if t[1] != t[2]]
    ge = spark.createDataFrame(data, "grupo string, src string, dst string")
    parents = spark.createDataFrame([("G1", "G1_0"), ("G2", "none")], "grupo string, matriz string")
    groups = spark.createDataFrame([("G1",), ("G2",), ("G3",), ("G9",)], "grupo string")
    out = closeness.group_closeness(ge, groups, parents)
    want = brute_closeness(set(data))
    got = {(r["grupo"], r["nodo"]): r for r in out.collect()}
    assert set(got) == set(want)
    for k, v in want.items():
        assert abs(got[k]["closeness"] - v) < 1e-8, k
    for g in ("G1", "G2", "G3"):
        best = max(v for (gg, _), v in want.items() if gg == g)
        flagged = {k[1] for k, r in got.items() if k[0] == g and r["es_max"] == 1}
        assert flagged == {k[1] for k, v in want.items() if k[0] == g and abs(v - best) < 1e-9}


def test_closeness_of_listed_groups_and_hubs(spark, monkeypatch):
    monkeypatch.setattr(closeness, "HUB_EDGES", 4)  # every busy node is split over several keys
    data = [("H", "hub", f"n{k}") for k in range(30)] + [("H", f"n{k}", "hub") for k in range(0, 30, 3)] + [("X", "a", "b")]
    ge = spark.createDataFrame(data, "grupo string, src string, dst string")
    got = closeness.group_closeness(ge, spark.createDataFrame([("H",)], "grupo string")).collect()
    want = {k: v for k, v in brute_closeness(set(data)).items() if k[0] == "H"}
    assert {(r["grupo"], r["nodo"]) for r in got} == set(want)
    assert all(abs(r["closeness"] - want[r["grupo"], r["nodo"]]) < 1e-8 for r in got)


def test_closeness_in_batches_of_source_words(spark, monkeypatch):
    monkeypatch.setattr(closeness, "STATE_ROWS", 150)  # less than two words of the largest group
    monkeypatch.setattr(closeness, "SUMS_HELD", 2)
    rnd = random.Random(11)
    data = [(g, f"{g}{rnd.randrange(n)}", f"{g}{rnd.randrange(n)}") for g, n, m in (("a", 140, 300), ("b", 15, 30), ("c", 4, 5)) for _ in range(m)]
    ge = spark.createDataFrame(data, "grupo string, src string, dst string")
    got = closeness.group_closeness(ge, spark.createDataFrame([("a",), ("b",), ("c",)], "grupo string")).collect()
    want = brute_closeness(set(data))
    assert {(r["grupo"], r["nodo"]) for r in got} == set(want)
    assert all(abs(r["closeness"] - want[r["grupo"], r["nodo"]]) < 1e-8 for r in got)


def test_closeness_runs_no_job_a_round(spark):
    """A chain of 120 nodes needs 119 rounds; the number of jobs does not follow them."""
    sc = spark.sparkContext
    sc.setJobGroup("chain", "chain")
    e = [("G", f"n{k:03}", f"n{k + 1:03}") for k in range(119)] + [("H", "a", "a"), ("H", "b", "a"), ("H", None, "a"), (None, "b", "a")]
    got = closeness.inward_distance_sums(spark.createDataFrame(e, "grupo string, src string, dst string")).collect()
    jobs = len(sc.statusTracker().getJobIdsForGroup("chain"))
    sc.setLocalProperty("spark.jobGroup.id", None)
    want = {("G", f"n{k:03}"): (120, k, k * (k + 1) // 2) for k in range(120)} | {("H", "a"): (2, 1, 1), ("H", "b"): (2, 0, 0)}
    assert {(r["grupo"], r["nodo"]): (r["n"], r["reach"], r["dist_sum"]) for r in got} == want
    assert jobs < 60
    empty = spark.createDataFrame([], "grupo string, src string, dst string")
    assert closeness.inward_distance_sums(empty).collect() == []


def test_closeness_by_tasks_and_by_joins(spark, monkeypatch):
    rnd = random.Random(12)
    data = sorted({(g, f"{g}{min(rnd.randrange(n), rnd.randrange(n))}", f"{g}{rnd.randrange(n)}")
                   for g, n, m in (("a", 150, 400), ("b", 70, 90), ("c", 4, 5)) for _ in range(m)})
    ge = spark.createDataFrame(data, "grupo string, src string, dst string")
    whole = rows(closeness.inward_distance_sums(ge))
    monkeypatch.setattr(closeness, "HUB_DEGREE", 3)
    monkeypatch.setattr(closeness, "BLOCK_EDGES", 50)
    monkeypatch.setattr(closeness, "TABLE_WORDS", 1)
    assert rows(closeness.inward_distance_sums(ge)) == whole
    for edges in (0, 100):  # all graphs by joins; the largest by joins, the others by tasks
        monkeypatch.setattr(closeness, "TASK_EDGES", edges)
        assert rows(closeness.inward_distance_sums(ge)) == whole


def test_closeness_query_searches_every_group(spark, monkeypatch):
    names = "nodo string, grupo string, ind_filial_matriz string"
    nodes = spark.createDataFrame([("a", "G", "M"), ("b", "G", "F"), ("c", "H", "F"), ("d", None, None)], names)
    e = spark.createDataFrame([("a", "b", "202001", 1.0, "1"), ("b", "c", "202001", 1.0, "2"), ("c", "d", "202001", 1.0, "3")], EDGE_SCHEMA)
    monkeypatch.setattr(graphs.fx, "nodos", lambda *_: nodes)
    monkeypatch.setattr(graphs, "edges", lambda *_: e)
    got = {(r["grupo"], r["nodo"]): r["closeness"] for r in graphs.q_group_closeness(spark, "").collect()}
    want = brute_closeness({("G", "a", "b"), ("G", "b", "c"), ("H", "b", "c"), ("H", "c", "d")})
    assert set(got) == set(want) and all(abs(got[k] - v) < 1e-8 for k, v in want.items())


def test_sketched_closeness_is_near(spark):
    rnd = random.Random(3)
    data = [(g, f"{g}{rnd.randrange(n)}", f"{g}{rnd.randrange(n)}") for g, n, m in (("a", 300, 900), ("b", 15, 30)) for _ in range(m)]
    ge = spark.createDataFrame(data, "grupo string, src string, dst string")
    want = brute_closeness({t for t in data if t[1] != t[2]} | {t for t in data})
    got = {(r["grupo"], r["nodo"]): r["closeness"] for r in closeness.group_closeness_sketch(ge).collect()}
    assert set(got) == set(want)
    errors = sorted(abs(got[k] - v) / v for k, v in want.items() if v > 0)
    assert errors[len(errors) // 2] < 0.03 and errors[int(0.95 * len(errors))] < 0.10


def test_sketches_in_batches_leave_only_sums(spark, monkeypatch, tmp_path):
    rnd = random.Random(4)
    data = [(g, f"{g}{rnd.randrange(n)}", f"{g}{rnd.randrange(n)}") for g, n, m in (("a", 60, 150), ("b", 15, 30), ("c", 9, 9)) for _ in range(m)]
    data += [("d", "x", "x"), ("e", "y", None), (None, "x", "y")]
    ge = spark.createDataFrame(data, "grupo string, src string, dst string")
    whole = rows(closeness.sketched_distance_sums(ge))
    assert {r[0] for r in whole} == set("abcde") and ("d", "x", 1, 0.0, 0.0) in whole
    monkeypatch.setattr(closeness, "SKETCH_ROWS", 1)  # a batch a graph
    monkeypatch.setattr(closeness, "written", lambda df, label="table", *more: folders.append(label) or written(df, label, *more))
    monkeypatch.setattr(session, "shared_folder", lambda _, label: f"{tmp_path}/{label}-{len(folders)}")
    folders = []
    assert rows(closeness.sketched_distance_sums(ge)) == whole
    kept = [p.name.rpartition("-")[0] for p in tmp_path.iterdir()]
    assert folders.count("sums") == 5 and sorted(kept) == ["edges", "graphs", "nodes", *["sums"] * 5]
    assert closeness.sketched_distance_sums(ge.limit(0)).collect() == []


def test_listed_groups(spark):
    nodes = spark.createDataFrame([("a", "G", "M"), ("b", "G", "F"), ("c", "H", "F")], "nodo string, grupo string, ind_filial_matriz string")
    groups = spark.createDataFrame([("G",), ("empty",)], "grupo string")
    assert {(r["grupo"], r["matriz"]) for r in graph.group_parent(nodes, groups).collect()} == {("G", "a"), ("empty", "no_tiene_matriz")}
    both = graph.groups_with_without_parent(graph.group_parent(nodes, groups)).collect()
    assert {(r["grupo"], r["con_matriz"], r["n_grupos_sin_matriz"]) for r in both} == {("G", 1, 1), ("empty", 0, 1)}
    e = spark.createDataFrame([("a", "b", "202001", 1.0, "1"), ("b", "c", "202001", 1.0, "2")], "src string, dst string, anho_mes string, value double, rel_id string")
    ge = graph.group_edges(e, nodes, groups=groups)
    assert sorted((r["grupo"], r["src"], r["dst"]) for r in ge.collect()) == [("G", "a", "b"), ("G", "b", "c")]
    assert {r["nodo"] for r in graph.group_degree_centrality(graph.group_edges(e, nodes), groups).collect()} == {"a", "b", "c"}
