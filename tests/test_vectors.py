"""Vector search and pairs through cells against brute force, and how much they leave out."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ticketflow import queries, queries_state  # noqa: F401  (registers its queries)
from ticketflow.operators import graph as G
from ticketflow.operators import joins as J
from ticketflow.operators import lineage
from ticketflow.operators import vectors as V
from ticketflow.operators import windows as W


def unit_rows(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def groups_of(rng, n, dim, centers, spread):
    return unit_rows(rng.normal(size=(centers, dim))[rng.integers(0, centers, n)] + spread * rng.normal(size=(n, dim)))


def frame(spark, **columns):
    return spark.createDataFrame(pa.table({k: pa.array(v.tolist(), pa.list_(pa.float64())) if isinstance(v, np.ndarray) and v.ndim == 2 else pa.array(v) for k, v in columns.items()}))


def brute(queries, q_block, points, p_block, group, k, floor=None, ids=None):
    out = set()
    score = np.round(queries @ points.T, 6)
    for i in range(len(queries)):
        best = {}
        for j in np.flatnonzero(p_block == q_block[i]):
            if (ids is None or group[j] != ids[i]) and (floor is None or score[i, j] >= floor):
                best[group[j]] = max(best.get(group[j], -2), score[i, j])
        out |= {(i, g, r + 1, round(s, 6)) for r, (g, s) in enumerate(sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k])}
    return out


@pytest.fixture
def small_cells(monkeypatch):
    monkeypatch.setattr(V, "CELL", 40)
    monkeypatch.setattr(V, "DIRECT", 0)
    monkeypatch.setattr(V, "BLOCK", 64)


@pytest.mark.parametrize("floor", [None, 0.5])
def test_best_groups(spark, small_cells, floor):
    """Several cells and tiles, a hot block, a block without points, zero and null vectors, ties."""
    rng = np.random.default_rng(1)
    points, queries = groups_of(rng, 600, 6, 9, 0.3), groups_of(rng, 90, 6, 9, 0.3)
    points[10], points[300:310] = 0, points[5]
    p_block, q_block = rng.choice([0, 0, 0, 0, 1, 2], 600), rng.choice([0, 0, 1, 3], 90)
    group = rng.integers(0, 50, 600)
    index = V.build_index(frame(spark, block=p_block, grp=group, v=points).unionByName(spark.createDataFrame([(0, 1, None)], "block long, grp long, v array<double>")))
    assert len(index.cells.radius) > 5
    got = V.best_groups(frame(spark, query=np.arange(90), block=q_block, v=queries), index, 4, floor).collect()
    assert {(r["query"], r["grp"], r["rank"], round(r["score"], 6)) for r in got} == brute(queries, q_block, points, p_block, group, 4, floor)


def test_an_index_is_two_tables(spark, small_cells, tmp_path):
    rng = np.random.default_rng(2)
    points = groups_of(rng, 400, 5, 6, 0.2)
    index = V.build_index(frame(spark, block=np.zeros(400, int), grp=np.arange(400), v=points))
    V.save_index(index, str(tmp_path / "index"))
    q = frame(spark, query=np.arange(400), block=np.zeros(400, int), v=points)
    got = {tuple(r) for r in V.best_groups(q, V.load_index(spark, str(tmp_path / "index")), 3, 0.9, apart=True).select("query", "grp", "rank", "score").collect()}
    none = np.zeros(400, int)
    assert got == brute(points, none, points, none, np.arange(400), 3, 0.9, np.arange(400))


def test_close_pairs(spark, small_cells):
    rng = np.random.default_rng(3)
    x = groups_of(rng, 500, 6, 10, 0.25)
    block = rng.choice([0, 0, 0, 1, 2], 500)
    got = {(r["a"], r["b"], round(r["sim"], 6)) for r in V.close_pairs(frame(spark, id=np.arange(500), block=block, v=x), 0.8).collect()}
    score = np.round(x @ x.T, 6)
    assert got == {(i, j, round(score[i, j], 6)) for i in range(500) for j in range(i + 1, 500) if block[i] == block[j] and score[i, j] >= 0.8}


def test_nothing(spark):
    none = spark.createDataFrame([], "id long, block long, v array<double>")
    index = V.build_index(none.select("block", F.col("id").alias("grp"), "v"))
    assert V.best_groups(none.withColumnRenamed("id", "query"), index, 3).count() == 0
    assert V.close_pairs(none, 0.5).count() == 0


def test_cells_leave_out_most_products(spark):
    """200,000 vectors in groups: at most a fifth of all products, with a floor and without one."""
    rng = np.random.default_rng(5)
    n, dim = 200_000, 16
    points, queries = groups_of(rng, n, dim, 2000, 0.15).round(6), groups_of(rng, 400, dim, 2000, 0.15)
    index = V.build_index(frame(spark, block=np.zeros(n, int), grp=np.arange(n), v=points))
    rows = {r["cell"]: r["count"] for r in index.points.groupBy("cell").count().collect()}
    q = frame(spark, query=np.arange(400), block=np.zeros(400, int), v=queries)

    def products(asked):
        return sum(rows.get(c, 0) for r in asked.select("asked").collect() for c in r["asked"])

    assert products(V.asked_cells(q.withColumn("least", F.lit(0.8)), index.cells, 0.8)) <= 400 * n / 5
    first = V.asked_cells(q, index.cells, None)
    near = np.sort(queries @ points.T, axis=1)[:, -5]
    later = V.asked_cells(frame(spark, query=np.arange(400), block=np.zeros(400, int), v=queries, least=near), index.cells, None, done=True)
    assert products(first) + products(later) <= 400 * n / 5


def test_shortlist_drops_vetoed_before_or_after_the_cut(spark):
    cl = spark.createDataFrame([(k, "active", "SysA") for k in range(4)], "cluster_id long, status string, affected_system string")
    mb = spark.createDataFrame([(k, [1.0, 0.1 * k]) for k in range(4)], "cluster_id long, embedding array<double>")
    st = spark.createDataFrame([(7, "SysA", [1.0, 0.0])], "ticket_id long, affected_system string, embedding array<double>")
    veto = spark.createDataFrame([(7, 0)], "ticket_id long, cluster_id long")
    pick = lambda first: [(r["cluster_id"], r["rank"]) for r in J.candidate_clusters(st, cl, mb, veto, 2, first).orderBy("rank").collect()]
    assert pick(False) == [(1, 2)] and pick(True) == [(1, 1), (2, 2)]


def test_a_vector_is_sent_to_few_tiles(spark, monkeypatch):
    """In many dimensions most cells are in reach: what is sent must not grow with the number of cells (it was sent to each)."""
    monkeypatch.setattr(V, "CELL", 20)
    monkeypatch.setattr(V, "DIRECT", 0)
    rng = np.random.default_rng(7)
    x = unit_rows(rng.normal(size=(4000, 32)))
    q = frame(spark, query=np.arange(4000), block=np.zeros(4000, int), v=x)
    index = V.build_index(q.withColumnRenamed("query", "grp"))
    assert len(index.cells.radius) > 100
    asked = V.asked_tiles(q.withColumn("least", F.lit(0.15)), index.cells, 0.15)
    assert asked.agg(F.max(F.size("asked"))).first()[0] <= V.TILES
    sent = []
    blocks = V.blocks
    monkeypatch.setattr(V, "blocks", lambda *a: sent.extend(blocks(*a)) or (sent[-2], sent[-1]))
    V.close_pairs(q.withColumnRenamed("query", "id"), 0.15)
    assert sum(df.count() for df in sent) <= 2 * 4000 * V.TILES * 2


def test_nearest_pairs_are_those_of_all_pairs(spark, small_cells):
    rng = np.random.default_rng(8)
    x = groups_of(rng, 300, 6, 10, 0.4)
    x[7] = x[8] = x[9]
    vec = frame(spark, vec_id=np.arange(300), label=rng.choice([0, 0, 1, 2], 300), embedding=x)
    rows = lambda df: sorted((r["a"], r["b"], round(r["sim"], 6)) for r in df.collect())
    assert rows(J.nearest_pairs(vec, 3, 0.3, "label")) == rows(W.topn_neighbours(J.similar_pairs(vec, 0.3, "label"), 3, 0.3))


def test_weakest_edges_with_ties(spark):
    edges = spark.createDataFrame([(0, k, round(0.1 * (k % 3), 1)) for k in range(1, 23)] + [(30, 31, 0.5)], "a long, b long, sim double")
    comps = spark.createDataFrame([(k, 0) for k in range(23)] + [(30, 30), (31, 30)], "node long, component long")
    got = sorted((r["sim"], r["a"], r["b"]) for r in W.weakest_edges(edges, comps).collect())
    assert got == sorted((0.1 * (k % 3), 0, k) for k in range(1, 23))[:5]


@pytest.mark.parametrize("name", ["confirm_edges", "oversize_guard"])
def test_pairs_are_judged_without_being_kept_or_shuffled(spark, monkeypatch, name):
    """All pairs of a label grow with its square: 500 vectors have 1,500 of them (they were all checkpointed, then joined with their verdicts)."""
    kept = []

    def cut(df):
        out = lineage.cut(df)
        kept.append(out.count())
        return out

    for module in (queries, G, J, V, W):
        monkeypatch.setattr(module, "cut", cut)
    df = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert max(kept) <= 500 < df.count()
    assert "Exchange hashpartitioning" not in plan[: plan.index("FlatMapGroupsInArrow")]


def test_a_vector_is_sent_to_a_fixed_number_of_blocks(spark, monkeypatch):
    """Blocks of a fixed size took each vector to a number of them that grows with the table."""
    monkeypatch.setattr(V, "PAIRS", 8)
    x = unit_rows(np.random.default_rng(9).normal(size=(2000, 4)))
    sent, blocks = [], V.blocks
    monkeypatch.setattr(V, "blocks", lambda *a: sent.extend(blocks(*a)) or (sent[-2], sent[-1]))
    V.close_pairs(frame(spark, id=np.arange(2000), block=np.zeros(2000, int), v=x), 0.9)
    assert sum(df.count() for df in sent) <= 2 * 2000 * 66


@pytest.mark.parametrize("keep", [0, 10_000_000])
@pytest.mark.parametrize("joined", [False, True])
def test_weak_edges_that_bring_their_answers(spark, monkeypatch, keep, joined):
    """Ties of sim and of a, a component at the threshold, an edge of no component, a missing answer; by nodes or by the edges' own component."""
    monkeypatch.setattr(W, "KEPT", keep)
    rng = np.random.default_rng(11)
    of = {k: k % 3 for k in range(90)} | {k: 7 for k in range(90, 110)}
    picked = {tuple(sorted(map(int, rng.choice(110, 2, replace=False)))) for _ in range(900)} | {(200, 201)}
    edges = [(a, b, round(float(rng.choice([0.1, 0.10004, 0.2, 0.35])), 5), [None, "NO", "YES"][(a + b) % 3]) for a, b in sorted(picked) if of.get(a) == of.get(b)]
    gone, weak = set(), set()
    for c in range(3):
        own = sorted((s, a, b, x) for a, b, s, x in edges if of.get(a) == c)
        weak |= {(c, a, b, s) for s, a, b, _ in own[: max(1, len(own) // 4)]}
        gone |= {(a, b, s) for s, a, b, x in own[: max(1, len(own) // 4)] if x != "YES"}
    df = spark.createDataFrame([(*e, of.get(e[0])) for e in edges], "a long, b long, sim double, second string, component long")
    df = df if joined else df.drop("component")
    comps = spark.createDataFrame(list(of.items()), "node long, component long")
    assert {tuple(r) for r in W.weakest_edges(df, comps).collect()} == weak and len(gone) > 20
    left = {(a, b, s) for a, b, s, _ in edges} - gone
    assert {tuple(r) for r in G.oversize_guard(df, comps, None).collect()} == left
    assert {tuple(r)[:3] for r in G.oversize_guard(df, comps, df).select("a", "b", "sim").collect()} == left
