"""Hand-made cases for single operators."""

import ast
import inspect
import math
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from ticketflow import queries, queries_state  # noqa: F401  (registers its queries)
from ticketflow.functions import hooks as X
from ticketflow.functions import scalars as S
from ticketflow.operators import aggs as A
from ticketflow.operators import graph as G
from ticketflow.operators import joins as J
from ticketflow.operators import state as M
from ticketflow.operators import views as V
from ticketflow.operators import windows as W
from ticketflow.queries import ORACLE
from ticketflow.sources import intake as I


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("given, wanted", [("7.1 Invoicing and Billing - X.Bill Generation", "7.1 Invoicing and Billing - X"), ("no dot", None)])
def test_offering_key(spark, given, wanted):
    assert value(spark, S.offering_key(F.lit(given))) == wanted


@pytest.mark.parametrize("given", ["TX-778201", "tx 778201", "TX_778_201", "TX-٧٧٨٢٠١"])
def test_normalize_code(spark, given):
    assert value(spark, S.normalize_code(F.lit(given))) == "TX778201"


@pytest.mark.parametrize("given", ["المُحْفَظَة", "المحفظة", "المحفظه", "محفظة"])
def test_normalize_page(spark, given):
    assert value(spark, S.normalize_page(F.lit(given))) == "محفظه"


@pytest.mark.parametrize("given, wanted", [
    ("write to a.b@c.org now", "write to [EMAIL] now"), ("call 0512345678", "call [PHONE]"), ("national id: 1234567890", "national id [DOC-ID]"),
    ("name: Jo Doe phone", "name [NAME] phone"), ("TX-778201 E-REF-9 Error 10036015", "TX-778201 E-REF-9 Error 10036015"), ("1234567890", "1234567890"),
])
def test_mask_pii(spark, given, wanted):
    assert value(spark, S.mask_pii(F.lit(given))) == wanted


def test_strip_label_prefix(spark):
    assert value(spark, S.strip_label_prefix(F.lit("SysA / x: Bus 12 at 14:00 on 4/6/2026"), ["SysA"])) == "Bus 12 at 14:00 on 4/6/2026"
    assert value(spark, S.strip_label_prefix(F.lit("Bus departs at 14:00"), ["SysA"])) == "Bus departs at 14:00"


def test_guarded_label(spark):
    assert value(spark, S.guarded_label(F.lit("english"), F.lit("عنوان"), "مجموعة")) == "عنوان"
    assert value(spark, S.guarded_label(F.lit("اسم قصير"), F.lit("x"), "مجموعة")) == "اسم قصير"
    assert value(spark, S.guarded_label(F.lit("english"), F.lit("x"), "مجموعة")) == "مجموعة"


def test_purity_flags(spark):
    def flagged(*counts):
        df = spark.createDataFrame([(1, i * 100 + k, s) for i, (s, n) in enumerate(counts) for k in range(n)], "cluster_id int, ticket_id int, service string")
        return {r["service"] for r in A.member_purity_flags(df).filter("flagged").collect()}

    assert flagged(("a", 18), ("b", 1), ("c", 1)) == {"b", "c"}
    assert flagged(("a", 6), ("b", 2), ("c", 1)) == {"c"}
    assert flagged(("a", 6), ("b", 2)) == set()


def test_topn_ties_and_floor(spark):
    pairs = spark.createDataFrame([(0, 1, 0.8), (0, 2, 0.8), (3, 4, 0.1)], "a int, b int, sim double")
    assert rows(W.topn_neighbours(pairs, 1, 0.4)) == [(0, 1, 0.8), (0, 2, 0.8)]
    assert W.topn_neighbours(pairs, 1, 0.9).count() == 0


def test_vetoes_newest_row_first(spark):
    log = spark.createDataFrame([(1, 7, 1, "audit_remove", "2024-01-30"), (2, 7, 1, "audit_keep", "2023-01-01"), (3, 8, 1, "audit_remove", "2024-01-30"), (4, 9, 1, "audit_remove", "2023-01-01")], "log_id int, ticket_id int, cluster_id int, action string, created_at string")
    assert rows(W.live_vetoes(log, F.lit("2024-02-01").cast("timestamp"))) == [(8, 1)]


def test_memberships_last_request_wins_and_claims(spark):
    cl = spark.createDataFrame([(1, "A"), (2, "B"), (3, "")], "cluster_id int, affected_system string")
    mb = spark.createDataFrame([(1, 10, "seed")], "cluster_id int, ticket_id int, assigned_by string")
    req = spark.createDataFrame([(10, "A", 1, "llm", 1), (10, "A", 3, "llm", 2), (11, "B", 3, "llm", 3), (12, "B", 1, "llm", 4)], "ticket_id int, system string, cluster_id int, assigned_by string, seq int")
    clusters, members, refused = M.apply_memberships(cl, mb, req)
    assert rows(members) == [(3, 10, "llm")]
    assert rows(refused.select("ticket_id", "cluster_id")) == [(11, 3), (12, 1)]
    assert {r["cluster_id"]: r["affected_system"] for r in clusters.collect()}[3] == "A"


def test_audit_floor_coverage_pin(spark):
    cl = spark.createDataFrame([(k, "active") for k in (1, 2, 3, 4)], "cluster_id int, status string")
    mb = spark.createDataFrame([(c, c * 10 + k, "human" if (c, k) == (1, 0) else "llm") for c in (1, 2, 3, 4) for k in range(3)], "cluster_id int, ticket_id int, assigned_by string")
    v = mb.select("cluster_id", "ticket_id", F.when((F.col("cluster_id") == 3) | (F.col("cluster_id").isin(1, 4) & (F.col("ticket_id") % 10 < 2)), "remove").otherwise("keep").alias("decision")).filter("not (cluster_id = 2 and ticket_id = 20)")
    clusters, members, log = M.apply_audit_verdicts(cl, mb, v)
    assert {r["cluster_id"]: r["result"] for r in log.collect()} == {1: "applied", 2: "coverage", 3: "floor", 4: "retired"}
    assert rows(members.filter("cluster_id = 1").select("ticket_id")) == [(10,), (12,)]
    assert members.filter("cluster_id = 4").count() == 0
    assert {r["cluster_id"]: r["status"] for r in clusters.collect()}[4] == "retired"


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(100, 101)], "a int, b int")
    assert {(r["component"]) for r in G.connected_components(edges).collect()} == {0, 100}


def test_pool_proposals_do_not_depend_on_order(spark):
    st = spark.createDataFrame([(i, "s") for i in range(4)], "ticket_id int, service string")
    pairs = [(0, 1, 0.7), (0, 2, 0.7), (1, 2, 0.7), (2, 3, 0.6)]
    verdicts = [(a, b, "NO" if b == 3 else "YES", "YES") for a, b, _ in pairs]
    none = spark.createDataFrame([], "ticket_id int")
    vectors = spark.createDataFrame([(i, [1.0, 0.1 * i]) for i in range(4)], "ticket_id int, embedding array<double>")
    got = []
    for order in (pairs, pairs[::-1]):
        p, _, members = G.pool_proposals(st, vectors, spark.createDataFrame(order, "a int, b int, sim double"), spark.createDataFrame(verdicts, "a int, b int, verdict string, second string"), none)
        got.append(rows(members.join(p, "component", "left_semi").select("ticket_id")))
    assert got == [[(0,), (1,), (2,)]] * 2


def test_cohesion_is_over_all_pairs(spark):
    """Three tickets with cosines 0.6, 0.5 and 0.0: the pair under the floor counts too, so the gate closes."""
    vectors = spark.createDataFrame([(1, [1.0, 0.0, 0.0]), (2, [0.6, 0.5, math.sqrt(0.39)]), (3, [0.0, 1.0, 0.0]), (4, [2.0, 0.0, 0.0]), (5, [3.0, 0.1, 0.0]), (6, [1.0, 0.2, 0.0]), (7, [0.0, 0.0, 0.0]), (8, None)], "ticket_id int, embedding array<double>")
    comps = spark.createDataFrame([(1, 1), (1, 2), (1, 3), (4, 4), (4, 5), (4, 6), (7, 7), (7, 8)], "component int, ticket_id int")
    flags = comps.select("component", "ticket_id", F.lit("s").alias("service"), F.lit(False).alias("flagged"))
    got = {r["component"]: (r["mean_sim"], r["passed"]) for r in A.cohesion_gate(comps, vectors, flags).collect()}
    assert got[1] == (round(1.1 / 3, 6), False)
    assert got[4][0] > 0.97 and got[4][1] and got[7] == (0.0, False)


def test_cohesion_equals_all_pairs(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 5))
    df = spark.createDataFrame([(k, [float(v) for v in row]) for k, row in enumerate(x)], "ticket_id int, embedding array<double>")
    got = A.cohesion(df.select((F.col("ticket_id") % 4).alias("component"), "ticket_id"), df).collect()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for r in got:
        part = u[np.arange(60) % 4 == r["component"]]
        a, b = np.triu_indices(len(part), 1)
        assert abs(r["mean_sim"] - (part @ part.T)[a, b].mean()) < 1e-6


def test_next_stamp(spark):
    df = spark.createDataFrame([(1, 100), (2, 200), (3, 300), (4, None)], "reference int, change_ms long")
    out = lambda *r: spark.createDataFrame(r, "reference int, result string")
    stamp = lambda o: I.changed_since(df, o, 50)[1].first()[0]
    assert stamp(out((1, "ok"), (2, "ok"), (3, "ok"))) == 301
    assert stamp(out((1, "ok"), (2, "failed"), (3, "ok"))) == 199
    assert stamp(out((1, "failed"),)) == 99


def test_knn_excludes_itself_and_keeps_order(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0, 0.0]), (1, [0.995, 0.1, 0.0]), (2, [0.0, 0.0, 1.0])], "vec_id long, embedding array<float>")
    assert [r["vec_id"] for r in J.knn_similar(df.filter("vec_id = 0"), df, 0.9, 5).collect()] == [1]


def test_score_batches_retries_and_redacts(spark):
    def flaky(prompts):
        if prompts[0] == "bad":
            raise ValueError("token=abcdefgh12345")
        return [p.upper() for p in prompts]

    df = spark.createDataFrame([(1, "bad")], "id long, prompt string")
    assert rows(X.score_batches(df, flaky, retries=0)) == [(1, None, "<redacted>")]
    assert rows(X.score_batches(df.withColumn("prompt", F.lit("ok")), flaky)) == [(1, "OK", None)]


def test_search_reads_only_candidates(spark, tmp_path):
    """Texts by title, id and description, in any case; only folders of the text's grams and of the tickets that have them all are read."""
    st = spark.createDataFrame([(k, f"Title {k}", "Printer on FIRE" if k == 7 else f"all quiet {k}" if k % 2 else None) for k in range(200)] + [(900, "ok", "x" * 30_000 + "needle" + "y" * 30_000)], "ticket_id long, title string, description string")
    V.save_search(st, str(tmp_path))
    find = lambda text: sorted(r["ticket_id"] for r in V.search_tickets(spark, str(tmp_path), text).collect())
    assert find("er on fire") == [7] and find("NEEDLE") == [900] and find("quiet 19") == [19, *range(191, 200, 2)] and find("title 7") == [7, *range(70, 80)]
    assert find("no such text") == [] and 7 in find("7") and find("fire\x007") == []
    plan = V.search_tickets(spark, str(tmp_path), "needle")._jdf.queryExecution().toString()
    pruned = re.search(r"PartitionFilters: \[[^\]]*bucket#\d+ (?:= \d+|IN \(\d+\))", plan)
    assert pruned is not None


def test_search_of_clusters(spark):
    cl = spark.createDataFrame([(1, "active", "Login", "SysA"), (2, "active", "Printing", ""), (3, "retired", "Login", "SysA"), (4, "active", "Mail", "SysB")], "cluster_id long, status string, name string, affected_system string")
    mb = spark.createDataFrame([(1, 1), (1, 2), (1, 3), (2, 4), (2, 5), (3, 6), (3, 7), (4, 8)], "cluster_id long, ticket_id long")
    st = spark.createDataFrame([(k, f"t{k}", "login fails" if k == 5 else "x", "SysA", "svc", "Critical" if k == 4 else "Minor", "north" if k in (1, 4) else "south") for k in range(1, 9)], "ticket_id long, title string, description string, affected_system string, service string, severity string, assign_group string")
    find = lambda *a, **k: [(r["cluster_id"], r["n"]) for r in V.search_clusters(cl, mb, st, *a, **k).collect()]
    assert find() == [(1, 3), (2, 2)]
    assert find("LOGIN") == [(1, 3), (2, 2)] and find("fails") == [(2, 2)] and find("t3") == [(1, 3)]
    assert find("login", team="north") == [(1, 1)] and find(team="north") == [(2, 1), (1, 1)]
    assert find(severity="Critical") == [(2, 2)] and find(system="SysB") == []


def test_sql_functions_are_the_column_functions(spark):
    X.register_sql(spark)
    text = "Full name: Jane Roe, passport no: AB12345, call +966 501234567 or mail a.b@c.org; code 5678"
    df = spark.createDataFrame([(text, "<b>Run 12.5</b>  now", [1.0, 2.0], [2.0, 1.0]), (None, None, [0.0, 0.0], [1.0, 0.0])], "s string, d string, a array<double>, b array<double>")
    got = df.selectExpr("tf_mask_pii(s)", "tf_content_hash(s, d)", "tf_cosine(a, b)").collect()
    want = df.select(S.mask_pii(F.col("s")), S.content_hash(F.col("s"), F.col("d")), S.cosine(F.col("a"), F.col("b"))).collect()
    assert list(map(tuple, got)) == list(map(tuple, want)) and "[EMAIL]" in got[0][0] and "[NAME]" in got[0][0]


def test_cosine_of_a_missing_vector_is_null(spark):
    X.register_sql(spark)
    df = spark.createDataFrame([([1.0, 0.0], None), (None, None), ([0.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    for rows in (df.selectExpr("tf_cosine(a, b)", "tf_cosine(b, a)"), df.select(S.cosine(F.col("a"), F.col("b")), S.cosine(F.col("b"), F.col("a")))):
        assert list(map(tuple, rows.collect())) == [(None, None), (None, None), (0.0, 0.0)]


def test_batches_given_to_a_callable_are_those_of_batch_assign(spark):
    seen = spark.sparkContext.accumulator(0)

    def fn(prompts):
        seen.add(1)
        assert prompts == sorted(prompts) and len(prompts) <= 4
        return [f'{{"kind": "{len(prompts)}"}}' for _ in prompts]

    df = spark.createDataFrame([(k, f"{k:03}", k % 2) for k in range(21)], "id long, prompt string, team long").repartition(5)
    got = X.score_batches(df, fn, 4, by=["team"], fields=["kind"])
    assert sorted((r["id"], r["kind"]) for r in got.collect()) == [(k, str(4 if k < 16 else 2 if k % 2 else 3)) for k in range(21)]
    assert got.count() == 21 and seen.value == 6


def test_sql_of_the_next_stamp_and_of_pruning_on_large_keys():
    """The SQL holds the stamp for a failed row without a time, and prunes by the listed nodes where keys pass the offset of the second part."""
    con = duckdb.connect()
    con.execute("CREATE TABLE events AS SELECT * FROM (VALUES (4573976, TIMESTAMP '2024-01-20'), (5, TIMESTAMP '2024-01-21')) v(event_id, ts)")
    assert con.execute(ORACLE["changed_since"]).fetchall() == [(1_704_500_000_000,)]
    con.execute("CREATE TABLE embeddings AS SELECT * FROM (VALUES (100001, 1), (100002, 1), (100003, 1), (100004, 1), (1, 1)) v(vec_id, label)")
    assert sorted(con.execute(ORACLE["drift_prune"]).fetchall()) == sorted([(200001, 100001), (200002, 100001), (200003, 100001), (100002, 33334), (100003, 33334), (100004, 33334)])


@pytest.mark.parametrize("module", [queries, queries_state])
def test_helpers_of_queries_are_defined_once(module):
    """A query calls its helpers when it runs, so a second lambda of a name takes the place of the first in all queries before it."""
    lambdas = [s.targets[0].id for s in ast.parse(inspect.getsource(module)).body if isinstance(s, ast.Assign) and isinstance(s.value, ast.Lambda)]
    assert sorted(set(lambdas)) == sorted(lambdas)
