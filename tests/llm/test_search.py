"""Embedding duplicates, spelling variants and source divergence against brute force, and on odd tables."""

import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from ticketflow.llm import divergence as dv
from ticketflow.llm import embedding_pq as pq
from ticketflow.llm import spelling as sp
from ticketflow.llm.terms import latin_letters

from .conftest import words

LOWER = {c: c + 32 for c in range(65, 91)}
VECTORS = "vec_id long, embedding array<double>, label int, node string, list int, times long"


def vector_frame(spark, rows):
    return spark.createDataFrame([(i, [float(x) if x is not None else None for x in v] if v is not None else None, 1, "n", 2, 3) for i, v in rows], VECTORS)


def brute_vectors(rows, least=0.95):
    """Links by all pairs -> rows of (vec_id, n_links, component_id, kept)."""
    good = [k for k, (_, v) in enumerate(rows) if v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    near = defaultdict(set)
    for a in good:
        for b in good:
            if a < b and len(rows[a][1]) == len(rows[b][1]):
                x, y = np.array(rows[a][1], float), np.array(rows[b][1], float)
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= least:
                    near[a].add(b)
                    near[b].add(a)
    out = []
    for k, (i, _) in enumerate(rows):
        seen, todo = {k}, [k]
        while todo:
            for x in near[todo.pop()] - seen:
                seen.add(x)
                todo.append(x)
        ids = [rows[x][0] for x in seen if rows[x][0] is not None]
        c = min(ids) if ids else None
        out.append((i, len(near[k]), c, i == c))
    return out


def order(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x) for x in r))


@pytest.mark.parametrize("per_list", [40, 10**6])
def test_vectors_against_all_pairs(spark, monkeypatch, per_list):
    """Groups of near copies at all distances round the limit, a hot group, equal vectors, several tiles; with one list the result is exact."""
    monkeypatch.setattr(pq, "PER_LIST", per_list)
    monkeypatch.setattr(pq, "BLOCK", 64)
    rng = np.random.default_rng(5)
    vecs = list(rng.normal(size=(300, 24)))
    for k in range(60):
        x, y = vecs[k], rng.normal(size=24)
        y -= y @ x / (x @ x) * x
        c = rng.uniform(0.93, 0.97)
        vecs.append(c * x / np.linalg.norm(x) + np.sqrt(1 - c * c) * y / np.linalg.norm(y))
    vecs += [vecs[0] + rng.normal(size=24) * 0.15 for _ in range(200)] + [vecs[1]] * 30
    rows = [(1000 - k, list(v)) for k, v in enumerate(vecs)]
    got = [tuple(r) for r in pq.embedding_duplicates(vector_frame(spark, rows)).select("vec_id", "n_links", "component_id", "kept").collect()]
    want = brute_vectors(rows)
    if per_list > len(rows):
        assert order(got) == order(want)
    links = {r[0]: r[1] for r in want}
    assert all(n <= links[i] for i, n, _, _ in got) and sum(r[1] for r in got) >= 0.97 * sum(links.values())


def test_odd_vectors(spark):
    one = [1.0, 2.0, 3.0]
    rows = [(1, None), (2, []), (3, [0.0, 0.0, 0.0]), (4, [1.0, None, 2.0]), (5, [1.0, float("nan"), 2.0]), (6, [float("inf"), 0.0, 1.0]), (7, one), (7, one), (8, one), (None, one), (None, [3.0, -1.0, 0.0]), (9, [1e200, 2e200, 3e200]), (10, [1.0, 2.0]), (11, [2.0, 4.0]), (12, [1e-200, 0.0])]
    got = [tuple(r) for r in pq.embedding_duplicates(vector_frame(spark, rows)).select("vec_id", "n_links", "component_id", "kept").collect()]
    want = []
    for i, v in rows:
        n, c = {7: (4, 7), 8: (4, 7), 9: (4, 7), 10: (1, 10), 11: (1, 10)}.get(i, (4, 7) if v == one else (0, i))
        want.append((i, n, c, i == c))
    assert order(got) == order(want)
    assert pq.embedding_duplicates(vector_frame(spark, [])).count() == 0


def test_table_distances_bound_true_ones():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 20))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    q = pq.fit(x, 5, 0.95)
    own, codes, error = pq.encode(x, q)
    for k in range(5):
        member = np.flatnonzero(own == k)
        got = pq.table_distances(x, q.centers[k], codes[member], q)
        true = np.linalg.norm(x[:, None] - x[member], axis=2)
        assert (np.abs(got - true) <= error[member] + 1e-9).all()


def test_probes_find_pairs_at_the_threshold():
    """Pairs at the cosine 0.95, in 64 dimensions and in groups of 8: nearly all are found from the one side that asks, and few lists are asked."""
    rng = np.random.default_rng(3)
    for x in (rng.normal(size=(12_000, 64)), rng.normal(size=(300, 8))[rng.integers(0, 300, 12_000)] + 0.3 * rng.normal(size=(12_000, 8))):
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        q = pq.fit(x[:6000], 46, 0.95)
        aside = rng.normal(size=x.shape)
        aside -= (aside * x).sum(axis=1, keepdims=True) * x
        y = 0.95 * x + np.sqrt(1 - 0.95**2) * aside / np.linalg.norm(aside, axis=1, keepdims=True)
        own, other = pq.encode(x, q)[0], pq.encode(y, q)[0]
        ask, ask_y = pq.probes(x, own, q), pq.probes(y, other, q)
        at = np.arange(len(x))
        found = np.where(own <= other, ask[at, other], ask_y[at, own])
        assert found.mean() >= 0.985 and ask.sum(axis=1).mean() < 12


def brute_words(docs):
    n = Counter()
    for i, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    return {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}


def edits(w, letters):
    out = {w[:k] + w[k + 1 :] for k in range(len(w))}
    out |= {w[:k] + c + w[k:] for k in range(len(w) + 1) for c in letters}
    return out | {w[:k] + c + w[k + 1 :] for k in range(len(w)) for c in letters} - {w}


def brute_spelling(docs):
    n = brute_words(docs)
    letters = set("".join(n))
    near = {w: sorted(x for x in edits(w, letters) if x in n and x != w) for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return out


def spelled(spark, docs):
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in docs], "doc_id long, text string, word string, n string")
    return [tuple(r) for r in sp.spelling_variants(df).select("word", "form", "root", "n", "n_near", "form_n").collect()]


@pytest.mark.parametrize("frequent, longest", [(32, 32), (1, 4)])
def test_spelling_against_all_edits(spark, monkeypatch, frequent, longest):
    """Base words of very different frequency, variants by each kind of edit at each place, words in long lists."""
    monkeypatch.setattr(sp, "FREQUENT", frequent)
    monkeypatch.setattr(sp, "LIST", longest)
    rng = random.Random(7)
    base = ["".join(rng.choice("abé") for _ in range(rng.randrange(7, 12))) for _ in range(60)] + ["aaaaaaa", "aaaaaaaa", "abababab", "ÿ÷×ÀÀÀÀÀ"]
    docs = []
    for k in range(300):
        text = []
        for w in rng.choices(base, [2.0**-i for i in range(len(base))], k=60):
            if rng.random() < 0.3:
                w = rng.choice(sorted(edits(w, "abcéÉ")))
            text.append(rng.choice([w, w.upper() if "é" not in w else w]))
        docs.append((k if k % 50 else None, rng.choice([" ", ", ", "\n", "1", "—"]).join(text)))
    docs += docs[:20] + [(5, None), (6, ""), (7, "short one"), (8, "x" * 150 + " " + "x" * 150 + " " + "x" * 149 + " " + "x" * 149)]
    assert sorted(spelled(spark, docs), key=str) == sorted(brute_spelling(docs), key=str)


def test_roots_follow_chains(spark):
    docs = [(k, " ".join(["qwertyuiop"] * 3)) for k in range(200)] + [(1000, "qwertyuio " * 30), (1001, "qwertyui " * 2)]
    got = {r[0]: r for r in spelled(spark, docs)}
    want = {r[0]: r for r in brute_spelling(docs)}
    assert got == want


def test_spelling_of_nothing(spark, nothing, odd):
    assert sp.spelling_variants(nothing).count() == 0
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert sorted(map(tuple, sp.spelling_variants(odd).collect()), key=str) == sorted(brute_spelling(rows), key=str)


def test_crc_of_many_slices():
    rng = random.Random(4)
    data = bytes(rng.randrange(256) for _ in range(3000))
    start = [rng.randrange(2000) for _ in range(300)]
    end = [s + rng.choice([0, 1, 7, 64, 65, 900]) for s in start]
    before = [zlib.crc32(str(k).encode()) for k in range(300)]
    got = sp.crc_after(np.array(before, np.uint32), np.frombuffer(data, np.uint8), np.array(start), np.array(end))
    assert got.tolist() == [zlib.crc32(data[a:b], c) for a, b, c in zip(start, end, before)]


def test_latin_letters():
    text = "aZ À÷ÿ Āx ßß¿Āé日é"
    data = np.frombuffer(text.encode() + b"\n", np.uint8)
    got = bytes(np.where(latin_letters(data), data, 32).astype(np.uint8)).decode(errors="replace").split()
    assert got == re.findall("[A-Za-zÀ-ÿ]+", text)


def by_sql(rows):
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar, lang varchar, source varchar)")
    con.executemany("insert into documents values (?, ?, ?, ?)", rows)
    return [tuple(r) for r in con.execute(dv.ORACLE).fetchall()]


def divided(spark, rows):
    df = spark.createDataFrame([(*r, "a", 1, 2) for r in rows], "doc_id long, text string, lang string, source string, term string, n long, gid long")
    return [tuple(r) for r in dv.divergence(df).select("lang", "source", "part", "item", "value", "rank").collect()]


def test_divergence_against_sql(spark, monkeypatch):
    """More sources than a block, several buckets, languages without kept terms, null and empty values, repeated rows."""
    monkeypatch.setattr(dv, "BUCKET", 16)
    monkeypatch.setattr(dv, "BLOCK", 4)
    rng = random.Random(6)
    vocab = [f"{'Été'[: 1 + k % 3]}w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(120)]
    rows = [(k, rng.choice([" ", "1", ".\n"]).join(rng.choices(vocab, [1 / (1 + i) for i in range(120)], k=rng.randrange(80))), rng.choice(["en", "en", "en", "de"]), f"s{rng.randrange(11)}") for k in range(400)]
    rows += rows[:30] + [(900, None, None, None), (901, "", "", "x"), (902, " 12 ", "en", None), (903, "one two", "fr", "a"), (904, "one", "fr", "b"), (905, None, "it", "alone")]
    assert sorted(divided(spark, rows)) == sorted(by_sql(rows))


def test_divergence_of_nothing(spark, nothing):
    assert dv.divergence(nothing).count() == 0


def test_divergence_of_a_long_text(spark):
    text = words(random.Random(2), 200_000, 3).replace("0", "a").replace("1", "b").replace("2", "c")
    rows = [(k, "wa wb wc wc", "en", "x") for k in range(40)] + [(99, text, "en", "y")]
    assert sorted(divided(spark, rows)) == sorted(by_sql(rows))


def test_shares_of_large_counts():
    rng = random.Random(8)
    for _ in range(300):
        d = rng.randrange(10, 9 * 10**15)
        n = rng.randrange(0, d - 5)
        assert int(dv.share(np.array([n]), np.array([d]))[0]) == 1 + 10**9 * (n + 5) // d


def test_forest_prices_equal_pairs_once(monkeypatch):
    rng = np.random.default_rng(9)
    counts = rng.integers(0, 3, size=(12, 100))
    counts[3:9] = counts[2]
    priced = []
    whole = dv.share
    monkeypatch.setattr(dv, "share", lambda n, d: priced.append(len(n)) or whole(n, d))
    a, b = np.triu_indices(12, 1)
    d = np.full(12, 700)
    got = dv.Forest(counts).distances(a, b, d)
    want = [np.abs(whole(counts[x], d[:1]) - whole(counts[y], d[:1])).sum() for x, y in zip(a, b)]
    assert got.tolist() == want and max(priced) <= 16
