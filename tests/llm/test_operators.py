"""The operators against brute force, on small tables and on odd ones."""

import hashlib
import random
import re
import textwrap
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ticketflow.llm import decontam, mixing, ngram_join, quality_rules, secret_scan, substring_dedup, suffix_dedup, text, toxicity
from ticketflow.llm.graph import components
from ticketflow.llm.licenses import BSD_2, BSD_3, BSL_1, ISC, KNOWN, MIT, TEXTS, ZLIB, canonical_text, license_passages, license_scan
from ticketflow.llm.quality_qda import Discriminant, quality_classifier

from .conftest import frame, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def near_copies(rng, base, n, edits):
    out = []
    for _ in range(n):
        w = base.split()
        for _ in range(edits):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.fixture(scope="module")
def corpus(spark):
    """Copies, near copies, a shared passage, and unrelated texts of many sizes."""
    rng = random.Random(1)
    texts = [words(rng, rng.choice([2, 4, 5, 6, 9, 30, 60, 150, 400])) for _ in range(60)]
    passage = words(rng, 70)
    texts += [f"{words(rng, 60)} {passage} {words(rng, 60)}" for _ in range(40)]
    for size, edits in ((12, 1), (60, 2), (200, 4), (700, 12), (700, 14)):
        texts += near_copies(rng, words(rng, size, 5000), 25, edits)
    texts += texts[:20]
    return frame(spark, [(i, t, f"s{i % 3}") for i, t in enumerate(texts)]), texts


def shingle_set(text):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute_rows(rows):
    """(doc_id, n_shingles, component_id) of each row: rows link by text, or by a doc_id that they share."""
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [shingle_set(t) for _, t in rows]
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and (100 * len(a & b) >= 80 * len(a | b) or rows[i][0] is not None and rows[i][0] == rows[j][0]):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least.setdefault(find(i), set()).update([] if d is None else [d])
    return [(d, len(s), min(least[find(i)], default=None) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets))]


def brute_components(rows):
    return {i: (n, c) for i, n, c in brute_rows(rows)}


def in_order(rows):
    return sorted(rows, key=lambda r: [(x is None, x or 0) for x in r])


def test_ngram_jaccard_matches_brute_force(spark, corpus):
    df, texts = corpus
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_components(df).collect()}
    assert got == brute_components(list(enumerate(texts)))


def test_ngram_jaccard_tiles_and_self_join_agree(spark, corpus, monkeypatch):
    monkeypatch.setattr(ngram_join, "SELF_JOIN", 1)
    monkeypatch.setattr(ngram_join, "TILE", 4)
    df, texts = corpus
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_components(df).collect()}
    assert got == brute_components(list(enumerate(texts)))


@pytest.mark.parametrize("parts", (1, 3, 7))
def test_ngram_jaccard_with_shared_and_null_ids(spark, parts):
    rng = random.Random(17)
    base, other, third = (words(rng, n, 9000) for n in (150, 150, 80))
    rows = [(5, base), (None, base), (None, near_copies(rng, base, 1, 2)[0]), (6, other), (6, near_copies(rng, third, 1, 1)[0]), (9, third), (12, near_copies(rng, other, 1, 1)[0]), (12, " "), (20, words(rng, 60, 9000)), (None, words(rng, 60, 9000)), (None, None), (7, words(rng, 30, 9000))]
    got = ngram_join.jaccard_components(frame(spark, [(i, t, "s") for i, t in rows]).repartition(parts)).select("doc_id", "n_shingles", "component_id").collect()
    assert in_order(map(tuple, got)) == in_order(brute_rows(rows))


def test_ngram_jaccard_on_odd_rows(spark, odd):
    got = ngram_join.jaccard_components(odd).select("doc_id", "n_shingles", "component_id").collect()
    assert in_order(map(tuple, got)) == in_order(brute_rows([(r["doc_id"], r["text"]) for r in odd.collect()]))


def test_bitmap_of_a_table_keeps_all_its_keys(spark, monkeypatch):
    rng = random.Random(25)
    held, others = ([rng.randrange(-(2**63), 2**63) for _ in range(500)] for _ in range(2))
    held += [0, -1, 1, 2**63 - 1, -(2**63)]
    rows = spark.createDataFrame([(k, i) for i, k in enumerate(held + others)], "key long, i long")
    for bits, most in ((1 << 28, 20), (1 << 15, 60), (8, 500)):
        monkeypatch.setattr(text, "BITMAP_BITS", bits)
        kept = {r["i"] for r in text.maybe_in(rows, "key", text.bitmap_of(spark.createDataFrame([(k,) for k in held], "key long"), "key")).collect()}
        assert kept >= set(range(len(held))) and len(kept) - len(held) <= most


def test_bitmaps_never_reject_a_link():
    rng = np.random.default_rng(5)
    for n in (10, 45, 100, 1000, 9000):
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[: int(0.95 * n)], rng.integers(0, 2**63, n // 25).astype(np.uint64)]))
        x, y = ngram_join.bitmap(a), ngram_join.bitmap(b)
        width = 8 * min(len(x), len(y))
        if ngram_join.linked(a, b):
            assert ngram_join.may_link(len(a), ngram_join.fold(x, width), len(b), ngram_join.fold(y, width))


def test_components(spark):
    links = spark.createDataFrame([(i + 1, i) for i in range(40)] + [(90, 91), (91, 92)], "a long, b long")
    assert {r["component"] for r in components(links).collect()} == {0, 90}


def brute_removed(texts, length=200):
    data = [(t or "").encode() for t in texts]
    count = Counter(t[i : i + length] for t in data for i in range(len(t) - length + 1))
    out = []
    for t in data:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                gone[i : i + length] = b"\x01" * length
        kept = bytes(c for c, g in zip(t, gone) if not g)
        out.append((len(t), sum(gone), len(re.findall(b"\x01+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return out


def test_suffix_dedup_matches_brute_force(spark):
    rng = random.Random(8)
    passage, short = words(rng, 70), words(rng, 38)
    texts = [f"{words(rng, 80, 9000)} {passage[k:]} {words(rng, 40, 9000)} {short} x" for k in range(0, 60, 3)] + [words(rng, 60)] * 2 + [None, "", "é" * 300, "ab" * 400, passage * 2]
    texts += [f"{passage[: 100 + k]}{words(rng, 30, 9000)}" for k in range(80, 200, 7)]
    df = frame(spark, [(i, t, "s") for i, t in enumerate(texts)])
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.remove_repeats(df).collect()}
    assert got == dict(enumerate(brute_removed(texts)))


def removed(df):
    names = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    return in_order([tuple(r[k] for k in names) for r in suffix_dedup.remove_repeats(df).collect()])


def test_suffix_dedup_of_hot_anchors_and_odd_rows(spark, odd, monkeypatch):
    rng = random.Random(9)
    passage, line = words(rng, 90), words(rng, 45)
    texts = [f"{words(rng, 20, 9000)} {passage[k : k + 320]} {words(rng, 20, 9000)}" for k in range(0, 120, 2)]
    texts += [f"{words(rng, rng.randrange(3), 9000)} {line} {words(rng, 3, 9000)}" for _ in range(150)]  # one passage, each time with other words around
    texts += [f"{line[:-k]}{'x' * k} {words(rng, 3, 9000)}" for k in range(1, 40)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, texts[0]), (3, texts[70]), (None, None)]
    wanted = in_order([(i, *x) for (i, _), x in zip(rows, brute_removed([t for _, t in rows]))])
    df = frame(spark, [(i, t, "s") for i, t in rows])
    for few in (1, 64):
        monkeypatch.setattr(suffix_dedup, "FEW", few)
        assert removed(df) == wanted
    given = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert removed(odd) == in_order([(i, *x) for (i, _), x in zip(given, brute_removed([t for _, t in given]))])


def test_fuzzy_passages(spark):
    rng = random.Random(4)
    passage = words(rng, 80, 9000)
    texts = [f"{words(rng, 50, 9000)} {p} {words(rng, 50, 9000)}" for p in [passage, *near_copies(rng, passage, 3, 5)]] + [words(rng, 150, 9000) for _ in range(10)]
    got = substring_dedup.fuzzy_passages(frame(spark, [(i, t, "s") for i, t in enumerate(texts)])).collect()
    assert {r["doc_id"] for r in got} | {r["other_id"] for r in got} == {0, 1, 2, 3}
    assert all(abs(r["first"] - 50) < 8 and abs(r["last"] - 129) < 8 and r["identity"] >= 0.8 for r in got)


def test_fuzzy_passages_split_at_unrelated_words(spark):
    rng = random.Random(14)
    gaps, texts = [(40, 40), (80, 80), (150, 150), (250, 250), (300, 300), (300, 60), (220, 190)], []
    for pair in gaps:
        one, two = words(rng, 60, 9000), words(rng, 60, 9000)
        texts += [f"{words(rng, 20, 9000)} {one} {words(rng, n, 9000)} {two} {words(rng, 20, 9000)}" for n in pair]
    got = defaultdict(list)
    for r in substring_dedup.fuzzy_passages(frame(spark, [(i, t, "s") for i, t in enumerate(texts)])).collect():
        got[r["other_id"], r["doc_id"]].append((r["other_first"], r["other_last"], r["first"], r["last"]))
    assert set(got) == {(2 * i, 2 * i + 1) for i in range(len(gaps))}
    for i, (n, m) in enumerate(gaps):
        wanted = [(20, 79, 20, 79), (80 + n, 139 + n, 80 + m, 139 + m)]
        assert np.abs(np.array(sorted(got[2 * i, 2 * i + 1])) - wanted).max() <= 3


def test_fuzzy_passages_whose_seeds_have_other_first_holders(spark):
    rng = random.Random(15)
    texts = []
    for k in range(6):  # the halves; a third of the passage and words around; what holds only the middle
        p = words(rng, 60, 9000).split()
        parts = {0: (p[:30], p[30:]), 1: (p[:38], p[22:]), 2: (p[:20], p[20:40], p[40:]), 3: (p[10:45],), 4: (p[:30], p[30:]), 5: (p[:39], p[11:50], p[21:])}[k]
        texts += [" ".join([words(rng, 40, 9000), *part, words(rng, 40, 9000)]) for part in parts]
        texts += [" ".join([words(rng, 40, 9000), *p, words(rng, 40, 9000)]) for _ in range(2 + k % 2)]
    rows = [(i, t, "s") for i, t in enumerate(texts)]
    got = substring_dedup.fuzzy_passages(frame(spark, rows)).collect()
    spans = defaultdict(set)
    for r in got:
        spans[r["doc_id"]] |= set(range(r["first"], r["last"] + 1))
        spans[r["other_id"]] |= set(range(r["other_first"], r["other_last"] + 1))
    whole = [i for i, t in enumerate(texts) if len(t.split()) == 140]
    assert len(whole) == 15 and all(spans[i] >= set(range(40, 100)) for i in whole)


def test_long_gaps_count_equal_positions():
    x = np.arange(400)
    assert substring_dedup._common(x, x[:300]) == substring_dedup._common(x[100:], x) == 300
    assert substring_dedup._common(np.tile(x, 3), np.append(x[50:], 7)) == 351  # the 7 after the end comes from the next round


def test_chain_is_collinear_and_best():
    a, b = [0, 5, 10, 15, 20], [0, 5, 40, 10, 15]
    best = max(substring_dedup.chain(a, b), key=len)
    assert [(a[m], b[m]) for m in best] == [(0, 0), (5, 5), (15, 10), (20, 15)]


def test_license_scan(spark):
    changed = "Copyright (c) 2020 Someone\n\n" + MIT.upper().replace(" ", "  ").replace("SUBLICENSE", "SUB-LICENCE") + "\n"
    df = frame(spark, [(1, changed, "s"), (2, MIT + " and more", "s"), (3, None, "s"), (4, " ... ", "s")])
    got = {r["doc_id"]: (r["digest"] is None, r["license_id"]) for r in license_scan(df).collect()}
    assert got == {1: (False, "MIT"), 2: (False, None), 3: (True, None), 4: (True, None)}
    assert canonical_text(changed) == canonical_text(MIT)


def test_license_files_as_they_are_found(spark, odd, nothing):
    """Titles, holders, wrapping, list marks, comment signs and spellings, written out by hand rather than from the patterns."""
    wrap = lambda t, n: "\n\n".join(textwrap.fill(p, n) for p in t.split("\n\n"))
    holder = "Copyright (c) 2011-2024, Some One <some@one.org>\nAll rights reserved.\n\n"
    body = MIT.removeprefix("MIT License\n\n")
    cases = [
        ("MIT", f"The MIT License (MIT)\n\nCopyright © 2020 X\n\n{wrap(body, 72)}\n"), ("MIT", f"MIT License\n\n{holder}{wrap(body, 50)}"), ("MIT", "/*\n" + "\n".join(f" * {x}" for x in wrap(body, 60).split("\n")) + "\n */"), ("MIT", body.replace("sublicense", "sub-licence")),
        ("ISC", f"ISC License\n\nCopyright (c) 2004-2010 by Internet Consortium\n\n{wrap(ISC, 64)}"), ("ISC", f"The ISC License (ISC)\n{wrap(ISC, 40)}"), ("ISC", wrap(ISC, 78)),
        ("BSD-2-Clause", f"BSD 2-Clause License\n\n{holder}{wrap(BSD_2, 75)}"), ("BSD-2-Clause", holder + wrap(BSD_2, 70).replace("1. ", "* ").replace("2. ", "* ")), ("BSD-3-Clause", f"The 3-Clause BSD License\n\n{holder}{BSD_3.replace('COPYRIGHT HOLDER OR', 'COPYRIGHT OWNER OR')}"), ("BSD-3-Clause", f"Copyright 2003 X.\n{wrap(BSD_3, 79).replace('1. ', '  a) ').replace('2. ', '  b) ').replace('3. ', '  c) ')}"),
        ("Zlib", f"zlib License\n\n(C) 1995-2022 A and B\n\n{wrap(ZLIB, 77)}"), ("BSL-1.0", wrap(BSL_1, 70)), ("BSL-1.0", BSL_1.replace("organization", "organisation")),
    ]
    for name in ("Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-1.1", "MPL-2.0", "CC0-1.0", "GFDL-1.3"):
        text = (TEXTS / f"{name}.txt").read_text()
        cases += [(name, text), (name, text.upper().replace("\n", "\r\n")), (name, re.sub(r"[^\S\n]+", " ", text.replace("license", "licence"))), (None, text.replace("the", "teh", 1))]
    cases += [("GPL-2.0", (TEXTS / "GPL-2.0.txt").read_text().partition("END OF TERMS")[0]), (None, body + " Not."), (None, "copyright notice and this permission notice"), (None, "")]
    got = {r["doc_id"]: r["license_id"] for r in license_scan(frame(spark, [(i, t, "s") for i, (_, t) in enumerate(cases)])).collect()}
    assert [got[i] for i in range(len(cases))] == [name for name, _ in cases]
    digests = {r["doc_id"]: r["digest"] for r in license_scan(odd).collect()}
    assert digests[0] is digests[1] is digests[2] is None and digests[3] == digests[4] == hashlib.sha256(b"one").hexdigest() and license_scan(nothing).collect() == []


def test_license_passages(spark, odd, nothing):
    prose = "Some words here.\nAnd more of them."
    wrapped = "\n\n".join("\n".join(p[i : i + 70] for i in range(0, len(p), 70)) if k == 3 else p.replace(", ", ",\n") for k, p in enumerate(MIT.split("\n\n")[:3])) + "\n\n" + MIT.split("\n\n")[3]
    texts = [f"{prose}\nReleased under the MIT License.", f"{prose}\nLicensed under CC BY-NC 4.0.\n{prose}", f"{prose}\n\nCopyright (c) 2020 X\n\n{wrapped}\n\n{prose}", MIT.split("\n\n")[1], None, "",
             f"{prose}\n\n{(TEXTS / 'Apache-2.0.txt').read_text()}\n\n{prose}", f"{(TEXTS / 'GPL-3.0.txt').read_text()}\n{prose}\nReleased under the MIT License.\n{prose}\nReleased under the MIT License.", prose]
    got = {(r["doc_id"], r["license_id"]): r["places"] for r in license_passages(frame(spark, [(i, t, "s") for i, t in enumerate(texts)])).collect()}
    assert got.pop((6, "Apache-2.0")) >= 1
    assert got == {(0, "MIT"): 1, (1, "CC-BY-NC-4.0"): 1, (2, "MIT"): 1, (7, "GPL-3.0"): 1, (7, "MIT"): 2}
    assert license_passages(odd).collect() == license_passages(nothing).collect() == []


def water_fill(sizes, weights, limit=3):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    total, target, open_ = sum(sizes.values()), {}, set(sizes)
    while open_:
        rest = total - sum(target.values())
        share = {s: rest * w[s] / sum(w[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > limit * sizes[s]}
        if not over:
            return target | share
        target |= {s: limit * sizes[s] for s in over}
        open_ -= over
    return target


def test_mixing(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RESERVE_ROWS", 20)
    rng = random.Random(2)
    rows = [(i, words(rng, rng.choice([3, 20, 50, 400])), rng.choice(["a", "a", "a", "b", "c", "d", None])) for i in range(900)] + [(900 + i, "few words", "tiny") for i in range(3)]
    df = frame(spark, rows)
    got = mixing.mix_sources(df, block_rows=64).collect()
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(t.split())
    wanted = water_fill(sizes, (1, 2, 3))
    taken = defaultdict(int)
    for r in got:
        assert r["taken"] <= 3 * r["size"] and r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(wanted[r["source"]])
        taken[r["source"]] += r["taken"]
    assert len(got) == len(rows)
    assert all(abs(taken[s] - wanted[s]) <= 60 for s in wanted)
    again = mixing.mix_sources(df.repartition(7), block_rows=64)
    assert sorted((r["doc_id"], r["taken"]) for r in again.collect()) == sorted((r["doc_id"], r["taken"]) for r in got)


def test_mixing_with_shared_and_missing_ids(spark, odd):
    rng = random.Random(22)
    rows = [(None, words(rng, 30), "a")] * 300 + [(7, words(rng, 9), "b")] * 200 + [(None, words(rng, rng.choice([5, 60])), "c") for _ in range(100)] + [(i, words(rng, 40), "b") for i in range(50)]
    df = frame(spark, rows)
    got = mixing.mix_sources(df, block_rows=32).collect()
    sizes, taken = defaultdict(int), defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(t.split())
    for r in got:
        taken[r["source"]] += r["taken"]
    wanted = water_fill(sizes, (1, 2, 3))
    assert all(abs(taken[s] - wanted[s]) <= 60 for s in wanted)
    assert Counter((r["doc_id"], r["source"], r["size"]) for r in got) == Counter((i, s, len(t.split())) for i, t, s in rows)
    again = mixing.mix_sources(df.repartition(5), block_rows=32).collect()
    assert Counter((r["doc_id"], r["source"], r["taken"]) for r in again) == Counter((r["doc_id"], r["source"], r["taken"]) for r in got)
    odd_rows = [(r["doc_id"], r["source"], len(WORD.findall(r["text"] or ""))) for r in odd.collect()]
    assert Counter((r["doc_id"], r["source"], r["size"]) for r in mixing.mix_sources(odd).collect()) == Counter(odd_rows)


def test_flight_keeps_count_and_size():
    rng = random.Random(6)
    sizes, p = [rng.randrange(1, 500) for _ in range(400)], [0.37] * 400
    mixing.fly(sizes, p, rng)
    assert sum(0 < x < 1 for x in p) <= 2
    assert sum(p) == pytest.approx(0.37 * 400) and sum(s * x for s, x in zip(sizes, p)) == pytest.approx(0.37 * sum(sizes))


def brute_quality(text):
    text = text or ""
    w = WORD.findall(text)
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines, seen, dup = text.split("\n"), set(), 0
    for x in lines:
        if WORD.search(x):
            dup += x in seen
            seen.add(x)
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w))


def test_quality_rules_base(spark, odd, corpus):
    rng = random.Random(7)
    prose = lambda: words(rng, 12, 9000).translate(str.maketrans("0123456789", "aeioubcdfg"))
    extra = frame(spark, [(500, "\n".join([words(rng, 8)] * 9) + "\n#$% ünï | <b>\n", "s"), (501, words(rng, 90, 4), "s"), (502, "\n".join(prose() + "." for _ in range(12)), "s"), (503, "\n".join(" ".join(f"{x}$$$" for x in words(rng, 12, 9000).split()) for _ in range(12)), "s")])
    df = odd.unionByName(corpus[0].limit(80)).unionByName(extra)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    got = sorted([r["doc_id"], *(r[k] for k in names)] for r in quality_rules.quality_rules(df).collect())
    assert got == sorted([r["doc_id"], *brute_quality(r["text"])] for r in df.select("doc_id", "text").collect())
    kept = {r["doc_id"]: r["kept"] for r in quality_rules.quality_rules(extra).collect()}
    assert kept == {500: False, 501: False, 502: True, 503: False}


def test_viterbi_is_the_best_labelling():
    rng = np.random.default_rng(3)
    for _ in range(30):
        x = rng.normal(size=7)
        score = lambda y: sum(v for v, k in zip(x, y) if k) + sum(quality_rules.STAY if a == b else quality_rules.CHANGE for a, b in zip(y, y[1:]))  # noqa: E731, B023
        best = max(([bool(m >> k & 1) for k in range(7)] for m in range(128)), key=score)
        assert score(quality_rules.viterbi(x).tolist()) == pytest.approx(score(best))


def brute_base(text):
    text = text or ""
    found = [(m.start(), m.end(), "assign", 0) for m in re.finditer(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 6]
    found += [(m.start(), m.end(), "access", 1) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), m.end(), "hex", 2) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return ",".join(f"{k}:{a}:{b}" for a, b, k, _ in sorted(found, key=lambda x: (x[0], x[3])))


def test_secret_scan(spark, odd):
    key = "AKIA" + "A1B2C3D4E5F6G7H8"
    cases = [f"é password: 'hunter2x' {key}", "TOKEN=abc token = abcdef", "x" + "0123456789abcdef" * 2, "paſsword=abcdefgh", "api_key=\"ABCDEF==\" apikey: zzzzzz", f"user=bob\nhost https://db.example.org/x\nQx7{'aB3' * 8}", "https://example.org and 10.0.0.1", "user=bob only", f"Qx7{'aB3' * 8} alone"]
    df = odd.unionByName(frame(spark, [(100 + i, t, "s") for i, t in enumerate(cases)]))
    got = {r["doc_id"]: r for r in secret_scan.scan_secrets(df).collect()}
    for r in df.select("doc_id", "text").collect():
        if r["doc_id"] != 6:
            assert got[r["doc_id"]]["base_sha256"] == hashlib.sha256(brute_base(r["text"]).encode()).hexdigest()
    assert {x.split(":")[0] for x in got[105]["spans"].split(",")} == {"weak_id", "weak_secret", "endpoint"}
    assert got[106]["spans"] == got[107]["spans"] == got[108]["spans"] == ""
    clean = {r["doc_id"]: r for r in secret_scan.redact_secrets(df).collect()}
    assert clean[100]["text"] == "é <secret>' <secret>" and clean[100]["n_chars"] == 20 and clean[0]["text"] is None


def brute_linked(text, base, scope):
    """Weak parts with complementary parts, by looking at all pairs."""
    parts = base + [(m.start(), m.end(), kind) for kind, p in (("weak_secret", secret_scan.WEAK_SECRET), ("weak_id", secret_scan.WEAK_ID), ("endpoint", secret_scan.ENDPOINT)) for m in p.finditer(text)]
    near = defaultdict(set)
    for a in parts:
        for b in parts:
            if a != b and (a[0], a[1], a[2]) < (b[0], b[1], b[2]) and a[1] <= b[0] <= a[1] + scope and not re.search(r"\n[ \t\r]*\n", text[a[0] : b[0]] + text[b[0] : b[0] + 1]):
                near[a].add(b[2])
                near[b].add(a[2])
    secret, ident = {"assign", "hex", "weak_secret"}, {"access", "weak_id"}
    holds = {"weak_secret": lambda n: n & (ident | {"endpoint"}), "weak_id": lambda n: n & secret, "endpoint": lambda n: n & secret and n & ident}
    return {p for p in parts if p[2] in holds and holds[p[2]](near[p]) and not any(b[0] < p[1] and p[0] < b[1] for b in base)}


def test_linked_parts_match_all_pairs():
    rng = random.Random(23)
    parts = ["user=bob", "login: amy.x", "client_id=zz9", "https://db.example.org/x", "10.0.0.1:5432", "Qx7" + "aB3" * 8, "Zk9" + "mN4" * 9, "password=hunter22", "AKIA" + "A1B2C3D4E5F6G7H8", "0123456789abcdef" * 2]
    linked = 0
    for _ in range(300):
        text = ""
        for _ in range(rng.randrange(2, 9)):
            text += rng.choice(parts) + rng.choice([" ", "\n", "\n\n", "\n \n", " plain words here " * rng.randrange(1, 12)])
        base = secret_scan.base_spans(text)
        got = secret_scan.linked_spans(text, base)
        assert set(got) == brute_linked(text, base, secret_scan.SCOPE)
        linked += len(got)
    assert linked > 300


def test_decontamination(spark, odd):
    rng = random.Random(12)
    items = [words(rng, 40, 9000) for _ in range(6)] + ["three word item", "", None]
    bench = spark.createDataFrame([(i, t, "x") for i, t in enumerate(items)], "item_id long, text string, doc_id string")
    edited = near_copies(rng, items[1], 1, 6)[0]
    docs = [f"{words(rng, 50, 9000)} {items[0]} {words(rng, 50, 9000)}", f"{words(rng, 50, 9000)} {edited.upper()} {words(rng, 9, 9000)}", words(rng, 300, 9000), "a three word item here", " ".join(items[2].split()[:12])]
    df = odd.unionByName(frame(spark, [(100 + i, t, "s") for i, t in enumerate(docs)]))
    for size in (1 << 24, 300):
        got = {(r["doc_id"], r["item_id"]): r for r in decontam.contaminated(df, bench, block_bytes=size).collect()}
        assert set(got) == {(100, 0), (101, 1), (103, 6)}
        assert (got[100, 0]["score"], got[100, 0]["first_word"], got[100, 0]["last_word"]) == (1.0, 50, 89)
    assert decontam.contaminated(df, bench.limit(0)).count() == 0


def test_decontamination_finds_edited_copies_beside_verbatim_ones(spark):
    rng = random.Random(13)
    item = words(rng, 38, 9000)
    edited = [" ".join(f"x{i}" if i % n == n - 1 else w for i, w in enumerate(item.split())) for n in (5, 6, 7)]
    docs = [f"{words(rng, 50, 9000)} {t} {words(rng, 50, 9000)}" for t in [item] * 3 + edited + edited[:1] * 5]
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    got = {r["doc_id"]: r["score"] for r in decontam.contaminated(frame(spark, [(i, t, "s") for i, t in enumerate(docs)]), bench).collect()}
    assert set(got) == set(range(len(docs)))
    assert all(0.7 <= got[i] < 1 for i in range(3, len(docs)))


def test_decontamination_recall_with_a_stock_phrase_in_every_item(spark):
    rng = random.Random(24)
    stock = words(rng, 12, 9000)
    items = [f"{words(rng, 14, 9000)} {stock} {words(rng, 14, 9000)}" for _ in range(12)]
    docs, wanted = [], {}
    for i, item in enumerate(items):
        w = item.split()
        for edits in (0, 4, 8, 12):
            e = list(w)
            for k in rng.sample(range(len(w)), edits):
                e[k] = rng.choice([f"x{k}", f"x{k} y{k}", ""])
            docs.append(f"{words(rng, 30, 9000)} {' '.join(e)} {words(rng, 30, 9000)}")
    docs += [f"{words(rng, 30, 9000)} {stock} {words(rng, 30, 9000)}" for _ in range(10)]
    for d, text in enumerate(docs):
        t = [hash(x) for x in text.split()]
        for i, item in enumerate(items):
            q = [hash(x) for x in item.split()]
            score = decontam.align(np.array(t), np.array(q))[0] / (2 * len(q))
            if score >= decontam.MIN_SCORE:
                wanted[d, i] = score
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in decontam.contaminated(frame(spark, [(i, t, "s") for i, t in enumerate(docs)]), bench).collect()}
    assert set(got) <= set(wanted) and all(got[k] == pytest.approx(wanted[k]) for k in got)
    assert len(got) >= 0.9 * len(wanted) and {d for d, _ in got} == {d for d, _ in wanted} and not any(d >= 48 for d, _ in got)


def test_alignment_matches_plain_dynamic_programming():
    rng = random.Random(11)
    for _ in range(20):
        a, b = [rng.randrange(6) for _ in range(30)], [rng.randrange(6) for _ in range(12)]
        h = [[0] * (len(a) + 1) for _ in range(len(b) + 1)]
        for i in range(1, len(b) + 1):
            for j in range(1, len(a) + 1):
                h[i][j] = max(0, h[i - 1][j - 1] + (2 if a[j - 1] == b[i - 1] else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
        assert decontam.align(np.array(a), np.array(b))[0] == max(map(max, h))


def labelled(spark, n=600):
    rng = random.Random(21)
    rows, labels = [], []
    for i in range(n):
        toxic, junk = i % 5 == 0, i % 7 == 0
        w = words(rng, 80, 3000).split()
        if toxic:
            for k in rng.sample(range(80), 4):
                w[k] = rng.choice(["idiotic", "scumbag", "worthless"])
        if junk:
            w = [f"{x}$$$" for x in w]
        rows.append((i, " ".join(w), "s"))
        labels.append((i, int(not junk), int(toxic), "x"))
    return frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string")


def out_of_sample(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def test_toxicity_held_out(spark, odd):
    docs, labels = labelled(spark)
    got = {r["doc_id"]: r for r in toxicity.toxicity(docs, labels).collect()}
    held = [i for i in got if out_of_sample(i)]
    assert all(got[i]["held_out"] == out_of_sample(i) for i in got)
    assert sum(got[i]["predicted"] == int(i % 5 == 0) for i in held) >= 0.97 * len(held)
    both = docs.unionByName(odd.withColumn("doc_id", F.col("doc_id") + 1000))
    assert all(0 <= r["score"] <= 1 for r in toxicity.toxicity(both, labels).collect())


def test_quality_classifier_held_out(spark, odd):
    docs, labels = labelled(spark)
    both = docs.unionByName(odd.withColumn("doc_id", F.col("doc_id") + 1000))
    got = {r["doc_id"]: r for r in quality_classifier(both, labels).collect()}
    held = [i for i in range(600) if out_of_sample(i)]
    assert sum(got[i]["predicted"] == int(i % 7 != 0) for i in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_discriminant_matches_normal_densities():
    rng = np.random.default_rng(1)
    x = [rng.normal(size=(4000, 3)), rng.normal(size=(2000, 3)) * 2 + 1]
    model = Discriminant.of(np.array([len(a) for a in x], float), np.array([a.sum(0) for a in x]), np.array([a.T @ a for a in x]), shrink=0.0)
    p = np.array([[0.0, 0.0, 0.0], [3.0, 3.0, 3.0]])
    log = lambda m, s: -0.5 * (((p - m) / s) ** 2).sum(1) - 3 * np.log(s)
    wanted = 1 / (1 + np.exp(log(0, 1) + np.log(2) - log(1, 2)))
    assert model.score(p) == pytest.approx(wanted, abs=0.05)


ALL = {
    "jaccard": (ngram_join.jaccard_components, True), "passages": (substring_dedup.fuzzy_passages, False), "suffix": (suffix_dedup.remove_repeats, True), "license": (license_scan, True), "mix": (mixing.mix_sources, True),
    "quality": (quality_rules.quality_rules, True), "secrets": (secret_scan.scan_secrets, True), "redact": (secret_scan.redact_secrets, True),
}


@pytest.mark.parametrize("name", ALL)
def test_odd_and_empty_tables(spark, odd, nothing, name):
    run, each = ALL[name]
    rows = run(odd).collect()
    if each:
        assert sorted(r["doc_id"] for r in rows) == sorted(r["doc_id"] for r in odd.collect())
    assert run(nothing).collect() == []


def test_classifiers_on_empty_tables(spark, odd, nothing):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for run in (toxicity.toxicity, quality_classifier):
        assert run(nothing, labels).collect() == []
        assert run(odd, labels).count() == odd.count()
    assert decontam.contaminated(nothing, spark.createDataFrame([(1, "a b c d e")], "item_id long, text string")).collect() == []


def brute_passages(texts, least, identity):
    """Pairs of texts with a stretch of `least` words or more, that begins and ends with equal words and of which the share `identity` is equal, and which words lie in one, by comparing all with all."""
    w = [t.split() for t in texts]
    held = defaultdict(set)
    pairs = set()
    for i in range(len(w)):
        for j in range(i):
            for shift in range(-len(w[i]) + least, len(w[j]) - least + 1):
                a = max(0, -shift)
                n = min(len(w[i]) - a, len(w[j]) - a - shift)
                equal = np.array([w[i][a + k] == w[j][a + shift + k] for k in range(n)])
                if equal.sum() < identity * least:
                    continue
                run, on = np.append(0, np.cumsum(equal)), np.flatnonzero(equal)
                for k in on:
                    last = [m for m in on if m - k + 1 >= least and run[m + 1] - run[k] >= identity * (m - k + 1)]
                    if last:
                        pairs.add((i, j))
                        held[i] |= set(range(a + k, a + last[-1] + 1))
                        held[j] |= set(range(a + shift + k, a + shift + last[-1] + 1))
    return pairs, held


@pytest.mark.parametrize("few", [64, 1])
def test_fuzzy_passages_of_holders_that_are_not_first(spark, monkeypatch, few):
    monkeypatch.setattr(substring_dedup, "FEW", few)
    rng, texts, wanted = random.Random(21), [], set()
    for k in range(8):  # the first document has all that the other two share, but scattered, so that it holds no passage itself
        runs = [words(rng, 11, 9000) for _ in range(5)]
        texts += [" ".join(f"{words(rng, 30, 9000)} {r}" for r in runs)]
        texts += [" ".join([words(rng, 30 + k, 9000), *(f"{words(rng, 1, 9000)} {r}" for r in runs), words(rng, 30, 9000)]) for _ in range(2)]
        wanted.add((3 * k + 1, 3 * k + 2))
    line = words(rng, 13, 9000)  # a stock line is no passage
    texts += [f"{words(rng, 40, 9000)} {line} {words(rng, 40, 9000)}" for _ in range(20)]
    got = substring_dedup.fuzzy_passages(frame(spark, [(i, t, "s") for i, t in enumerate(texts)])).collect()
    pairs = {(r["other_id"], r["doc_id"]) for r in got}
    assert wanted <= pairs and len(got) == len(pairs)
    assert all(r["identity"] >= 0.8 and r["last"] - r["first"] + 1 >= 40 for r in got)
    assert not any(b >= len(texts) - 20 for _, b in pairs)


def test_fuzzy_passages_recall_against_brute_force(spark):
    rng = random.Random(18)
    quotes = words(rng, 160, 9000).split()
    texts = [" ".join([words(rng, 30, 9000), *quotes[k : k + n], words(rng, 30, 9000)]) for k, n in [(4 * i, 28 if i % 2 else 36) for i in range(32)]]  # short quotes come first
    texts += [" ".join([words(rng, 40, 9000), *quotes, words(rng, 40, 9000)]) for _ in range(2)]
    for edits in (0, 1, 3, 4):  # copies differ in twice as many words
        p = words(rng, 70, 9000)
        texts += [f"{words(rng, 40, 9000)} {t} {words(rng, 40, 9000)}" for t in near_copies(rng, p, 4, edits)]
    got = substring_dedup.fuzzy_passages(frame(spark, [(i, t, "s") for i, t in enumerate(texts)])).collect()
    pairs, held = brute_passages(texts, 40, 0.8)
    found = defaultdict(set)
    for r in got:
        found[r["doc_id"]] |= set(range(r["first"], r["last"] + 1))
        found[r["other_id"]] |= set(range(r["other_first"], r["other_last"] + 1))
        assert r["last"] - r["first"] + 1 >= 40 and r["identity"] >= 0.8
    assert found[32] >= set(range(40, 200)) and found[33] >= set(range(40, 200))
    assert sum(len(found[i] & held[i]) for i in held) >= 0.9 * sum(map(len, held.values()))
    assert set(found) <= set(held)


def test_fuzzy_passages_make_no_pair_of_a_stock_line_or_of_one_class(spark, monkeypatch):
    rng, made = random.Random(23), []
    line, passage = words(rng, 30, 9000), words(rng, 68, 9000)
    texts = [f"{words(rng, 60, 9000)} {line} {words(rng, 60, 9000)}" for _ in range(90)]
    texts += [f"{words(rng, 60, 9000)} {passage} {words(rng, 60, 9000)}" for _ in range(90)]
    inner = substring_dedup._common_seeds
    monkeypatch.setattr(substring_dedup, "_common_seeds", lambda each, pairs: made.append(pairs.count()) or inner(each, pairs))
    got = substring_dedup.fuzzy_passages(frame(spark, [(i, t, "s") for i, t in enumerate(texts)])).collect()
    assert {r["doc_id"] for r in got} | {r["other_id"] for r in got} == set(range(90, 180))
    assert made[0] <= 180 and len(got) <= 180


def test_fuzzy_passages_hot_holders_do_not_meet_by_a_phrase_at_any_distance(spark, monkeypatch):
    rng, met = random.Random(27), []
    line, phrase = words(rng, 14, 9000), words(rng, 3, 9000)
    texts = [f"{words(rng, 60, 9000)} {line} {words(rng, 1 + k % 35, 9000)} {phrase} {words(rng, 60, 9000)}" for k in range(70)]
    inner = substring_dedup._apart
    monkeypatch.setattr(substring_dedup, "_apart", lambda rows: met.append(inner(rows)) or met[-1])
    assert not substring_dedup.fuzzy_passages(frame(spark, [(i, t, "s") for i, t in enumerate(texts)])).count()
    assert met[0].count() <= 3 * len(texts)
