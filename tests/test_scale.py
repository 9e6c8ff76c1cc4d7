"""Searches keep the best of a task: against plain versions, and no plan that makes a row per pair."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from quarry.operators import best, retrieval


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def plain_bm25(queries, docs, k):
    split = lambda t: [w for w in re.split(r"[^a-z0-9]+", (t or "").lower()) if w]
    words = {d: split(t) for d, t in docs}
    mean = sum(map(len, words.values())) / len(words)
    df = Counter(w for ts in words.values() for w in set(ts))
    out = {}
    for q, text in queries:
        scores = {}
        for d, ts in words.items():
            tf = Counter(ts)
            s = sum(math.log(1 + (len(words) - df[w] + 0.5) / (df[w] + 0.5)) * tf[w] * 2.2 / (tf[w] + 1.2 * (0.25 + 0.75 * len(ts) / mean)) for w in set(split(text)) if tf[w])
            if s:
                scores[d] = s
        for r, d in enumerate(sorted(scores, key=lambda d: (-round(scores[d], 9), d))[:k], 1):
            out[q, r] = (d, round(scores[d], 6))
    return out


@pytest.mark.parametrize("often", [0.0, 0.02, 2.0])
def test_bm25_blocks_ties_and_plan(spark, monkeypatch, often):
    rng = random.Random(5)
    pool = [f"w{i}" for i in range(60)]
    docs = [(f"d-{i}", " ".join(["all", *(rng.choice(pool[: rng.randint(1, 60)]) for _ in range(rng.randint(0, 30)))])) for i in range(300)]
    docs += [(f"e-{i}", docs[0][1]) for i in range(40)] + [("none", None), ("blank", " ")]
    queries = [(i, docs[i][1]) for i in range(0, 300, 10)] + [(1000, docs[0][1]), (1001, None), (1002, "ALL"), (1003, "unknown")]
    for name, value in (("TERM_QUERIES", 7), ("OFTEN", often)):
        monkeypatch.setattr(retrieval, name, value)
    monkeypatch.setattr(best, "CELLS", 500)
    hits = retrieval.bm25_topk(spark.createDataFrame(queries, "query_id long, query string"), spark.createDataFrame(docs, "doc_id string, text string").repartition(3), 7)
    assert {(r["query_id"], r["rank"]): (r["doc_id"], round(r["score"], 6)) for r in hits.collect()} == plain_bm25(queries, docs, 7)
    assert "MapInArrow" in plan(hits) and "Generate" not in plan(hits)


def test_dense_blocks_ties_and_plan(spark, monkeypatch):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(400, 6)).astype(np.float32)
    v[100:160] = v[0]
    v[7] = 0
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)]
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 9)
    vectors = spark.createDataFrame([*rows, (900, None), (901, [1.0])], "doc_id long, vector array<float>").repartition(3)
    queries = spark.createDataFrame(rows[:40], "query_id long, vector array<float>")
    hits = retrieval.dense_topk(queries, vectors, 5)
    w = v.astype(float)
    n = np.sqrt((w * w).sum(1))
    expected = {}
    for q in range(40):
        if n[q]:
            s = {d: float(w[q] @ w[d] / (n[q] * n[d])) for d in range(400) if n[d]}
            for r, d in enumerate(sorted(s, key=lambda d: (-round(s[d], 9), d))[:5], 1):
                expected[q, r] = (d, round(s[d], 6))
    assert {(r["query_id"], r["rank"]): (r["doc_id"], round(r["score"], 6)) for r in hits.collect()} == expected
    assert "MapInArrow" in plan(hits) and "NestedLoop" not in plan(hits)


def test_near_codes_against_every_pair(monkeypatch):
    from quarry.functions.similarity import osa_distance, osa_similarity
    from quarry.operators import near_codes

    rng = random.Random(1)
    for alphabet in ("ab", "abc1", "01234567"):
        for pairs in (50, 1 << 17):
            monkeypatch.setattr(near_codes, "PAIRS", pairs)
            draw = lambda n: sorted({"".join(rng.choice(alphabet) for _ in range(rng.randint(0, 9))) for _ in range(n)})
            codes, tokens = draw(120), [*draw(20), "zü𝔸1"]
            tree = near_codes.Tree(codes)
            for radius in range(4):
                got = {(int(t), int(s), int(d)) for x in tree.walk(*near_codes.characters(tokens), np.arange(len(tokens)), radius) for t, s, d in zip(*x)}
                assert got == {(i, j, osa_distance(a, b)) for i, a in enumerate(tokens) for j, b in enumerate(codes) if osa_distance(a, b) <= radius}
            for top in (1, 5):
                got = {(int(t), int(s)) for x in near_codes.nearest(tree, tokens, 0.72, top) for t, s, _ in zip(*x)}
                best_ = {i: sorted((-round(osa_similarity(a, b), 9), j) for j, b in enumerate(codes) if osa_similarity(a, b) >= 0.72 - 1e-12)[:top] for i, a in enumerate(tokens)}
                assert got == {(i, j) for i, xs in best_.items() for _, j in xs}


def test_fuzzy_blocks_radii_and_plan(spark, monkeypatch):
    from quarry.functions.similarity import jaro_winkler, osa_similarity
    from quarry.operators import codes

    rng = random.Random(2)
    norms = sorted({"".join(rng.choice("0123") for _ in range(rng.choice((8, 9, 13)))) for _ in range(600)})
    tokens = ["".join(rng.choice("0123") for _ in range(rng.choice((8, 13)))) for _ in range(12)] + ["9" * 8]
    monkeypatch.setattr(codes, "TOKEN_BLOCK", 5)
    monkeypatch.setattr(codes, "FIRST_RADIUS", 1)
    c = spark.createDataFrame([(f"p{i}", "article", 0, n) for i, n in enumerate(norms)], "external_id string, field string, pos int, norm string")
    t = spark.createDataFrame([(i, 0, x) for i, x in enumerate(tokens)], "query_id long, token_pos int, token_norm string")
    hits = codes.fuzzy(t, c)
    expected = {}
    for i, a in enumerate(tokens):
        near = sorted((-round(osa_similarity(a, b), 9), b) for b in norms if osa_similarity(a, b) >= codes.CUTOFF - 1e-12)[: codes.TOP]
        for s, b in near:
            raw = 0.6 * osa_similarity(a, b) + 0.4 * jaro_winkler(a, b) - min(0.02 * abs(len(a) - len(b)), 0.10)
            if raw >= codes.THRESHOLD:
                expected[i, b] = round(min(raw, codes.FUZZY_CAP), 4)
    assert expected and {(r["query_id"], r["norm"]): pytest.approx(r["score"], abs=1.1e-4) for r in hits.collect()} == expected
    assert "NestedLoop" not in plan(hits) and "Cartesian" not in plan(hits)
