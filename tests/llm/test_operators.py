import hashlib
import random
import re
import textwrap
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from quarry.llm import exact_dedup, jaccard_join, licenses, mixing, packing, quality_net, quality_rules, sharding, substring_dedup, toxicity
from quarry.llm.blocks import Words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def collect(df):
    return [r.asDict() for r in df.collect()]


# ---- exact dedup


@pytest.mark.parametrize("support", [1e-3, 0.02])
def test_exact_dedup(docs, rows, support):
    got = collect(exact_dedup.exact_dedup(docs, support=support))
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", t or "").encode()).hexdigest()].append(i)
    assert sorted((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == sorted((i, min(g), len(g), k) for k, g in groups.items() for i in g)
    assert Counter(r["text_sha256"] for r in got if r["kept"]) == Counter(groups.keys())
    assert all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])


def test_drop_copies_keeps_one_row_of_each(docs, rows):
    out = exact_dedup.drop_copies(docs)
    assert out.columns == docs.columns
    kept = collect(out)
    assert len(kept) == len({re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t, *_ in rows})


# ---- substring dedup


def brute_repeats(rows):
    first = {}
    for i, t, *_ in rows:
        w = WORD.findall(t or "")
        for k in range(len(w) - 19):
            key = tuple(w[k : k + 20])
            first[key] = min(first.get(key, (i, k)), (i, k))
    out = []
    for i, t, *_ in rows:
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for k in range(len(w) - 19):
            if first[tuple(w[k : k + 20])] < (i, k):
                gone[k : k + 20] = [True] * 20
        left = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(left.encode()).hexdigest()))
    return sorted(out)


def test_substring_dedup(docs, rows):
    got = sorted(tuple(r) for r in substring_dedup.drop_repeats(docs).collect())
    assert got == brute_repeats(rows)


def test_substring_dedup_texts(docs):
    for r in collect(substring_dedup.drop_repeats(docs, with_text=True)):
        assert hashlib.sha256(r["kept_text"].encode()).hexdigest() == r["kept_sha256"]


def test_rows_that_repeat_an_id_lose_a_passage_of_another_page(spark):
    t = " ".join(f"w{k}" for k in range(60))
    rows = [(1, t), (9, "x"), (5, t), (5, t)]
    docs = spark.createDataFrame(spark.sparkContext.parallelize(rows, 2), "doc_id long, text string")
    assert sorted(tuple(r) for r in substring_dedup.drop_repeats(docs).collect()) == brute_repeats(rows)


def test_windows_with_words_of_equal_polynomial_hash_differ(spark):
    a = "a"
    for _ in range(10):
        a += a.translate({97: 98, 98: 97})
    b = a.translate({97: 98, 98: 97})
    both = Words(np.frombuffer(f"{a} {b}".encode(), np.uint8), np.array([0, 2 * len(a) + 1]))
    assert a != b and both.hash[0] == both.hash[1]
    rest = " ".join(f"w{k}" for k in range(40))
    rows = [(1, f"{rest} {a} {rest}"), (2, f"{rest} {b} {rest}"), (3, f"{b} {rest}")]
    docs = spark.createDataFrame(spark.sparkContext.parallelize(rows, 3), "doc_id long, text string")
    assert sorted(tuple(r) for r in substring_dedup.drop_repeats(docs).collect()) == brute_repeats(rows)


def test_substring_dedup_of_texts_beyond_a_slice(spark):
    rng = random.Random(4)
    passage = " ".join(f"p{k}" for k in range(50))
    long = " ".join(rng.choice(["alpha", "beta", "gamma"]) + str(rng.randrange(50_000)) for _ in range(130_000)) + " " + passage
    assert len(long) > 1 << 20
    rows = [(4, long), (2, "x " + passage), (7, long[:300_000]), (9, None), (8, passage + " " + passage)]
    docs = spark.createDataFrame(spark.sparkContext.parallelize(rows, 3), "doc_id long, text string")
    assert sorted(tuple(r) for r in substring_dedup.drop_repeats(docs).collect()) == brute_repeats(rows)


def test_difference_cover():
    differences = {(a - b) % substring_dedup.PERIOD for a in substring_dedup.COVER for b in substring_dedup.COVER}
    assert differences == set(range(substring_dedup.PERIOD))


# ---- Jaccard join


def shingles(t):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_components(rows):
    sets = [(i, shingles(t)) for i, t, *_ in rows]
    low = [i for i, _ in sets]
    changed = True
    pairs = [(a, b) for a in range(len(sets)) for b in range(a) if sets[a][1] and sets[b][1] and 100 * len(sets[a][1] & sets[b][1]) >= 75 * len(sets[a][1] | sets[b][1])]
    while changed:
        changed = False
        for a, b in pairs:
            m = min(low[a], low[b])
            changed |= low[a] != m or low[b] != m
            low[a] = low[b] = m
    return sorted((i, len(s), c) for (i, s), c in zip(sets, low))


@pytest.mark.parametrize("prefix", [32, None])
def test_jaccard_classes(docs, rows, prefix):
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in collect(jaccard_join.jaccard_classes(docs, prefix=prefix)))
    assert got == brute_components(rows)


def test_one_of_each_tells_rows_by_id_and_text(spark):
    t = " ".join(f"w{k}" for k in range(60))
    rows = [(3, t), (5, t + " more"), (5, "a text of its own that nothing else is like"), (None, t + " again"), (None, "another text without any likeness to the rest"), (8, None), (9, " ")]
    out = jaccard_join.one_of_each(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in out.collect()) == sorted((i or 0, x or "") for k, (i, x) in enumerate(rows) if k not in (1, 3))


def test_loose_sequences_of_several_groups_meet(spark):
    rng = random.Random(6)
    docs = spark.createDataFrame([(k, " ".join(["a"] * rng.randint(20, 120))) for k in range(600)], "doc_id long, text string")
    got = collect(packing.pack(docs, group_pieces=10, capacity=256))
    lengths = np.array([r["length"] for r in got])
    alone = collect(packing.pack(docs, group_pieces=10, capacity=256, exchange=False))
    count = lambda rows: len({r["sequence_id"] for r in rows})
    assert packing.lower_bound(lengths, 256) <= count(got) <= count(alone)
    fill = Counter()
    for r in got:
        fill[r["sequence_id"]] += r["length"]
    assert len(got) == 600 and max(fill.values()) <= 256


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "u long, v long")
    got = dict(tuple(r) for r in jaccard_join.components(edges).collect())
    assert got == {**{i: 0 for i in range(1, 41)}, 101: 100}


# ---- packing


def test_packing(docs, rows):
    from tokenizers import Tokenizer

    got = collect(packing.pack(docs, group_pieces=40, capacity=256))
    tok = Tokenizer.from_file(packing.vocabulary_path())
    want = Counter()
    for i, t, *_ in rows:
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        for p, at in enumerate(range(0, len(ids), 256)):
            part = ids[at : at + 256]
            want[(i, p, at, len(part), zlib.crc32(part.tobytes()))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    by = defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for s in by.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 256
    lengths = np.array([r["length"] for r in got])
    # groups of 40 lose nothing worth naming against packing all pieces at once
    assert packing.lower_bound(lengths, 256) <= len(by) <= packing.best_fit_decreasing(lengths, 256).max() + 2


def test_best_fit_and_bound():
    rng = random.Random(2)
    for _ in range(20):
        x = np.array([rng.randint(1, 100) for _ in range(rng.randint(1, 60))])
        bins = packing.best_fit_decreasing(x, 100)
        assert np.bincount(bins, weights=x).max() <= 100
        assert packing.lower_bound(x, 100) <= bins.max() + 1
    assert packing.lower_bound(np.array([51] * 10), 100) == 10  # the plain sum says 6


def test_odd_texts_are_tokenised_as_a_whole():
    from tokenizers import Tokenizer

    path = packing.vocabulary_path()
    tok, words = Tokenizer.from_file(path), packing.WordTokenizer(path)
    odd = ["it's 'Tis don't we'll x's,", "a\tb\x0bc d e", "é ́x É é,É.", "<|endoftext|>x <|startoftext|>, y.", "...a.. . ,, a,b, 1,000. 3. ΣΑΣ, İstanbul. ẞ", "", "\n\n", "Hello,\r\nWorld. x"]
    for t, ids in zip(odd, words.ids(odd)):
        assert np.frombuffer(ids, "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids


# ---- sharding, mixing


def test_shards(docs, rows):
    got = collect(sharding.shard_rows(docs, bucket_rows=8))
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    sizes = Counter(r["shard"] for r in got)
    assert set(sizes) == set(range(8)) and max(sizes.values()) - min(sizes.values()) <= 1
    for s, n in sizes.items():
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(n))
    source = {i: s for i, _, _, s, _ in rows}
    for s in set(source.values()):
        per = [sum(source[r["doc_id"]] == s for r in got if r["shard"] == k) for k in range(8)]
        assert max(per) - min(per) <= 3


def test_mixture_meets_its_targets(docs, rows):
    goal = {"source": {"s0": 0.5, "s1": 0.3, "(none)": 0.2}}
    cells = mixing.rake(docs.sparkSession.createDataFrame([(s, lg, tp, float(k)) for k, (s, lg, tp) in enumerate(((s, lg, tp) for s in ("s0", "s1", "(none)") for lg in ("en", "de") for tp in ("a", "b")), 5)], "source string, lang string, topic string, tokens double"), targets=goal)
    got = collect(cells)
    for s, w in goal["source"].items():
        assert abs(sum(r["weight"] for r in got if r["source"] == s) - w) < 1e-3
    assert max(r["keep_probability"] for r in got) == 1.0
    out = collect(mixing.mix(docs))
    assert len(out) == len(rows) and 0 < sum(r["kept"] for r in out) <= len(rows)
    kept = mixing.sample_mixture(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in collect(kept)) == sorted(r["doc_id"] for r in out if r["kept"])


def test_a_stray_row_does_not_set_the_scale(spark):
    cells = [(f"s{a}", lg, tp, float(1000 * (a + b + c + 3))) for a in range(4) for b, lg in enumerate(("en", "de")) for c, tp in enumerate(("article", "brief"))]
    shape = "source string, lang string, topic string, tokens double"
    plain, stray = (collect(mixing.rake(spark.createDataFrame(x, shape))) for x in (cells, [*cells, ("(none)", "(none)", "brief", 1.0)]))
    share = lambda got: sum(r["tokens"] * r["keep_probability"] for r in got) / sum(r["tokens"] for r in got)
    assert abs(share(stray) - share(plain)) < 0.02 and share(plain) > 0.5
    assert [r["keep_probability"] for r in stray if r["source"] == "(none)"] == [1.0] == [max(r["keep_probability"] for r in stray)]


# ---- quality, toxicity, licences


def test_quality_rule_counts(docs, rows):
    got = Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in collect(quality_rules.quality_rules(docs)))
    want = Counter()
    for i, t, *_ in rows:
        w = WORD.findall(t or "")
        seen = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        covered = {p for k in range(len(w) - 7) if seen[tuple(w[k : k + 8])] > 1 for p in range(k, k + 8)}
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        want[(i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(covered), len(w) < 20 or 100 * len(covered) > 30 * len(w))] += 1
    assert got == want


def test_vote_model_finds_the_bad_class():
    rng = random.Random(8)
    seen = Counter()
    for k in range(4000):
        bad = k % 5 == 0
        seen[tuple((-1 if rng.random() < 0.8 else 1) if bad else (-1 if rng.random() < 0.02 else 1) for _ in range(4))] += 1
    good, table = quality_rules.fit(sorted(seen.items()), 4)
    assert abs(good - 0.8) < 0.03 and all(abs(t[-1][1] - 0.8) < 0.05 and t[-1][0] < 0.05 for t in table)


def made(spark, n=600):
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("aeionrst") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    docs, labels = [], []
    for i in range(n):
        w = [rng.choice(vocabulary) for _ in range(rng.randint(30, 150))]
        toxic, low = i % 4 == 0, i % 5 == 1
        if toxic:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(["glorbuk", "zumpfik", "drekhole" + rng.choice(["a", "b", "c"])]))
        t = " ".join(f"{x}###" if low else x for x in w)
        docs.append((i, t))
        labels.append((i, int(not low), int(toxic)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), {i: (q, x) for i, q, x in labels}


def test_scores_on_held_out_documents(spark):
    docs, labels, truth = made(spark)
    for f, k, held in ((quality_net.score_quality, 0, lambda i: zlib.crc32(str(i).encode()) % 5 == 0), (toxicity.score_toxicity, 1, lambda i: zlib.crc32(str(i).encode()) % 3 == 1)):
        got = collect(f(docs, labels))
        assert all(r["held_out"] == held(r["doc_id"]) and 0 <= r["score"] <= 1 for r in got)
        test = [r for r in got if r["held_out"]]
        assert sum(r["predicted"] == truth[r["doc_id"]][k] for r in test) >= 0.97 * len(test)


def test_automaton():
    m = toxicity.Matcher([("trash", False), ("pathetic", False), ("vequ", True), ("achlich", True)], frozenset({"vequiet"}))
    for w, e in dict(trash=0, tarsh=9, trsh=1, traash=1, trashy=1, pahtetic=2, vequaaa=0, veq=9, aclichkeit=1, house=9).items():
        assert m.match(w) == e, w
    assert m.look("TRASH!".lower()) == 0 and m.look("vequiet") == 9


def test_licenses(spark):
    rows = [(1, "Text.\nLICENCED under the Apache licence,  version 2.0\nmore"), (2, "Copyright 2020 X\nReleased under the MIT License."), (3, "nothing"), (4, None), (5, "Licensed under CC-BY-NC 4.0\nReleased under the MIT license"), (5, "x")]
    got = {r["doc_id"]: (r["n_notices"], r["licenses"], r["whole_text"], r["verdict"]) for r in collect(licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")))}
    assert got == {1: (1, "Apache-2.0", False, "permissive"), 2: (2, "MIT", True, "permissive"), 3: (0, "", False, "unknown"), 4: (0, "", False, "unknown"), 5: (2, "CC-BY-NC-4.0,MIT", False, "restricted")}


def test_licence_lines_of_the_documents_are_known(spark):
    """Held against the lines of the given documents, not against the list."""
    says = {"Apache": "Apache-2.0", "MIT": "MIT", "GNU General Public License, version 3": "GPL-3.0", "CC BY-NC": "CC-BY-NC-4.0", "All rights reserved": "Proprietary"}
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    want = defaultdict(set)
    for i, t in docs.collect():
        for line in (t or "").split("\n"):
            if re.search(r"(?i)\blicensed under\b|\breleased under\b|^all rights reserved", line):
                want[i] |= {name for words, name in says.items() if words in line} or {line}
    assert any("GPL-3.0" in x for x in want.values())
    assert {r["doc_id"]: set(r["licenses"].split(",")) for r in collect(licenses.scan_licenses(docs)) if r["licenses"]} == want


def test_wordings_name_one_licence_each(spark):
    names = defaultdict(set)
    for name, _, t in [*licenses.NOTICES, *((name, ok, f"Licensed under {x}") for name, ok, known in licenses.NAMES for x in known)]:
        names[licenses.headless(licenses.canonical_text(t))].add(name)
    assert max(map(len, names.values())) == 1
    rows = [(1, "This file is licenced under the Apache License 2.0"), (2, "This work is licensed under the GNU General Public License, version 3."), (3, "This software is distributed under the terms of the GNU GPLv3 or later."), (4, "This document is licensed under CC BY-SA 4.0")]
    got = {r["doc_id"]: (r["licenses"], r["verdict"]) for r in collect(licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")))}
    assert got == {1: ("Apache-2.0", "permissive"), 2: ("GPL-3.0", "restricted"), 3: ("GPL-3.0", "restricted"), 4: ("CC-BY-SA-4.0", "restricted")}


def test_licence_texts_and_broken_headers(spark):
    mit = next("\n\n".join(p) for name, _, _, p in licenses.TEXTS if name == "MIT")
    bsd = next("\n\n".join(p) for name, _, _, p in licenses.TEXTS if name == "BSD-3-Clause")
    apache = "# Copyright 2020 X\n#\n# Licensed under the Apache License,\n# Version 2.0 (the \"License\"); you may not use this file\n# except in compliance with the License. You may obtain a copy of the\n# License at\n#\n#   http://www.apache.org/licenses/LICENSE-2.0\n\nimport os"
    rows = [(1, "The MIT License (MIT)\n\nCopyright (c) 2020 X\n\n" + textwrap.fill(mit.replace("\n\n", "@@"), 10_000).replace("@@", "\n\n")), (2, "Copyright 2021 Y\n" + bsd), (3, apache), (4, "Some code\n\n" + textwrap.fill(mit.split("\n\n")[0], 70) + "\n\nmore"), (5, mit + " and more")]
    got = {r["doc_id"]: (r["licenses"], r["whole_text"], r["verdict"]) for r in collect(licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")))}
    assert got[1] == ("MIT", True, "permissive") and got[2] == ("BSD-3-Clause", True, "permissive")
    assert got[3] == ("Apache-2.0", False, "permissive") and got[4] == ("MIT", False, "permissive") and not got[5][1]


# ---- every operator: odd rows and empty tables


def test_odd_rows_and_empty_tables(spark, docs, rows, empty):
    labels = spark.createDataFrame([(rows[k][0], k % 2, k % 2) for k in range(20)] + [(None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    none = labels.limit(0)
    with_null = docs.unionByName(docs.limit(1).selectExpr("cast(null as long) as doc_id", *[c for c in docs.columns if c != "doc_id"]))
    calls = {
        "op1": substring_dedup.drop_repeats, "op2": lambda d: quality_net.score_quality(d, labels), "op2 none": lambda d: quality_net.score_quality(d, none), "op3": quality_rules.quality_rules,
        "op4": sharding.shard_rows, "op5": jaccard_join.jaccard_classes, "op6": lambda d: packing.pack(d).where("piece = 0"), "op7": lambda d: toxicity.score_toxicity(d, labels),
        "op7 none": lambda d: toxicity.score_toxicity(d, none), "op9": mixing.mix, "op10": exact_dedup.exact_dedup,
    }
    for name, f in calls.items():
        assert f(with_null).count() == len(rows) + 1, name
        assert f(empty).count() == 0, name
    assert licenses.scan_licenses(empty).count() == 0 and licenses.scan_licenses(with_null).count() == len({r[0] for r in rows}) + 1
