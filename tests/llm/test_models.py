"""Samples, fitted layers, token ids and mixtures against plain versions."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import exact_dedup, mixing, packing, quality_net, quality_rules, sampling, toxicity

LETTERS = "abcdefghijklmnopqrstuvwxyz"


def test_sample_stays_bounded_when_an_id_repeats(spark):
    rows = [(1, "x" * (k % 7 + 1)) for k in range(500)] + [(k, f"t{k}") for k in range(2, 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame([(k, k % 2) for k in range(1, 60)], "doc_id long, toxic int")
    sample, counts = sampling.labelled_sample(docs, labels, "toxic", 3, 1, 10)
    got = sample.collect()
    assert Counter(r["label"] for r in got) == {0: 10, 1: 10} and sum(counts.values()) == sum(zlib.crc32(str(k).encode()) % 3 != 1 for k in range(1, 60))
    every, _ = sampling.labelled_sample(docs, labels, "toxic", 3, 1, 1000)
    assert Counter(r["text"] for r in every.collect()) == Counter({"x" if k == 1 else f"t{k}": 1 for k in range(1, 60) if zlib.crc32(str(k).encode()) % 3 != 1})


def test_sample_takes_whole_texts_within_its_bytes(spark):
    docs = spark.createDataFrame([(k, "y" * (1000 if k % 10 == 0 else 10)) for k in range(1, 100)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, 0) for k in range(1, 100)], "doc_id long, toxic int")
    got = [len(r["text"]) for r in sampling.labelled_sample(docs, labels, "toxic", 3, 1, 1000, max_bytes=500)[0].collect()]
    assert set(got) == {10} and 0 < sum(got) <= 500


# ---- toxicity


def edits(word, term):
    row = list(range(len(term) + 1))
    for i, a in enumerate(word, 1):
        before, row = row, [i]
        for j, b in enumerate(term, 1):
            row.append(min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (a != b)))
    return row[-1]


def plain_match(word, lexicon):
    best = 9
    for term, stem, *own in lexicon:
        most = own[0] if own else toxicity.edits_allowed(term, stem)
        for x in [word[:k] for k in range(len(word) + 1)] if stem else [word]:
            e = edits(x, term)
            best = min(best, e) if e <= most else best
    return best


@pytest.mark.parametrize("memory", [100_000, 200])
def test_automaton_against_edit_distances(monkeypatch, memory):
    monkeypatch.setattr(toxicity, "PAIR_MEMORY", memory)
    rng = random.Random(6)
    word = lambda n: "".join(rng.choice("abcd") for _ in range(n))
    lexicon = [(word(rng.randint(3, 9)), rng.random() < 0.3) for _ in range(25)] + [(word(6), False, 0)]
    m = toxicity.Matcher(lexicon)
    for _ in range(1500):
        w = word(rng.randint(1, 11))
        assert m.match(w) == plain_match(w, lexicon), w
        assert m.pairs <= memory + 20_000


QUOTED = [('he said "trash" and left', 1), ('he said "you are utter trash" and left', 1), ("« trash »", 1), ("„trash“ x", 1), ('("trash")', 1)]
OPEN = [("you are trash", 0), ('"foo" you are trash "bar"', 0), ("he said you are trash", 0), ('trash "x" y', 0), ('x "y trash', 0), ('"' + "w " * 60 + 'trash"', 0)]


@pytest.mark.parametrize("text, quoted", QUOTED + OPEN)
def test_quotation_needs_both_marks(text, quoted):
    m = toxicity.Matcher([("trash", False)])
    tokens = toxicity.words_of(text)
    f = dict(zip(toxicity.FEATURES, toxicity.features(tokens, toxicity.find(tokens, m))))
    assert (f["quoted"] > 0, f["abuse"] > 0) == (bool(quoted), not quoted)


def test_weights_keep_their_signs():
    rng = np.random.default_rng(2)
    x = rng.random((400, 3))
    y = (x[:, 0] - x[:, 1] + 0.1 * rng.random(400) > 0).astype(float)
    w = toxicity.fit_layer(x, y, signs=(1, 1, -1))
    assert w[0] > 0 and w[1] == 0 and w[2] <= 0


def spoiled(word, rng):
    k = rng.randrange(1, len(word))
    return rng.choice([word[:k] + rng.choice("xyz") + word[k + 1 :], word[:k] + word[k - 1] + word[k:], word[:k] + word[k + 1 :]])


def test_misspelled_terms_are_caught_and_quoted_ones_left(spark):
    rng = random.Random(12)
    vocabulary = ["".join(rng.choice("aeionrst") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    insults = ["glorbuk", "zumpfik", "drekhole", "vashmutz"]
    docs, labels, kinds = [], [], {}
    for i in range(900):
        w = [rng.choice(vocabulary) for _ in range(rng.randint(30, 90))]
        kind = rng.choice(["clean"] * 4 + ["toxic", "toxic", "wrong", "quoted"]) if i >= 500 else rng.choice(["clean", "clean", "toxic"])
        for _ in range(3 if kind != "clean" else 0):
            x = rng.choice(insults)
            w.insert(rng.randrange(len(w)), spoiled(x, rng) if kind == "wrong" else f'"{x}"' if kind == "quoted" else x)
        docs.append((i, " ".join(w)))
        kinds[i] = kind
        if i < 500:
            labels.append((i, int(kind == "toxic")))
    model = (spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    fitted = toxicity.fit(*model)
    w = dict(zip(toxicity.FEATURES, fitted.weights))
    assert w["any_fuzzy"] + w["fuzzy"] > 0.5 and w["quoted"] <= 0 < w["any_abuse"]
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score_toxicity(*model).collect()}
    for kind, least in (("clean", 0), ("quoted", 0), ("toxic", 1), ("wrong", 1)):
        told = [got[i] == least for i in range(500, 900) if kinds[i] == kind]
        assert sum(told) >= 0.95 * len(told), kind


def test_scores_against_a_plain_version(spark, docs, rows):
    labels = spark.createDataFrame([(r[0], k % 2) for k, r in enumerate(rows[:60])], "doc_id long, toxic int").dropDuplicates(["doc_id"])
    m = toxicity.Model([("aba", True, 0), ("passage", False, 1)], frozenset({"abag"}), [1.0, 2.0, 0.5, 1.0, 3.0, -1.0, -2.0])
    got = Counter((r[0], round(r[1], 9)) for r in docs.select("doc_id", m.scorer(docs, F.col("text"))).collect())
    want = Counter()
    for i, t, *_ in rows:
        tokens = (t or "").lower().split()
        kind = [9 if x.strip(toxicity.EDGE) in m.spared else plain_match(x.strip(toxicity.EDGE), m.lexicon) for x in tokens]
        a, f = sum(e == 0 for e in kind), sum(0 < e < 9 for e in kind)  # the rows have no quotation marks
        x = [float(a > 0), min(a, 4) / 4, float(f > 0), min(f, 4) / 4, min(1.0, 20 * (a + f) / len(tokens)) if tokens else 0.0, 0.0, 1.0]
        want[(i, round(1 / (1 + math.exp(-sum(p * q for p, q in zip(x, m.weights)))), 9))] += 1
    assert got == want
    assert toxicity.fit(docs, labels).weights[-1] < 0


# ---- quality


def test_pooled_features_against_a_loop():
    rng = np.random.default_rng(4)
    table = rng.normal(0, 0.2, (quality_net.WIDTH, 256, quality_net.FILTERS)).astype(np.float32)
    texts = ["", "a", "xy " * 40, "".join(chr(97 + k % 26) for k in range(1000)), "é" * 777, "z" * 128, "q" * 129, "w" * 256]
    raw = [t.encode() for t in texts]
    got = quality_net.document_features(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]), table)
    for k, t in enumerate(texts):
        values = []
        for chunk in quality_net.chunks_of(t):
            at = [sum(table[j, chunk[p + j]].astype(np.float64) for j in range(quality_net.WIDTH)) for p in range(len(chunk) - quality_net.WIDTH + 1)]
            values.append(np.tanh(np.max(at, axis=0)))
        assert len(values) == max(1, -(-len(raw[k]) // 128) - 1)
        if len(raw[k]) > 128:  # a lone short block is not padded to a whole chunk when scored
            want = np.concatenate([np.max(values, axis=0), np.mean(values, axis=0), np.min(values, axis=0)])
            assert np.allclose(got[k], want, atol=1e-4), k


def test_rule_verdicts_against_plain_em(spark, docs, rows):
    got = quality_rules.quality_rules(docs).collect()
    names = [c for c in got[0].asDict() if c.startswith("v_")]
    seen = Counter(tuple(r[c] for c in names) for r in got)
    good, prior, n = 0.8, quality_rules.PRIOR, len(got)
    table = [{v: list(prior[v]) for v in prior} for _ in names]
    chance = {}
    for step in range(quality_rules.ROUNDS + 1):
        for votes in seen:
            a = good * math.prod(t[v][0] for t, v in zip(table, votes))
            b = (1 - good) * math.prod(t[v][1] for t, v in zip(table, votes))
            chance[votes] = a / (a + b)
        if step == quality_rules.ROUNDS:
            break
        g = sum(k * chance[x] for x, k in seen.items())
        for j, t in enumerate(table):
            for v in prior:
                t[v][0] = (sum(k * chance[x] for x, k in seen.items() if x[j] == v) + 10 * prior[v][0]) / (g + 10)
                t[v][1] = (sum(k * (1 - chance[x]) for x, k in seen.items() if x[j] == v) + 10 * prior[v][1]) / (n - g + 10)
        good = (g + 10 * 0.8) / (n + 10)
    for r in got:
        p = chance[tuple(r[c] for c in names)]
        assert abs(r["posterior"] - p) < 1e-4
        if abs(p - 0.5) > 1e-3:
            assert r["kept"] == (not r["base_failed"] and p >= 0.5)


def test_rule_verdicts_against_labels(spark):
    d = "/root/testdata/sf0.01"
    got = quality_rules.quality_rules(spark.read.parquet(f"{d}/documents.parquet")).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").select("kept", "quality").collect()
    kept = {q: [r["kept"] for r in got if r["quality"] == q] for q in (0, 1)}
    assert sum(kept[1]) >= 0.95 * len(kept[1]) and sum(kept[0]) <= 0.05 * len(kept[0])


# ---- packing


def test_ids_of_any_letters_are_those_of_the_whole_text():
    from tokenizers import Tokenizer

    path = packing.vocabulary_path()
    tok, words = Tokenizer.from_file(path), packing.WordTokenizer(path)
    rng = random.Random(5)
    pools = [range(0x20, 0x7F), range(0xA0, 0x250), range(0x300, 0x370), range(0x370, 0x530), range(0x590, 0x700), range(0x900, 0xD00), range(0x1E00, 0x2000), range(0xFB00, 0xFB60), range(0x3040, 0x3100), [0x130, 0x131, 0x9DF, 0x958, 0x9DC, 0x2126]]
    some = lambda: "".join(chr(rng.choice(rng.choice(pools))) for _ in range(rng.randint(1, 6))) + rng.choice(["", ".", ",", "!"])
    texts = ["\u09b9\u09df,", "\u0958.", "\ufb2a.", "\u09dc.", "\u0130.", "\u0130,"] + [rng.choice([" ", "\n", "  "]).join(some() for _ in range(3)) for _ in range(20_000)]
    for k in range(0, len(texts), 500):
        part = texts[k : k + 500]
        for t, ids, e in zip(part, words.ids(part), tok.encode_batch(part, add_special_tokens=False)):
            assert np.frombuffer(ids, "<u4").tolist() == e.ids, ascii(t)


def test_certified_groups_are_consistent(spark):
    rng = random.Random(7)
    docs = spark.createDataFrame([(k, " ".join(["a"] * rng.randint(20, 120))) for k in range(900)], "doc_id long, text string")
    got = packing.pack(docs, group_pieces=30, capacity=256).withColumn("grp", F.floor(F.col("sequence_id") / (1 << 32))).groupBy("grp").agg(F.countDistinct("certified").alias("n")).collect()
    fill = packing.pack(docs, group_pieces=30, capacity=256).groupBy("sequence_id").agg(F.sum("length").alias("n"), F.countDistinct("certified").alias("c")).collect()
    assert all(r["n"] <= 256 and r["c"] == 1 for r in fill) and got


# ---- mixing, exact dedup


def test_many_cells_are_raked_alike(spark):
    rng = random.Random(1)
    cells = spark.createDataFrame([(f"s{a}", f"l{b}", f"t{c}", float(rng.randint(1, 1000))) for a in range(5) for b in range(3) for c in range(2) if (a + b + c) % 7], "source string, lang string, topic string, tokens double")
    goal = {"lang": {"l0": 0.5, "l1": 0.3}}
    a, b = ({(r["source"], r["lang"], r["topic"]): (r["weight"], r["keep_probability"]) for r in mixing.rake(cells, targets=goal, few_cells=n).collect()} for n in (10_000, 0))
    assert a.keys() == b.keys() and all(abs(x - y) < 1e-9 for k in a for x, y in zip(a[k], b[k]))
    share = lambda v: sum(w for (_, lang, _), (w, _) in a.items() if lang == v)
    assert abs(share("l0") - 0.5) < 1e-9 and abs(share("l1") - 0.3) < 1e-9 and abs(share("l2") - 0.2) < 1e-9


def test_a_topic_column_is_raked(spark):
    docs = spark.createDataFrame([(k, "w " * 20, "en", f"s{k % 2}", "ab"[k % 10 < 8]) for k in range(400)], "doc_id long, text string, lang string, source string, subject string")
    got = mixing.mix(docs, topic_col="subject", targets={"topic": {"a": 0.5, "b": 0.5}}).collect()
    p = {r["topic"]: r["keep_probability"] for r in got}
    assert p["a"] == 1.0 and abs(p["b"] - 0.25) < 0.01


@pytest.mark.parametrize("broadcast", [1_000_000, 0])
def test_copies_of_one_digest_and_repeated_rows(spark, monkeypatch, broadcast):
    from quarry.llm import common

    monkeypatch.setattr(common, "BROADCAST_ROWS", broadcast)
    rows = [(k, "same  text" if k % 2 else "same text") for k in range(40)] + [(0, "same text"), (0, "same text"), (0, "same \t text"), (None, "other"), (None, "other"), (50, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = exact_dedup.drop_copies(docs).collect()
    assert Counter((r["doc_id"], r["text"]) for r in out) in (Counter({(0, "same text"): 1, (None, "other"): 1, (50, "z"): 1}), Counter({(0, "same \t text"): 1, (None, "other"): 1, (50, "z"): 1}))
    found = exact_dedup.exact_dedup(docs).collect()
    assert Counter(r["group_size"] for r in found) == {43: 43, 2: 2, 1: 1} and sum(r["kept"] for r in found) == 3
