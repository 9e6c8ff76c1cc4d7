import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
from test_models import plain_match
from test_operators import brute_components

from quarry.llm import jaccard_join, mixing, packing, toxicity


def test_stages(spark, docs, rows, tmp_path):
    import corpus_pipeline as p

    folder = str(tmp_path)
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    now = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, now, folder)
        assert out.columns == now.columns, name
        out.write.parquet(f"{folder}/{name}")
        now = spark.read.parquet(f"{folder}/{name}")
        if name == "jaccard_join":
            found = jaccard_join.jaccard_classes(now).where("n_shingles > 0")
            assert found.count() == found.select("component_id").distinct().count()
    packed = p.run(spark, folder)
    assert {r[0] for r in packed.select("doc_id").distinct().collect()} == {r["doc_id"] for r in now.collect()}


def made(seed=21):
    """Documents with toxic ones, exact and near copies and odd texts, and labels for most of them."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("aeionrst") for _ in range(rng.randint(2, 7))) for _ in range(500)]
    rows, labels = [], []
    for i in range(300):
        w = [rng.choice(vocabulary) for _ in range(rng.randint(12, 120))]
        toxic = i % 5 == 2
        for _ in range(3 if toxic else 0):
            w.insert(rng.randrange(len(w)), rng.choice(["glorbuk", "zumpfik", "drekholem"]))
        text = " ".join(w)
        if i % 10 == 6:
            text = rows[i - 3][1].replace(" ", "  ", 2)
        if i % 10 == 8 and len(rows[i - 7][1].split()) > 60:
            text = rows[i - 7][1] + " " + w[0]
        rows.append((1000 - i, text, ["en", "de"][i % 4 == 0], f"s{i % 3}", len(text)))
        if i % 10 not in (6, 8) and i % 3:
            labels.append((1000 - i, 1, int(toxic)))
    rows += [(1, None, "en", "s0", 0), (2, "", None, "s1", 0), (3, "long " * 9000, "en", None, 45000), (4, rows[3][1], "en", "s2", 0)]
    return rows, labels


def plain_run(rows, model):
    """The stages but packing in plain Python; the fitted layer is given."""
    def score(t):
        tokens = (t or "").lower().split()
        kind = [9 if x.strip(toxicity.EDGE) in model.spared else plain_match(x.strip(toxicity.EDGE), model.lexicon) for x in tokens]
        a, f = sum(e == 0 for e in kind), sum(0 < e < 9 for e in kind)
        x = [float(a > 0), min(a, 4) / 4, float(f > 0), min(f, 4) / 4, min(1.0, 20 * (a + f) / len(tokens)) if tokens else 0.0, 0.0, 1.0]
        return 1 / (1 + math.exp(-sum(p * q for p, q in zip(x, model.weights))))

    rows = [r for r in rows if score(r[1]) < 0.7]
    first = {}
    for r in rows:
        key = re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "")
        first[key] = min(first.get(key, r[0]), r[0])
    rows = [r for r in rows if r[0] in first.values()]
    component = {i: c for i, _, c in brute_components(rows)}
    rows = [r for r in rows if component[r[0]] == r[0]]

    def cell(r):
        n, bars = len((r[1] or "").split()), (r[1] or "").count("|")
        return (r[3] or "(none)", r[2] or "(none)", "table" if bars * 10 > n else "long" if n >= 1000 else "article" if n >= 200 else "brief"), n + 1

    tokens = Counter()
    for r in rows:
        tokens[cell(r)[0]] += cell(r)[1]
    total, goals, common = sum(tokens.values()), [], []
    for d, name in enumerate(mixing.DIMENSIONS):
        share = Counter()
        for c, n in tokens.items():
            share[c[d]] += n / total
        power = {k: v ** mixing.TEMPER[name] for k, v in share.items()}
        goals.append({k: v / sum(power.values()) for k, v in power.items()})
        common.append({k for k, v in share.items() if v * len(share) >= mixing.RARE})
    weight = {c: n / total for c, n in tokens.items()}
    for _ in range(200):
        for d in range(3):
            now = Counter()
            for c, w in weight.items():
                now[c[d]] += w
            weight = {c: w * goals[d][c[d]] / now[c[d]] for c, w in weight.items()}
    ratio = {c: weight[c] / tokens[c] for c in tokens}
    scale = max(v for c, v in ratio.items() if all(c[d] in common[d] for d in range(3)))
    chance = lambda i: int(hashlib.md5(f"{mixing.SEED}:{i}".encode()).hexdigest()[:13], 16) / (1 << 52)
    return [r for r in rows if chance(r[0]) < round(min(ratio[cell(r)[0]] / scale, 1.0), 9)]


def test_run_against_plain_python(spark, tmp_path):
    from tokenizers import Tokenizer

    import corpus_pipeline as p

    rows, labels = made()
    folder = str(tmp_path)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    model = toxicity.fit(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"))
    kept = plain_run(rows, model)
    toxic = {1000 - i for i in range(300) if i % 5 == 2 and i % 10 not in (6, 8)}
    assert not toxic & {r[0] for r in kept} and 60 < len(kept) < 240
    tok, want = Tokenizer.from_file(packing.vocabulary_path()), Counter()
    for r in kept:
        ids = np.array(tok.encode(r[1] or "", add_special_tokens=False).ids + [1], "<u4")
        for k, at in enumerate(range(0, len(ids), 4096)):
            want[(r[0], k, at, len(ids[at : at + 4096]), zlib.crc32(ids[at : at + 4096].tobytes()))] += 1
    got = p.run(spark, folder).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    places = defaultdict(list)
    for r in got:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for s in places.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 4096
