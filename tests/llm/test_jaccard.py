"""The signature tree, its prefixes, frequent tokens and blocks, against brute force."""

import random

import numpy as np
import pyarrow as pa
import pytest
from test_operators import brute_components, collect

from quarry.llm import common, jaccard_join
from quarry.llm.blocks import mix64


@pytest.mark.parametrize("blocks, frequent, broadcast", [(3, 1024, 1_000_000), (3, 4, 1_000_000), (1024, 2, 0), (2, 1, 0)])
def test_blocks_and_frequent_tokens(docs, rows, monkeypatch, blocks, frequent, broadcast):
    monkeypatch.setattr(jaccard_join, "BLOCK_SETS", blocks)
    monkeypatch.setattr(jaccard_join, "FREQUENT_SETS", frequent)
    monkeypatch.setattr(jaccard_join, "FREQUENT_PART", 0.0)
    monkeypatch.setattr(common, "BROADCAST_ROWS", broadcast)
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in collect(jaccard_join.jaccard_classes(docs)))
    assert got == brute_components(rows)


def test_sets_that_share_a_lead_without_links(spark, monkeypatch):
    """All sets stand at the tokens of the lead; only some are linked, so that the sets apart must meet every block."""
    monkeypatch.setattr(jaccard_join, "BLOCK_SETS", 4)
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(6))
    lead = " ".join(word() for _ in range(7))
    rows = []
    for i in range(70):
        tail = [word() for _ in range(rng.randint(0, 4))]
        if i % 7 == 3:
            tail = rows[-1][1].split(" ")[7:] + [word()]
        rows.append((i, " ".join([lead, *tail])))
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in collect(jaccard_join.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string"))))
    assert got == brute_components(rows)


def some_sets(rng, count, low, high):
    base = [[rng.getrandbits(63) for _ in range(rng.randint(low, high))] for _ in range(12)]
    sets = []
    for _ in range(count):
        s = list(rng.choice(base))
        for _ in range(rng.randint(0, len(s) // 4)):
            s[rng.randrange(len(s))] = rng.getrandbits(63)
        sets.append(np.unique(np.array(s, np.uint64)))
    return sets


def test_tree_finds_every_link_within_groups():
    rng = random.Random(4)
    sets = some_sets(rng, 400, 5, 300)
    groups = np.sort(np.array([rng.randrange(9) if k % 3 else 20 for k in range(400)]))
    similar = lambda a, b: 100 * len(np.intersect1d(sets[a], sets[b])) >= 75 * len(np.union1d(sets[a], sets[b]))
    asked = []

    def linked(a, b):
        asked.append((a, b))
        return similar(a, b)

    got = jaccard_join.link_groups(groups, np.array([len(s) for s in sets]), [jaccard_join.bitmap(s) for s in sets], linked)
    want, pairs = jaccard_join.Union(len(sets)), 0
    for a in range(len(sets)):
        for b in range(a):
            if groups[a] == groups[b]:
                pairs += 1
                if similar(a, b):
                    want.join(np.array([a]), np.array([b]))
    assert (got == want.root).all()
    assert len(asked) < pairs / 4  # the tree leaves most pairs unseen
    loose = jaccard_join.link_groups(groups, np.array([len(s) for s in sets]), [jaccard_join.bitmap(s) for s in sets])
    assert (loose[want.root] == loose).all()  # possible links hold the true ones


def test_upper_nodes_prune_pairs():
    """Sets of different groups, sizes or tokens are left at the nodes, not at the leaves."""
    rng = random.Random(5)
    sets = [np.array(sorted(rng.getrandbits(63) for _ in range(64)), np.uint64) for _ in range(4096)]
    tree = jaccard_join.Tree(np.arange(4096), np.arange(4096) // 2, np.full(4096, 64), np.stack([jaccard_join.bitmap(s) for s in sets]))
    top = tree.levels[1]
    i, j = (x.ravel() for x in np.meshgrid(np.arange(128), np.arange(128), indexing="ij"))
    assert jaccard_join._may_link(top, top, i, j).sum() == 128


@pytest.mark.parametrize("size, often", [(130, 0), (400, 0), (400, 40), (3000, 0), (3000, 900)])
def test_long_barely_linked_pairs_share_a_prefix_token(monkeypatch, size, often):
    """Similarity from 0.75 to 0.76: the tokens at which two texts stand must meet, with some of the shared tokens frequent, too."""
    rng = random.Random(size + often)
    for _ in range(60):
        both = -(-size * 3 // 4)
        a = [rng.getrandbits(64) for _ in range(both)]
        left = size - both
        x, y = a + [rng.getrandbits(64) for _ in range(left // 2)], a + [rng.getrandbits(64) for _ in range(left - left // 2)]
        assert 100 * both >= 75 * size

        class Fixed:
            def __init__(self, *_):
                h = [np.sort(np.array(v, np.uint64)) for v in (x, y)]
                self.hash, self.doc = np.concatenate(h), np.repeat([0, 1], [len(v) for v in h])
                self.n, self.bounds = np.array([len(v) for v in h]), np.array([0, len(h[0]), len(h[0]) + len(h[1])])
                self.cls = np.array([1, 2])

            def of(self, d):
                return self.hash[self.bounds[d] : self.bounds[d + 1]]

        monkeypatch.setattr(jaccard_join, "Sets", Fixed)
        batch = pa.RecordBatch.from_arrays([pa.array(["x", "y"])], names=["text"])
        frequent = np.sort(np.array(a[:often], np.uint64))
        out = next(jaccard_join._deal(iter([batch]), 32, frequent))
        token, cls = out.column(0).to_numpy(), out.column(1).to_numpy()
        assert set(token[cls == 1]) & set(token[cls == 2])


def test_summary_holds_the_frequent_tokens():
    rng = np.random.default_rng(3)
    common_token = np.uint64(12345)
    often = jaccard_join.Frequent()
    for k in range(20):
        class S:
            doc = np.repeat(np.arange(50), 40)
            hash = mix64(rng.integers(1, 2**63, 2000, dtype=np.uint64))
        S.hash[::40] = common_token
        often.add(S, np.ones(50, bool))
    token, count = often.told()
    assert dict(zip(token.tolist(), count.tolist()))[int(common_token)] == 1000 and len(token) < 100
