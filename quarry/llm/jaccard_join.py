"""N-gram Jaccard join by signature trees, and the classes of documents it links.

1. Every text becomes its set of 5-word shingle hashes (tokens); equal sets form one class, handled once.
   The same scan sums up which tokens are frequent.
2. One signature tree holds all classes. Its upper levels are ranges of tokens: a class stands there once
   for each of the n - ceil(0.75 n) + 1 first tokens of its set, one of which two linked sets must share,
   so two nodes of different tokens have no overlap to offer and are never paired. Frequent tokens come
   last in the order, so a passage that many documents share does not bring them together; only sets that
   are mostly made of such passages stand there. A set without a frequent token among its 32 first stands
   at those only: the chance that none of the 32 first of a linked pair's union is shared is at most
   0.25 ** 32 = 2 ** -64, the odds at which two different shingles share a 64-bit hash (prefix=None: no
   such short cut).
3. Tokens with the same members are one token. What stands at a token more often than BLOCK_SETS is cut by
   set size (linked sets differ by a third at most) and by a hash into blocks, another cut for each token.
4. Below a token the nodes of the tree have the OR of their members' token bitmaps and their size range.
   A task holds the subtree of its tokens; node pairs are visited from its root and left when their tokens
   or sizes can't meet, their largest possible overlap is too small, or their members are linked already.
5. Sets that remain together meet once more with their full tokens in the same tree, and links are
   verified exactly. Connected components over these links give the classes.
6. Blocks are linked each for itself first. Where that joins all sets of a token, as it does with near
   copies, its pairs of blocks have nothing to add. Else the sets outside the token's largest component
   meet all its blocks, so the work follows what is still apart.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import Words, give_back, mix64, slices
from .common import cut, small
from .packing import _groups

SHINGLE = 5
#: Linked if NUM * union <= DEN * intersection, that is a similarity of 0.75 or more.
NUM, DEN = 75, 100
PREFIX = 32
#: A token is frequent if more sets than this hold it, and more than this part of all rows; that bounds the frequent tokens.
FREQUENT_SETS, FREQUENT_PART = 1024, 1e-3
#: Tokens that a task's summary holds between two slices.
SUMMARY = 1 << 16
#: Sets, and shingles, that a block holds on average.
BLOCK_SETS, BLOCK_SHINGLES = 1024, 2_000_000
#: Rows that are put into one tree, and bytes of their bitmaps or shingles.
TREE_ROWS, TREE_BYTES = 4096, 16 << 20
LEAF, FAN = 32, 8
#: Bytes of bitmaps or shingles that a task reads on average.
TASK_BYTES = 128 << 20

_U = np.uint64


class Sets:
    """Shingle sets of a run of documents: hashes sorted within each document."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        w = Words(data, offsets, lower=True)
        n_words = np.diff(w.first)
        start, h = w.windows(SHINGLE)
        doc = np.searchsorted(w.first, start, side="right") - 1
        for d in np.flatnonzero((n_words > 0) & (n_words < SHINGLE)).tolist():  # shorter texts: the whole sequence
            x = np.array([n_words[d]], np.uint64)
            for k in range(w.first[d], w.first[d + 1]):
                x = mix64(x * _U(0x9E3779B97F4A7C15) + w.hash[k])
            doc, h = np.append(doc, d), np.append(h, x)
        order = np.lexsort((h, doc))
        doc, h = doc[order], h[order]
        if len(h):
            first = np.ones(len(h), bool)
            first[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
            doc, h = doc[first], h[first]
        self.hash, self.doc = h, doc
        self.bounds = np.searchsorted(doc, np.arange(len(offsets)))
        self.n = np.diff(self.bounds)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(h ^ _U(0xA0761D6478BD642F)))])
        self.cls = mix64((sums[self.bounds[1:]] - sums[self.bounds[:-1]]) * _U(3) + self.n.astype(np.uint64)).view(np.int64)

    def of(self, d: int) -> np.ndarray:
        return self.hash[self.bounds[d] : self.bounds[d + 1]]


class Frequent:
    """Counts of the tokens of a task that may be frequent: exact but for tokens that were too rare to be held."""

    def __init__(self):
        self.token, self.count, self.sets = np.zeros(0, np.uint64), np.zeros(0, np.int64), 0

    def add(self, s: Sets, fresh: np.ndarray) -> None:
        self.sets += int(fresh.sum())
        token, count = np.unique(s.hash[fresh[s.doc]], return_counts=True)
        token, back = np.unique(np.concatenate([self.token, token]), return_inverse=True)
        count = np.bincount(back, weights=np.concatenate([self.count, count]), minlength=len(token)).astype(np.int64)
        if len(token) > SUMMARY:
            pick = np.argpartition(-count, SUMMARY)[:SUMMARY]
            token, count = token[pick], count[pick]
        self.token, self.count = token, count

    def told(self) -> tuple[np.ndarray, np.ndarray]:
        ok = self.count >= max(2.0, 0.25 * FREQUENT_PART * self.sets)
        return self.token[ok], self.count[ok]


def _fresh(s: Sets) -> np.ndarray:
    """The first document of each class of a run, if it has a set."""
    out = np.zeros(len(s.n), bool)
    out[np.unique(s.cls, return_index=True)[1]] = True
    return out & (s.n > 0)


_CLASSES = "doc_id long, text_key long, n long, cls long, token boolean"


def _classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, text_key, n and cls of each row; at the end the frequent tokens (as cls) with their counts (as n)."""
    names, often = [x.split()[0] for x in _CLASSES.split(", ")], Frequent()
    for batch in batches:
        for part, data, offsets in slices(batch, "text"):
            s = Sets(data, offsets)
            often.add(s, _fresh(s))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(s.n.astype(np.int64)), pa.array(s.cls), pa.array(np.zeros(len(s.n), bool))], names=names)
    token, count = often.told()
    none = pa.nulls(len(token), pa.int64())
    yield pa.RecordBatch.from_arrays([none, none, pa.array(count), pa.array(token.view(np.int64)), pa.array(np.ones(len(token), bool))], names=names)


_DEALT = "token long, cls long, n long, payload binary"


def _deal(batches: Iterator[pa.RecordBatch], prefix: int | None, frequent: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(token, cls, n) for the tokens at which each class stands, and (cls, payload) with its bitmap."""
    names = [x.split()[0] for x in _DEALT.split(", ")]
    for batch in batches:
        for _, data, offsets in slices(batch, "text"):
            s = Sets(data, offsets)
            fresh = _fresh(s)  # copies in the same run are dealt once
            exact = np.where(s.n > 0, s.n - (-(-s.n * NUM // DEN)) + 1, 0)
            take = np.minimum(exact, prefix or np.iinfo(np.int64).max)
            place = np.arange(len(s.hash)) - s.bounds[s.doc]
            token, doc = s.hash, s.doc
            if len(frequent):
                at = np.minimum(np.searchsorted(frequent, token), len(frequent) - 1)
                often = frequent[at] == token
                hit = np.unique(doc[often & (place < take[doc])])  # sets with a frequent token among their first: the whole prefix, frequent ones last
                take[hit] = exact[hit]
                moved = np.zeros(len(s.n), bool)
                moved[hit] = True
                order = np.lexsort((token, often & moved[doc], doc))
                token = token[order]
            pick = (place < take[doc]) & fresh[doc]
            cls = s.cls[doc[pick]]
            yield pa.RecordBatch.from_arrays([pa.array(token[pick].view(np.int64)), pa.array(cls), pa.array(s.n[doc[pick]].astype(np.int64)), pa.nulls(len(cls), pa.binary())], names=names)
            one = np.flatnonzero(fresh)
            none = pa.nulls(len(one), pa.int64())
            yield pa.RecordBatch.from_arrays([none, pa.array(s.cls[one]), none, pa.array([bitmap(s.of(d)).tobytes() for d in one.tolist()], pa.binary())], names=names)


def bitmap_words(n: int) -> int:
    """64-bit words of the bitmap of a set of n: a power of two with four bits or more a shingle."""
    return max(1, 1 << max(0, (4 * n - 1).bit_length() - 6))


def bitmap(h: np.ndarray) -> np.ndarray:
    bits = np.zeros(64 * bitmap_words(len(h)), bool)
    bits[(h & _U(len(bits) - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").view("<u8")


def _full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, data, offsets in slices(batch, "text"):
            s = Sets(data, offsets)
            yield pa.RecordBatch.from_arrays([pa.array(s.cls), pa.array([s.of(d).tobytes() for d in range(len(s.n))], pa.binary())], names=["cls", "payload"])


class Union:
    """Sets of positions, each told by its smallest; every position points at it directly."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        """Joins the sets of a[k] and b[k] for every k."""
        while True:
            ra, rb = self.root[a], self.root[b]
            apart = ra != rb
            if not apart.any():
                return
            np.minimum.at(self.root, np.maximum(ra, rb)[apart], np.minimum(ra, rb)[apart])
            while True:
                nxt = self.root[self.root]
                if (nxt == self.root).all():
                    break
                self.root = nxt


class Tree:
    """Sets of one bitmap width, by group and size; level 0 is the items, each node above has the OR, the sizes and the groups of its run."""

    def __init__(self, items: np.ndarray, groups: np.ndarray, sizes: np.ndarray, bits: np.ndarray):
        order = np.lexsort((sizes, groups))
        self.items = items[order]
        bits, sizes, groups = bits[order], sizes[order], groups[order]
        spare = sizes - np.bitwise_count(bits).sum(axis=1).astype(np.int64)
        self.levels = [(bits, sizes, sizes, spare, groups, groups, np.arange(len(order) + 1))]
        fan = LEAF
        while len(self.levels) == 1 or len(self.levels[-1][1]) > FAN:
            b, low, high, spare, first, last, _ = self.levels[-1]
            at = np.arange(0, len(low), fan)
            self.levels.append((np.bitwise_or.reduceat(b, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(spare, at), np.minimum.reduceat(first, at), np.maximum.reduceat(last, at), np.append(at, len(low))))
            fan = FAN


def _may_link(a: tuple, b: tuple, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Node pairs whose groups, size ranges and largest possible overlap allow a link."""
    bits_a, low_a, high_a, spare_a, first_a, last_a, _ = a
    bits_b, low_b, high_b, spare_b, first_b, last_b, _ = b
    la, lb = low_a[i], low_b[j]
    ok = (first_a[i] <= last_b[j]) & (first_b[j] <= last_a[i]) & (DEN * high_b[j] >= NUM * la) & (DEN * high_a[i] >= NUM * lb)
    k = np.flatnonzero(ok)
    step = max(1, (1 << 19) // bits_a.shape[1])
    for c in range(0, len(k), step):
        p = k[c : c + step]
        both = np.bitwise_count(bits_a[i[p]] & bits_b[j[p]]).sum(axis=1).astype(np.int64)
        most = np.minimum(both + np.minimum(spare_a[i[p]], spare_b[j[p]]), np.minimum(high_a[i[p]], high_b[j[p]]))
        ok[p] = (DEN + NUM) * most >= NUM * (la[p] + lb[p])
    return ok


def _spread(start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """start[k], start[k] + 1, ... (count[k] of them) for every k, and the k of each."""
    of = np.repeat(np.arange(len(count)), count)
    return np.repeat(start - (np.cumsum(count) - count), count) + np.arange(len(of)), of


def _pairs(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of a child of i[k] and a child of j[k]; a and b: the first child of each node."""
    na, nb = a[i + 1] - a[i], b[j + 1] - b[j]
    x, of = _spread(a[i], na)
    y, of2 = _spread(b[j][of], nb[of])
    return x[of2], y


def _traverse(a: Tree, b: Tree, union: Union, linked) -> None:
    """Visits the node pairs of two trees; linked(p, q) decides on two items in different components (None: yes)."""
    same = a is b
    ka, kb = len(a.levels) - 1, len(b.levels) - 1
    i, j = (x.ravel() for x in np.meshgrid(np.arange(len(a.levels[ka][1])), np.arange(len(b.levels[kb][1])), indexing="ij"))
    while True:
        if same:
            i, j = i[i <= j], j[i <= j]
        ok = _may_link(a.levels[ka], b.levels[kb], i, j)
        i, j = i[ok], j[ok]
        if (ka, kb) == (1, 1) or not len(i):
            break
        down_a, down_b = ka >= kb and ka > 1, kb >= ka and kb > 1  # the higher side goes down
        own = lambda t, k, down: t.levels[k][6] if down else np.arange(len(t.levels[k][1]) + 1)
        i, j = _pairs(own(a, ka, down_a), own(b, kb, down_b), i, j)
        ka, kb = ka - down_a, kb - down_b
    at_a, at_b = a.levels[1][6], b.levels[1][6]
    for c in range(0, len(i), 64):  # leaf pairs: LEAF by LEAF items at most
        x, y = i[c : c + 64], j[c : c + 64]
        ra, rb = union.root[a.items], union.root[b.items]
        low_a, high_a = np.minimum.reduceat(ra, at_a[:-1]), np.maximum.reduceat(ra, at_a[:-1])
        low_b, high_b = np.minimum.reduceat(rb, at_b[:-1]), np.maximum.reduceat(rb, at_b[:-1])
        apart = np.minimum(low_a[x], low_b[y]) != np.maximum(high_a[x], high_b[y])
        p, q = _pairs(at_a, at_b, x[apart], y[apart])
        keep = (a.levels[0][4][p] == b.levels[0][4][q]) & (ra[p] != rb[q])
        if same:
            keep &= p < q
        p, q = p[keep], q[keep]
        ok = _may_link(a.levels[0], b.levels[0], p, q)
        p, q = a.items[p[ok]], b.items[q[ok]]
        if linked is None:
            union.join(p, q)
        else:
            for s, t in zip(p.tolist(), q.tolist()):
                if union.root[s] != union.root[t] and linked(s, t):
                    union.join(np.array([s]), np.array([t]))


def link_groups(groups: np.ndarray, sizes: np.ndarray, maps: list[np.ndarray], linked=None) -> np.ndarray:
    """Component (smallest position) of each set within its group. Without linked, possible links count."""
    union = Union(len(sizes))
    width = np.array([len(m) for m in maps])
    trees: dict[int, Tree] = {}
    for w in np.unique(width).tolist():
        at = np.flatnonzero(width == w)
        bits = np.stack([maps[k] for k in at.tolist()])
        trees[w] = Tree(at, groups[at], sizes[at], bits)
        _traverse(trees[w], trees[w], union, linked)
        if w // 2 in trees:  # linked sets differ by a third at most, so their widths by one step
            folded = Tree(at, groups[at], sizes[at], bits[:, : w // 2] | bits[:, w // 2 :])
            _traverse(trees[w // 2], folded, union, linked)
    return union.root


def _trees(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows sorted by key: whole groups of two sets or more, together TREE_ROWS or TREE_BYTES or one group, each set once, and their group numbers."""
    held, rows, size, number = [], 0, 0, []
    for t in _groups(batches, key):
        _, first = np.unique(t["cls"].to_numpy(), return_index=True)
        if len(first) < 2:
            continue
        t = t.take(pa.array(first))
        if held and (rows + len(first) > TREE_ROWS or size + t.nbytes > TREE_BYTES):
            yield pa.concat_tables(held), np.repeat(np.arange(len(number)), number)
            held, rows, size, number = [], 0, 0, []
            give_back()
        held.append(t)
        number.append(len(first))
        rows, size = rows + len(first), size + t.nbytes
    if held:
        yield pa.concat_tables(held), np.repeat(np.arange(len(number)), number)
    del held
    give_back()


def _payloads(t: pa.Table) -> list[np.ndarray]:
    """Each row's payload, in place."""
    column = t["payload"].combine_chunks()
    _, at, data = column.buffers()
    at = np.frombuffer(at, np.int32)[column.offset : column.offset + len(column) + 1].tolist()
    raw = np.frombuffer(data, np.uint8)
    return [raw[a:b].view(np.uint64) for a, b in zip(at, at[1:])]


def _refine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Groups as parts within which links are possible; equal parts get equal numbers."""
    for t, groups in _trees(batches, "grp"):
        cls, sizes = t["cls"].to_numpy(), t["n"].to_numpy()
        root = link_groups(groups, sizes, _payloads(t))
        many = np.bincount(root, minlength=len(cls))[root] > 1
        sums = np.zeros(len(cls), np.uint64)
        np.add.at(sums, root[many], mix64(cls[many].view(np.uint64)) + _U(1))
        part = mix64(sums)[root].view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(part[many]), pa.array(cls[many]), pa.array(sizes[many])], names=["part", "cls", "n"])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """True links within a part, as each member's smallest connected class."""
    for t, groups in _trees(batches, "part"):
        cls, sets = t["cls"].to_numpy(), _payloads(t)

        def linked(s: int, t_: int) -> bool:
            a, b = sets[s], sets[t_]
            both = len(np.intersect1d(a, b, assume_unique=True))
            return DEN * both >= NUM * (len(a) + len(b) - both)

        root = link_groups(groups, np.array([len(s) for s in sets]), [bitmap(s) for s in sets], linked)
        far = np.flatnonzero(root != np.arange(len(cls)))
        yield pa.RecordBatch.from_arrays([pa.array(cls[far]), pa.array(cls[root[far]])], names=["u", "v"])


def components(edges: DataFrame) -> DataFrame:
    """u, root for every node of the edges (u, v) but the roots: alternating large and small stars.

    Nodes are longs; a component's root is its smallest. Every round is a reduce-by-key and a join, and is
    cut by a checkpoint; no link leaves the executors but two counters per round. Rounds go on until
    nothing changes. Minima are summed up before the shuffle, and in each join one side has one row per
    node, so that adaptive execution can split the many rows of a large component's root.
    """
    e = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    before = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        e = cut(small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        # a forest of stars: every node has one edge, and no root has one
        now = e.agg(F.count(F.lit(1)).alias("n"), F.expr("coalesce(bit_xor(xxhash64(u, v)), 0)").alias("x")).first()
        if now == before or now["n"] == 0:
            break
        before = now
    return e.select("u", F.col("v").alias("root"))


def _dealt(df: DataFrame, key: str, size: Column, payload: DataFrame, fewest: int) -> DataFrame:
    """df with the payload of each class, sorted by key, in so many partitions that each holds TASK_BYTES on average."""
    total = df.agg(F.sum(size)).first()[0] or 0
    return df.join(payload, "cls").repartition(max(fewest, -(-int(total) // TASK_BYTES)), key).sortWithinPartitions(key)


def jaccard_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix: int | None = PREFIX, with_key: bool = False) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, n_linked_sets and, if asked for, text_key (a hash of the text).

    component_id is the smallest id reachable by links, the row's own included; n_linked_sets counts
    the different sets of its component. Texts are read whole whatever their length. Null, empty and blank
    texts have no set and stand alone. Repeated rows are in one class; null ids are ignored when the
    smallest id is sought. An empty table gives an empty result. Other columns, whatever their names, are
    not read.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("text_key"))
    text = base.select("text")
    staged = cut(base.mapInArrow(_classes, _CLASSES))
    rows = staged.where("not token").drop("token")
    keys = ["text_key"] if with_key else []
    least = max(FREQUENT_SETS, int(FREQUENT_PART * rows.count()))
    told = staged.where("token").groupBy("cls").agg(F.sum("n").alias("c")).where(F.col("c") > least)
    frequent = np.sort(np.array([r["cls"] for r in told.collect()], np.int64).view(np.uint64))  # fewer than shingles per set / FREQUENT_PART, whatever the rows

    staged = cut(text.mapInArrow(partial(_deal, prefix=prefix, frequent=frequent), _DEALT))
    maps = staged.where("token is null").select("cls", "payload").dropDuplicates(["cls"])
    dealt = staged.where("token is not null").select("token", "cls", "n")
    shared = dealt.groupBy("token").agg(F.min("cls").alias("a"), F.max("cls").alias("b")).where("a <> b").select("token")
    members = cut(dealt.join(shared, "token").distinct())
    by_token = members.groupBy("token").agg(
        F.count(F.lit(1)).alias("c"), F.sum("n").alias("s"), F.expr("bit_xor(xxhash64(cls, 1))").alias("x"), F.expr("bit_xor(xxhash64(cls, 2))").alias("y")
    )
    groups = by_token.groupBy("c", "s", "x", "y").agg(F.min("token").alias("token"))
    large = (F.col("c") > BLOCK_SETS) | (F.col("s") > BLOCK_SHINGLES)
    grouped = cut(members.join(groups.select("token", "c", "s"), "token"))
    whole = grouped.where(~large).select(F.col("token").alias("grp"), "cls", "n")

    # large groups: by size band (a band spans a factor of 4/3; links reach the next band at most), then blocks
    band = F.floor(F.log("n") / F.log(F.lit(DEN / NUM)) + 1e-9).cast("long")
    banded = grouped.where(large).withColumn("band", F.explode(F.array(band, band - 1))).select("token", "band", "cls", "n")
    blocks = lambda: F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_SETS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int")
    sized = banded.groupBy("token", "band").agg(blocks().alias("k"))
    cut_up = cut(banded.join(sized, ["token", "band"]).withColumn("own", F.pmod(F.xxhash64("cls", "token"), F.col("k").cast("long")).cast("int")))
    fewest = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)

    def linked(meet: DataFrame) -> DataFrame:
        """The verified links (u, v) within the groups of meet(grp, cls, n), as a forest of stars."""
        parts = cut(_dealt(meet, "grp", F.col("n") + 64, maps, fewest).mapInArrow(_refine, "part long, cls long, n long").distinct())
        needed = small(rows.join(parts.select("cls").distinct(), "cls").groupBy("cls").agg(F.min("text_key").alias("needed")).select("needed"))
        full = base.join(needed, base["text_key"] == needed["needed"], "left_semi").select("text").mapInArrow(_full_sets, "cls long, payload binary").dropDuplicates(["cls"])
        return _dealt(parts, "part", 8 * F.col("n") + 64, full, fewest).mapInArrow(_verify, "u long, v long")

    alone = cut_up.select(F.xxhash64("token", "band", "own").alias("grp"), "cls", "n")
    of_class = components(linked(whole.unionByName(alone)))
    of = cut_up.where("k > 1").join(of_class.withColumnRenamed("u", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    counted = cut(of.groupBy("token", "band", "root").agg(F.count(F.lit(1)).alias("c")))
    split = cut(counted.groupBy("token", "band").agg(F.max(F.struct("c", "root")).alias("m"), F.count(F.lit(1)).alias("parts")).where("parts > 1").select("token", "band", F.col("m.root").alias("main")))
    if not split.isEmpty():  # what is outside the largest component of its token and band meets every block
        of = cut(of.join(split, ["token", "band"]))
        out = of.where("root <> main")
        piles = cut(out.groupBy("token", "band").agg(blocks().alias("piles")))
        meeting = lambda df: df.select(F.xxhash64("token", "band", "own", "pile").alias("grp"), "cls", "n")
        here = meeting(of.join(piles, ["token", "band"]).withColumn("pile", F.explode(F.sequence(F.lit(0), F.col("piles") - 1))))
        pile = out.join(piles, ["token", "band"]).withColumn("pile", F.pmod(F.xxhash64("cls", "band"), F.col("piles").cast("long")).cast("int"))
        there = meeting(pile.withColumn("own", F.explode(F.sequence(F.lit(0), F.col("k") - 1))))
        of_class = components(linked(here.unionByName(there).distinct()).unionByName(of_class.withColumnRenamed("root", "v")))
    of_class = of_class.withColumnRenamed("u", "cls")
    classes = rows.where("n > 0").groupBy("cls").agg(F.min("doc_id").alias("low"))
    labelled = classes.join(of_class, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    lows = labelled.groupBy("root").agg(F.min("low").alias("component_id"), F.count(F.lit(1)).alias("n_linked_sets"))
    found = cut(labelled.join(lows, "root").select("cls", "component_id", "n_linked_sets"))
    return rows.where("n > 0").join(found, "cls").select("doc_id", F.col("n").alias("n_shingles"), "component_id", "n_linked_sets", *keys).unionByName(
        rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_linked_sets"), *keys)
    )


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of each linked class, that of the smallest id; all columns stay as they are.

    Rows are told by id and text: where different texts repeat an id, one may go and the other stay. A row
    with a null id goes if its class has a row with an id. Rows repeated whole stay or go together, and
    texts without words stay.
    """
    found = jaccard_classes(docs, id_col, text_col, with_key=True)
    gone = small(found.where(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("i"), F.col("text_key").alias("k")).distinct())
    marked = docs.select(F.struct("*").alias("doc"), F.col(id_col).cast("long").alias("own"), F.xxhash64(F.col(text_col)).alias("key"))
    return marked.join(gone, F.col("own").eqNullSafe(F.col("i")) & (F.col("key") == F.col("k")), "left_anti").select("doc.*")


#: Doubling reaches 64 hops; no shortest path between linked documents of the test tables is as long.
_HOPS = "\n".join(f"r{k + 1} AS MATERIALIZED (SELECT DISTINCT a.u, b.v FROM r{k} a JOIN r{k} b ON a.v = b.u)," for k in range(6))
SQL = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i : i + 4], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS sh FROM d),
e AS MATERIALIZED (SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM s),
c AS (SELECT a.doc_id AS u, b.doc_id AS v, a.n AS m, b.n AS n, count(*) AS common FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS MATERIALIZED (SELECT u, v FROM c WHERE 100 * common >= 75 * (m + n - common)),
r0 AS MATERIALIZED (SELECT doc_id AS u, doc_id AS v FROM s UNION SELECT u, v FROM link),
HOPS
g AS (SELECT u AS doc_id, min(v) AS component_id FROM r6 GROUP BY 1),
k AS (SELECT component_id, count(DISTINCT md5(array_to_string(list_sort(sh), chr(10)))) AS n_linked_sets FROM g JOIN s USING (doc_id) WHERE len(sh) > 0 GROUP BY 1)
SELECT s.doc_id, len(sh) AS n_shingles, component_id, CASE WHEN len(sh) = 0 THEN 0 ELSE n_linked_sets END AS n_linked_sets
FROM s JOIN g USING (doc_id) LEFT JOIN k USING (component_id)
""".replace("HOPS", _HOPS)
