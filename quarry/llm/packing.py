"""Best-fit packing of token sequences with bound-certified repacking.

1. Whole texts are tokenised once; documents over the capacity are cut into full pieces.
2. Pieces are dealt into groups of bounded size by a hash. Each group is packed by best-fit
   decreasing over a multiset of lengths.
3. A dual-feasible-function bound gives the fewest sequences a group, or the whole, can need. A group
   that reaches its bound is certified. While the whole is above its own bound, the loose sequences
   (those with room) of several groups are dealt together as a new group and packed again; a repacking
   is taken only if it saves a sequence. Rounds go on until the whole reaches its bound, one round saves
   nothing, or all loose sequences have met. How many meet depends on the pieces that are loose, so a
   task holds EXCHANGE groups' worth of them on average at any size.
"""

from __future__ import annotations

import gc
import os
import string
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import give_back
from .common import cut, parts_for

CAPACITY = 4096
END_ID = 1
VOCABULARY = "word_bpe_49k.json"
#: Pieces that a group holds on average, and the groups' worth of loose pieces that meet.
GROUP_PIECES, EXCHANGE = 16_384, 8
#: Words whose ids a task remembers; beyond it the memory starts anew.
WORD_MEMORY = 400_000

_LETTERS = frozenset(string.ascii_letters)


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


class WordTokenizer:
    """Ids of a text by a tokenizer that drops blanks: each run between spaces or line ends is encoded once and remembered.

    The tokenizer parts ASCII letters from punctuation and lowers case, so that "word", "Word" and "word,"
    share the work: a run's core (lowered if it is ASCII, without one closing stop or comma after an ASCII
    letter) is encoded, and the mark's ids are added. Behind any other letter the mark stays: folding may
    end that letter in a combining mark, which the tokenizer joins with the punctuation.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}

    def _encode(self, runs: list[str]) -> None:
        """Encodes runs, joined by spaces, in one call; a token belongs to the run in which it begins."""
        for k in range(0, len(runs), 4096):
            part = runs[k : k + 4096]
            e = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            raw = np.array(e.ids, "<u4").tobytes()
            starts = np.cumsum([0] + [len(w) + 1 for w in part])
            at = (4 * np.searchsorted([o[0] for o in e.offsets], starts)).tolist()
            self.known.update(zip(part, map(raw.__getitem__, map(slice, at[:-1], at[1:]))))

    def ids(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        known = self.known
        if len(known) > WORD_MEMORY:
            known.clear()
        split = [t.replace("\n", " ").split(" ") for t in texts]
        got = [list(map(known.get, runs)) for runs in split]  # one look-up a word; the rest is for new ones
        gaps = [_gaps(x) for x in got]
        cores = {}
        for runs, at in zip(split, gaps):
            for i in at:
                w = runs[i]
                if w not in cores:
                    mark = w[-1] if len(w) > 1 and w[-1] in ".," and w[-2] in _LETTERS else ""
                    core = w[:-1] if mark else w
                    cores[w] = (core.lower() if core.isascii() else core, mark)
        if cores:
            self._encode(list({c for c, _ in cores.values() if c not in known} | {m for m in ".," if m not in known}))
            for w, (core, mark) in cores.items():
                known[w] = known[core] + known[mark] if mark else known[core]
            for runs, x, at in zip(split, got, gaps):
                for i in at:
                    x[i] = known[runs[i]]
        return list(map(b"".join, got))


def _gaps(x: list) -> list[int]:
    """Places of None."""
    at, i = [], -1
    try:
        while True:
            i = x.index(None, i + 1)
            at.append(i)
    except ValueError:
        return at


def _pieces(batches: Iterator[pa.RecordBatch], path: str, capacity: int) -> Iterator[pa.RecordBatch]:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    collecting = gc.isenabled()
    gc.disable()  # nothing here makes reference cycles, and the collector would walk the word memory again and again
    try:
        yield from _encoded(batches, WordTokenizer(path), capacity)  # gone with the task: workers live on and do other work
    finally:
        if collecting:
            gc.enable()
        give_back()


def _encoded(batches: Iterator[pa.RecordBatch], tok: WordTokenizer, capacity: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, 256):
            rows = batch.slice(k, 256)
            texts = [t or "" for t in rows.column(1).to_pylist()]
            cols: list[list] = [[], [], [], [], []]
            for doc, ids in zip(rows.column(0).to_pylist(), tok.ids(texts)):
                ids += END_ID.to_bytes(4, "little")
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    for c, v in zip(cols, (doc, piece, at // 4, len(part) // 4, zlib.crc32(part))):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[2:])], names=["doc_id", "piece", "start", "length", "ids_crc32"])
        give_back()


def best_fit_decreasing(lengths: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """Bin number of each item: longest first, each into the fullest bin that still takes it."""
    order = np.argsort(-lengths, kind="stable")
    bins = np.empty(len(lengths), np.int64)
    room: list[list[int]] = [[] for _ in range(capacity + 1)]  # open bins by the room they have
    some, count = 0, 0  # bit r of some: a bin with room r exists
    for i, n in zip(order.tolist(), lengths[order].tolist()):
        fits = some >> n
        if fits:
            r = n + (fits & -fits).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                some ^= 1 << r
            r -= n
        else:
            b, r, count = count, capacity - n, count + 1
        bins[i] = b
        if r:
            room[r].append(b)
            some |= 1 << r
    return bins


def lower_bound(lengths: np.ndarray, capacity: int = CAPACITY) -> int:
    """The fewest bins that items of these lengths need."""
    return bound_of_counts(np.bincount(lengths, minlength=capacity + 1).astype(np.int64), capacity)


def bound_of_counts(count: np.ndarray, capacity: int = CAPACITY) -> int:
    """By dual feasible functions: the plain sum, rounding u(k), and thresholds (large, middle, dropped). count: items per length."""
    size = np.arange(capacity + 1)
    best = -(-int((count * size).sum()) // capacity)
    for k in range(1, 33):
        x = (k + 1) * size
        u = np.where(x % capacity == 0, size * k, (x // capacity) * capacity)  # in units of 1 / (k * capacity)
        best = max(best, -(-int((count * u).sum()) // (k * capacity)))
    for e in np.unique(np.concatenate([np.arange(0, capacity // 2 + 1, 64), [capacity // 2]])):
        f = np.where(size > capacity - e, capacity, np.where(size >= e, size, 0))
        best = max(best, -(-int((count * f).sum()) // capacity))
    return best


SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, grp long, bin long, room long, certified boolean"
_NAMES = [x.split()[0] for x in SCHEMA.split(", ")]


def _groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Rows sorted by key, one table per key; what is held is one group and one batch."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(batch.schema.get_field_index(key)).to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
        for a, b in zip(edges, edges[1:]):
            if held and held[0].column(batch.schema.get_field_index(key))[0].as_py() != keys[a]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _with_bins(t: pa.Table, grp: np.ndarray, bins: np.ndarray, capacity: int, certified: np.ndarray) -> pa.RecordBatch:
    lengths = t["length"].to_numpy()
    _, bins_dense = np.unique(np.stack([grp, bins], 1), axis=0, return_inverse=True) if len(bins) else (None, bins)
    fill = np.bincount(bins_dense.ravel(), weights=lengths).astype(np.int64)
    cols = [t[c].combine_chunks() for c in _NAMES[:5]]
    return pa.RecordBatch.from_arrays([*cols, pa.array(grp), pa.array(bins), pa.array(capacity - fill[bins_dense.ravel()]), pa.array(certified)], names=_NAMES)


def _pack(batches: Iterator[pa.RecordBatch], capacity: int) -> Iterator[pa.RecordBatch]:
    for t in _groups(batches, "grp"):
        lengths = t["length"].to_numpy()
        bins = best_fit_decreasing(lengths, capacity)
        sure = int(bins.max()) + 1 == lower_bound(lengths, capacity)
        yield _with_bins(t, t["grp"].to_numpy(), bins, capacity, np.full(len(bins), sure))


def _repack(batches: Iterator[pa.RecordBatch], capacity: int, offset: int) -> Iterator[pa.RecordBatch]:
    """The loose sequences of several groups as one new group, packed anew if that saves one."""
    for t in _groups(batches, "meet"):
        lengths = t["length"].to_numpy()
        _, old = np.unique(np.stack([t["grp"].to_numpy(), t["bin"].to_numpy()], 1), axis=0, return_inverse=True)
        old = old.ravel()
        bins = best_fit_decreasing(lengths, capacity)
        if bins.max() >= old.max():
            bins = old.astype(np.int64)
        sure = int(bins.max()) + 1 == lower_bound(lengths, capacity)
        yield _with_bins(t, np.full(len(bins), t["meet"][0].as_py() + offset), bins, capacity, np.full(len(bins), sure))


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES, exchange: bool = True) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, certified.

    certified tells that the sequences of the piece's group are known to be as few as its pieces need;
    full sequences are a group of their own. A null text is packed as an empty one: the end id alone.
    Rows that repeat an id are packed each for itself. Texts of any length are tokenised whole. An empty
    table gives an empty result. Columns other than the id and the text are not read.
    """
    path = path or vocabulary_path()
    pieces = cut(
        docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
        .mapInArrow(partial(_pieces, path=path, capacity=capacity), "doc_id long, piece int, start long, length long, ids_crc32 long")
    )
    full = pieces.where(F.col("length") == capacity).select(
        *_NAMES[:5], F.lit(-1).cast("long").alias("grp"), F.monotonically_increasing_id().alias("bin"), F.lit(0).cast("long").alias("room"), F.lit(True).alias("certified")
    )
    part = pieces.where(F.col("length") < capacity)
    n = part.count()
    groups = max(1, -(-n // group_pieces))
    width = parts_for(docs.sparkSession, n, group_pieces)
    dealt = part.withColumn("grp", F.pmod(F.xxhash64("doc_id", "piece", "length", "ids_crc32"), F.lit(groups)).cast("long"))
    packed = cut(dealt.repartition(width, "grp").sortWithinPartitions("grp").mapInArrow(partial(_pack, capacity=capacity), SCHEMA))
    counts = np.zeros(capacity + 1, np.int64)
    for r in part.groupBy("length").count().collect():  # at most one row per length below the capacity
        counts[r["length"]] = r["count"]
    fewest = bound_of_counts(counts, capacity)
    sequences = lambda: packed.select("grp", "bin").distinct().count()
    now, meets, offset = sequences() if exchange and groups > 1 else fewest, groups, groups
    while meets > 1 and now > fewest:
        loose = packed.where(F.col("room") > 0)
        meets = max(1, -(-loose.count() // (EXCHANGE * group_pieces)))
        loose = loose.withColumn("meet", F.pmod(F.xxhash64("grp", F.lit(offset)), F.lit(meets)).cast("long"))
        kept = packed.where(F.col("room") == 0).withColumn("certified", F.lit(True))
        again = loose.repartition(min(width, meets), "meet").sortWithinPartitions("meet").mapInArrow(partial(_repack, capacity=capacity, offset=offset), SCHEMA)
        packed, offset, before = cut(kept.unionByName(again)), offset + meets, now
        now = sequences()
        if now >= before:
            break
    # a sequence is told by its group and number; places inside it follow the order of its pieces
    rows = full.unionByName(packed).withColumn("sequence_id", F.when(F.col("grp") < 0, -1 - F.col("bin")).otherwise(F.col("grp") * F.lit(1 << 32) + F.col("bin")))
    before = Window.partitionBy("sequence_id").orderBy(F.col("length").desc(), "doc_id", "piece", "ids_crc32").rowsBetween(Window.unboundedPreceding, -1)
    return rows.select(*_NAMES[:5], "sequence_id", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long").alias("offset"), "certified")
