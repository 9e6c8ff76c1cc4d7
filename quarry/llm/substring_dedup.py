"""Substring deduplication with difference-cover anchors.

A window is 20 consecutive words. Its words go if the same window also starts earlier: in a document of
smaller id, or earlier in the same document.

1. Documents are staged once as compressed pages of about 1 MB.
2. Anchors: windows of 8 words are hashed only at positions whose remainder modulo 13 is in the
   difference cover {0, 1, 3, 9}. For any two positions there is a shift below 13 that takes both into
   the cover, so two equal windows of 20 words share an aligned anchor of 8 inside them. A page deals each
   of its different anchors once to a bucket, as 32 bits, and the bucket answers with one bit each: does
   another page have it? An accidental yes costs a few windows dealt for nothing, never a word.
3. Extension: only windows around a shared anchor are hashed whole and dealt, once per page and
   different window, with the page's earliest place of it. The bucket answers with the places that
   are not the earliest of all. Windows are told apart by 96 bits mixed from BLAKE2 digests of their words.
4. Pages mark the words under those windows and give what is left.

A page deals every different anchor or window once however often it occurs, so no bucket holds more
entries of one hash than there are pages. Buckets grow in number with the pages.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial
from itertools import compress

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import Words, slices
from .common import cut

WINDOW = 20
#: Positions that are hashed, modulo the period: every difference modulo 13 occurs between two of them.
PERIOD, COVER = 13, (0, 1, 3, 9)
ANCHOR = WINDOW - PERIOD + 1
#: Pages whose anchors one bucket takes on average.
PAGES_PER_BUCKET = 20

#: Words that are split and digested at once.
WORDS_AT_ONCE = 1 << 16

_U = np.uint64
_IN_COVER = np.isin(np.arange(PERIOD), COVER)


def _pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number = TaskContext.get().partitionId() << 32
    zip_ = zstandard.ZstdCompressor(level=6)
    for batch in batches:
        for part, data, offsets in slices(batch, "text"):
            ids = part.column(0)
            head = np.int64(part.num_rows).tobytes() + ids.is_valid().cast(pa.int8()).to_numpy(zero_copy_only=False).tobytes() + ids.fill_null(np.iinfo(np.int64).min).to_numpy().tobytes() + offsets.astype(np.int64).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([0], pa.int32()), pa.array([zip_.compress(head + data.tobytes())], pa.binary())], names=["page", "kind", "blob"])
            number += 1


class _Digests(dict):
    """Words to their 16 byte digests."""

    def __missing__(self, word: bytes) -> bytes:
        digest = self[word] = hashlib.blake2b(word, digest_size=16).digest()
        return digest


class Page:
    """A staged page: ids (the smallest long for a null), which are not null, and the words."""

    def __init__(self, blob: bytes):
        raw = zstandard.ZstdDecompressor().decompress(blob)
        n = int(np.frombuffer(raw, np.int64, 1)[0])
        self.valid = np.frombuffer(raw, np.int8, n, 8).astype(bool)
        self.ids = np.frombuffer(raw, np.int64, n, 8 + n)
        self.offsets = np.frombuffer(raw, np.int64, n + 1, 8 + 9 * n)
        self.text = raw[8 + 9 * n + 8 * (n + 1) :]
        self.words = Words(np.frombuffer(self.text, np.uint8), self.offsets)

    def doc_of(self, word: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.words.first, word, side="right") - 1

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """First word and hash of each anchor at a cover position of its document."""
        at, h = self.words.windows(ANCHOR)
        keep = _IN_COVER[(at - self.words.first[self.doc_of(at)]) % PERIOD]
        return at[keep], h[keep]

    def fingerprints(self, chosen: np.ndarray, known: _Digests) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First word and 64 and 32 bits of fingerprint of the chosen ones of all windows; only their words are digested."""
        words = self.words
        start = words.windows(WINDOW)[0][chosen]
        change = np.zeros(len(words.hash) + 1, np.int64)
        change[start] += 1
        change[start + WINDOW] -= 1
        covered = np.concatenate([[False], np.cumsum(change)[:-1] > 0, [False]])
        edges = np.flatnonzero(covered[1:] != covered[:-1])
        edges = np.union1d(edges, words.first[:-1][covered[1:][words.first[:-1]]]) if len(edges) else edges  # no run spans documents
        lanes = np.zeros((len(words.hash), 2), np.uint64)
        for i, j in zip(edges[:-1].tolist(), edges[1:].tolist()):
            if not covered[i + 1]:
                continue
            for a in range(i, j, WORDS_AT_ONCE):
                z = min(a + WORDS_AT_ONCE, j)
                some = self.text[words.start[a] : words.end[z - 1]].split()
                lanes[a:z] = np.frombuffer(b"".join(map(known.__getitem__, some)), np.uint64).reshape(-1, 2)
                if len(known) > WORDS_AT_ONCE:
                    known.clear()
        head, tail = (words.windows(WINDOW, np.ascontiguousarray(lanes[:, k]))[1][chosen] for k in (0, 1))
        return start, head, tail.astype(np.uint32)


def _groups(h: np.ndarray, tail: np.ndarray) -> np.ndarray:
    """For sorted fingerprints, the place of the first of each one's equals."""
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (tail[1:] != tail[:-1])
    return np.maximum.accumulate(np.where(first, np.arange(len(h)), 0))


def _by_bucket(h: np.ndarray, buckets: int) -> dict[int, np.ndarray]:
    """Places of the hashes, in their order, for each bucket that has any; the work does not grow with the buckets."""
    b = ((h >> _U(32)) % _U(buckets)).astype(np.int64)
    order = np.argsort(b, kind="stable")
    present, first = np.unique(b[order], return_index=True)
    return dict(zip(present.tolist(), np.split(order, first[1:])))


_DEALT = "bucket int, page long, kind int, blob binary"


def _dealt(rows: list[tuple]) -> pa.RecordBatch:
    b, p, k, x = zip(*rows) if rows else ((), (), (), ())
    return pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(p, pa.int64()), pa.array(k, pa.int32()), pa.array(x, pa.binary())], names=["bucket", "page", "kind", "blob"])


def _deal_anchors(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for number, blob in zip(batch.column(0).to_pylist(), batch.column(2)):
            h = np.unique(Page(blob.as_py()).anchors()[1])
            yield _dealt([(b, number, 0, h[own].astype(np.uint32).tobytes()) for b, own in _by_bucket(h, buckets).items()])


def _bucket_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """Rows sorted by bucket, one bucket at a time."""
    held, at = [], None
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[0] != at and held:
                yield at, held
                held = []
            at = row[0]
            held.append(row[1:])
    if held:
        yield at, held


_REPLY = "page long, kind int, blob binary"


def _replies(rows: list[tuple]) -> pa.RecordBatch:
    p, k, x = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(p, pa.int64()), pa.array(k, pa.int32()), pa.array(x, pa.binary())], names=["page", "kind", "blob"])


def _shared_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per page, the bucket number and a bit for each anchor dealt: another page has it too."""
    for bucket, rows in _bucket_rows(batches):
        parts = [np.frombuffer(x, np.uint32) for _, _, x in rows]
        every = np.sort(np.concatenate(parts))
        twice = np.unique(every[1:][every[1:] == every[:-1]])
        out = []
        for (page, _, _), h in zip(rows, parts):
            at = np.searchsorted(twice, h)
            hit = (at < len(twice)) & (twice[np.minimum(at, max(len(twice) - 1, 0))] == h) if len(twice) else np.zeros(len(h), bool)
            if hit.any():
                out.append((page, 1, np.int64(bucket).tobytes() + np.packbits(hit).tobytes()))
        yield _replies(out)


def _page_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bytes, list[bytes]]]:
    """Rows sorted by page and kind: each page with its replies."""
    number, page, replies = None, b"", []
    for batch in batches:
        for n, kind, blob in zip(*(c.to_pylist() for c in batch.columns)):
            if kind == 0:
                if number is not None:
                    yield number, page, replies
                number, page, replies = n, blob, []
            else:
                replies.append(blob)
    if number is not None:
        yield number, page, replies


def _deal_windows(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    zip_, known = zstandard.ZstdCompressor(level=1), _Digests()
    for number, blob, replies in _page_rows(batches):
        page = Page(blob)
        at, h = page.anchors()
        different, back, count = np.unique(h, return_inverse=True, return_counts=True)
        places = _by_bucket(different, buckets)
        shared = count > 1
        for reply in replies:
            b = int(np.frombuffer(reply, np.int64, 1)[0])
            own = places[b]
            shared[own] |= np.unpackbits(np.frombuffer(reply, np.uint8, offset=8), count=len(own)).astype(bool)
        marks = np.zeros(len(page.words.hash) + 1, np.int64)
        marks[at[shared[back]] + 1] = 1
        marks = np.cumsum(marks)
        start = page.words.windows(WINDOW)[0]
        near = marks[np.minimum(start + PERIOD, len(marks) - 1)] > marks[start]  # an anchor that lies inside the window
        start, wh, wt = page.fingerprints(near, known)
        doc = page.doc_of(start)
        ids, place = page.ids[doc], start - page.words.first[doc]
        order = np.lexsort((place, ids, wt, wh))
        if not len(order):
            continue
        s_id, s_at = ids[order], place[order]
        lead = _groups(wh[order], wt[order])
        tied = (s_id == s_id[lead]) & (s_at == s_at[lead])  # the lead, and rows that repeat its id
        rows = []
        if not tied.all():  # repeats within the page need no bucket
            rows.append((number % buckets, number, 1, np.sort(start[order[~tied]]).astype(np.uint32).tobytes()))
        lead_at = np.sort(order[tied])  # back in the order of the page, where differences are small
        lh = wh[lead_at]
        for b, at_b in _by_bucket(lh, buckets).items():
            own = lead_at[at_b]
            small = np.concatenate([np.diff(x[own], prepend=0) for x in (start, ids, place)])
            rows.append((b, number, 0, np.int64(len(own)).tobytes() + wh[own].tobytes() + wt[own].tobytes() + zip_.compress(small.astype(np.int64).tobytes())))
        yield _dealt(rows)


def _later_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per page, the window starts that are not the earliest of their hash."""
    unzip = zstandard.ZstdDecompressor()
    for _, rows in _bucket_rows(batches):
        out = [(page, 1, blob) for page, kind, blob in rows if kind == 1]
        hs, tails, starts, ids, places, pages = [], [], [], [], [], []
        for page, kind, blob in rows:
            if kind == 0:
                n = int(np.frombuffer(blob, np.int64, 1)[0])
                hs.append(np.frombuffer(blob, np.uint64, n, 8)), tails.append(np.frombuffer(blob, np.uint32, n, 8 + 8 * n))
                small = np.frombuffer(unzip.decompress(blob[8 + 12 * n :]), np.int64).reshape(3, n).cumsum(axis=1)
                starts.append(small[0]), ids.append(small[1]), places.append(small[2]), pages.append(np.full(n, page))
        if hs:
            h, tail, at, id_, place, page = map(np.concatenate, (hs, tails, starts, ids, places, pages))
            order = np.lexsort((place, id_, tail, h))
            at, id_, place, page = at[order], id_[order], place[order], page[order]
            lead = _groups(h[order], tail[order])
            later = np.flatnonzero((id_ > id_[lead]) | ((id_ == id_[lead]) & (place > place[lead])))
            by_page = later[np.argsort(page[later], kind="stable")]
            cuts = np.flatnonzero(np.diff(page[by_page])) + 1
            out += [(int(page[x[0]]), 1, np.sort(at[x]).astype(np.uint32).tobytes()) for x in np.split(by_page, cuts) if len(x)]
        yield _replies(out)


def _kept(batches: Iterator[pa.RecordBatch], with_text: bool) -> Iterator[pa.RecordBatch]:
    for _, blob, replies in _page_rows(batches):
        page = Page(blob)
        n = len(page.words.hash)
        change = np.zeros(n + WINDOW + 1, np.int64)
        for reply in replies:
            s = np.frombuffer(reply, np.uint32).astype(np.int64)
            np.add.at(change, s, 1)
            np.add.at(change, s + WINDOW, -1)
        gone = np.cumsum(change)[:n] > 0
        sums = np.concatenate([[0], np.cumsum(gone)])
        first = page.words.first
        removed = sums[first[1:]] - sums[first[:-1]]
        digests, texts = [], []
        for d in range(len(page.ids)):
            words = page.text[page.offsets[d] : page.offsets[d + 1]].split()
            if removed[d]:
                words = compress(words, (~gone[first[d] : first[d + 1]]).tolist())
            left = b" ".join(words)
            digests.append(hashlib.sha256(left).hexdigest())
            if with_text:
                texts.append(left.decode())
        cols = [pa.array(page.ids, mask=~page.valid), pa.array(np.diff(first).astype(np.int64)), pa.array(removed.astype(np.int64)), pa.array(digests)]
        names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
        yield pa.RecordBatch.from_arrays([*cols, pa.array(texts)] if with_text else cols, names=names + ["kept_text"] * with_text)


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept_sha256 and, if asked for, kept_text.

    Windows are judged on the input. Equal windows are told by 96 bits. A null text has no words;
    rows with a null id count as one document before all others; rows that repeat an id don't remove
    each other's words at equal places, as neither starts earlier. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    pages = cut(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_pages, _REPLY))
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(width, -(-pages.count() // PAGES_PER_BUCKET))

    def bucketed(df: DataFrame) -> DataFrame:
        return df.repartition(buckets, "bucket").sortWithinPartitions("bucket")

    def at_pages(replies: DataFrame) -> DataFrame:
        return pages.unionByName(replies).repartition(buckets, "page").sortWithinPartitions("page", "kind")

    anchors = bucketed(pages.mapInArrow(partial(_deal_anchors, buckets=buckets), _DEALT)).mapInArrow(_shared_anchors, _REPLY)
    windows = at_pages(anchors).mapInArrow(partial(_deal_windows, buckets=buckets), _DEALT)
    later = bucketed(windows).mapInArrow(_later_windows, _REPLY)
    return at_pages(later).mapInArrow(partial(_kept, with_text=with_text), "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text)


SQL = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM documents),
win AS (SELECT doc_id, k, array_to_string(ws[k + 1 : k + 20], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(0, len(ws) - 19)) AS k FROM d)),
later AS (SELECT doc_id, k FROM (SELECT doc_id, k, rank() OVER (PARTITION BY s ORDER BY doc_id, k) AS r FROM win) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(k, k + 20)) AS p FROM later)),
word AS (SELECT doc_id, unnest(ws) AS w, unnest(range(0, len(ws))) AS p FROM d),
kept AS (SELECT doc_id, string_agg(w, ' ' ORDER BY p) AS t, count(*) AS n FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY 1)
SELECT d.doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""
