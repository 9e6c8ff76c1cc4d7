"""Codes within a restricted edit distance of tokens: a walk down the prefix tree of sorted codes, in numpy.

A pair of a token and a prefix holds the last two rows of the distance table, in a band around the diagonal. Pairs of which no cell
can stay within the radius end there, so a token meets the prefixes near it, not all codes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Pairs of a token and a prefix that are walked at once, by about that many.
PAIRS = 1 << 17
_FAR = np.int16(1 << 12)


def characters(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points (rows filled up with 0) and lengths."""
    n = np.fromiter(map(len, strings), np.int64, len(strings))
    width = max(int(n.max()) if len(n) else 0, 1)
    flat = np.frombuffer("".join(s.ljust(width, "\0") for s in strings).encode("utf-32-le", "surrogatepass"), np.uint32)
    return flat.reshape(len(strings), width), n


class Tree:
    """Prefix tree of sorted, different strings, by level: the range of strings of each prefix."""

    def __init__(self, strings: list[str]):
        self.chars, self.n = characters(strings)
        count, width = self.chars.shape
        self.letters, codes = np.unique(self.chars, return_inverse=True)
        codes = codes.reshape(self.chars.shape) + 1
        self.kind = np.uint8 if len(self.letters) < 255 else np.uint32
        #: Of depth d: first string of each prefix of d characters, its last character, first child in depth d + 1, shortest and longest string.
        self.levels = []
        new = np.zeros(count, bool)
        new[:1] = True
        first = np.flatnonzero(new)
        for d in range(width + 1):
            alive = np.flatnonzero(self.n >= d)
            cut = np.searchsorted(alive, first)
            sizes = self.n[alive].astype(np.int16)
            ends = [f.reduceat(sizes, cut) if len(first) else sizes[:0] for f in (np.minimum, np.maximum)]
            self.levels.append([first, codes[first, d - 1].astype(self.kind) if d else None, None, *ends])
            if d < width:
                new = new.copy()
                new[1:] |= self.chars[1:, d] != self.chars[:-1, d]
                start = np.flatnonzero(new & (self.n > d))
                parent = np.searchsorted(first, start, "right") - 1
                self.levels[d][2] = np.searchsorted(parent, np.arange(len(first) + 1))
                first = start

    def walk(self, tokens: np.ndarray, sizes: np.ndarray, which: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(token, string, distance) of all pairs within the radius, for the given tokens."""
        if not len(self.n) or not len(which):
            return
        band = 2 * radius + 1  # cell j of row d stands for the token's first d - radius + j characters
        width = tokens.shape[1]
        padded = np.zeros((len(tokens), width + len(self.levels) + 2 * band), self.kind)  # 0: no character of the tree
        at = np.minimum(np.searchsorted(self.letters, tokens), len(self.letters) - 1)
        padded[:, band : band + width] = np.where((np.arange(width) < sizes[:, None]) & (self.letters[at] == tokens), at + 1, 0)
        padded = np.ascontiguousarray(padded.T)
        top = np.abs(np.arange(band) - radius).astype(np.int16)
        top[:radius] = _FAR
        zero = np.zeros(len(which), np.int64)
        todo = [(0, which, zero, np.repeat(top[:, None], len(which), 1), np.full((band, len(which)), _FAR, np.int16), zero.astype(self.kind))]
        while todo:
            d, t, node, row, above, last = todo.pop()
            if len(t) > PAIRS:
                half = len(t) // 2
                todo += [(d, *(x[..., part] for x in (t, node, row, above, last))) for part in (slice(half, None), slice(half))]
                continue
            first, _, child = self.levels[d][:3]
            at = sizes[t] - d + radius  # the cell of the whole token
            ends = (self.n[first[node]] == d) & (at >= 0) & (at < band)
            if ends.any():
                dist = row[at[ends], np.flatnonzero(ends)]
                hit = dist <= radius
                yield t[ends][hit], first[node[ends]][hit], dist[hit]
            if child is None:
                continue
            many = child[node + 1] - child[node]
            of = np.repeat(np.arange(len(t)), many)
            if not len(of):
                continue
            below = np.repeat(child[node] - np.cumsum(many) + many, many) + np.arange(len(of))
            _, letter, _, low, high = self.levels[d + 1]
            c, tt, size = letter[below], t[of], sizes[t[of]].astype(np.int16)
            # edits that the lengths alone still ask for, at cell j: max(0, more + j, less - j)
            more, less = low[below] - size - np.int16(radius), size - high[below] + np.int16(radius)
            new, least = np.empty((band, len(of)), np.int16), np.full(len(of), _FAR, np.int16)
            for j in range(band):
                place = d + 1 - radius + j  # characters of the token, its last one is the one compared
                if place < 0:
                    new[j] = _FAR
                    continue
                if place == 0:
                    new[j] = d + 1
                else:
                    around = padded[band + place - 1][tt]
                    cost = row[j][of] + (around != c)
                    if j + 1 < band:
                        np.minimum(cost, row[j + 1][of] + 1, out=cost)
                    if d and place > 1:
                        swap = (padded[band + place - 2][tt] == c) & (around == last[of]) & (around > 0)
                        np.copyto(cost, np.minimum(cost, above[j][of] + 1), where=swap)
                    new[j] = np.where(size < place, _FAR, cost)
                np.minimum(least, new[j] + np.maximum(np.maximum(more + np.int16(j), less - np.int16(j)), 0), out=least)
            near = np.flatnonzero(least <= radius)
            new, of = new[:, near], of[near]
            for j in range(1, band):
                np.minimum(new[j], new[j - 1] + 1, out=new[j])
            todo.append((d + 1, tt[near], below[near], new, row[:, of], c[near]))


def radii(sizes: np.ndarray, longest: int, cutoff: float) -> np.ndarray:
    """Most edits of a string at or above the cutoff: it has no more than size / cutoff characters."""
    most = np.maximum(sizes, np.minimum(longest, np.floor(sizes / cutoff + 1e-9)))
    return np.floor((1 - cutoff) * most + 1e-9).astype(np.int64)


def best_beyond(sizes: np.ndarray, longest: int, radius: int) -> np.ndarray:
    """The similarity that no string of more edits than radius exceeds."""
    return 1 - (radius + 1) / np.maximum(np.minimum(sizes + radius + 1, longest), sizes).clip(1)


def nearest(tree: Tree, tokens: list[str], cutoff: float, top: int, last: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(token, string, distance): for each token the top strings by similarity, then by string, at or above the cutoff.

    The radius grows until a token has enough strings that no farther one can beat, or to last edits.
    """
    chars, sizes = characters(tokens)
    longest = int(tree.n.max(initial=0))
    limit = radii(sizes, longest, cutoff)
    if last is not None:
        limit = np.minimum(limit, last)
    left, radius = np.arange(len(tokens)), min(1, int(limit.max(initial=0)))
    while len(left):
        found = [x for r in np.unique(np.minimum(radius, limit[left])) for x in tree.walk(chars, sizes, left[np.minimum(radius, limit[left]) == r], int(r))]
        t, s, dist = (np.concatenate([np.zeros(0, np.int64), *(x[i] for x in found)]).astype(np.int64) for i in range(3))
        like = np.round(1 - dist / np.maximum(sizes[t], tree.n[s]).clip(1), 9)
        ok = like >= cutoff - 1e-9
        order = np.lexsort((s[ok], -like[ok], t[ok]))
        t, s, dist, like = (x[ok][order] for x in (t, s, dist, like))
        count = np.bincount(t, minlength=len(tokens))
        nth = np.arange(len(t)) - (np.cumsum(count) - count)[t]
        bar = np.full(len(tokens), -1.0)
        bar[t[nth == top - 1]] = like[nth == top - 1]
        done = (limit[left] <= radius) | (bar[left] > best_beyond(sizes[left], longest, radius) + 1e-8)
        finished = np.zeros(len(tokens), bool)
        finished[left[done]] = True
        give = finished[t] & (nth < top)
        yield t[give], s[give], dist[give]
        left, radius = left[~done], radius + 1
