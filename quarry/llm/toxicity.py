"""Toxicity by Levenshtein automata over a lexicon trie, with context windows.

The lexicon (whole words, and stems that start a word) is learned from labelled documents: a term
must stand in many different contexts of toxic documents and hardly in clean ones. Counting
contexts, not documents, keeps the words of a much-copied document out of it. Words near a term that
two clean documents use are words of their own, not misspellings, and are spared; a term near which
clean documents have many words is matched as it is written, as its misspellings would say little.

At scoring, a trie of the lexicon is intersected with Levenshtein automata: the states of the
product are sets of (trie node, edits so far), made deterministic step by step and remembered, so a
word costs one table look-up per character. Each hit is weighed by its context: between an opening
and a closing quotation mark at most SPAN words apart it counts as quotation, else as abuse. A
logistic layer over the capped counts gives the score. Its weights may not go against their meaning
(a misspelled term can't lower a score, a quoted one can't raise it), and it is also fitted on copies
of the toxic documents with their terms misspelled (toxic) and in quotation marks (not toxic).
"""

from __future__ import annotations

import random
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import give_back
from .sampling import fold, labelled_sample

#: Labelled documents of either class that the fit reads.
SAMPLE = 2000
#: Contexts a term needs, its least share of all toxic documents, and how much rarer it must be in clean ones.
MIN_CONTEXTS, MIN_SHARE, RARER = 6, 0.02, 100.0
STEM_LENGTHS = range(3, 9)
#: Clean documents that must use a word near a term before it is spared.
SPARED_IN = 2
#: Share of clean documents with a word near a term from which on the term may not be misspelled.
NOISY = 0.003
#: Words between an opening and its closing quotation mark at most; an opening one without is no quotation.
SPAN = 40
THRESHOLD = 0.7
FOLDS, HELD_FOLD = 3, 1
#: Words whose match a worker remembers, and (node, edits) pairs that its automaton holds; beyond it the memory starts anew.
WORD_MEMORY, PAIR_MEMORY = 100_000, 100_000
EDGE = ".,;:!?\"'()[]{}<>#*$%&|-_=+~`/\\…“”„‘’‚«»‹›¡¿"
QUOTES = "\"“”„«»‹›"
FEATURES = ("any_abuse", "abuse", "any_fuzzy", "fuzzy", "density", "quoted")
#: The sign that a feature's weight may have.
SIGNS = (1, 1, 1, 1, 1, -1)
#: Weight of a misspelled or quoted copy in the fit; a document weighs 1.
COPY_WEIGHT = 0.5


def edits_allowed(term: str, stem: bool) -> int:
    """Longer words may be misspelled more; a stem must be long before it may be misspelled at all."""
    if stem:
        return 1 if len(term) >= 7 else 0
    return 0 if len(term) < 4 else 1 if len(term) < 8 else 2


class Matcher:
    """Edits between a word and the nearest lexicon term that accepts it, by a lazily made product automaton."""

    def __init__(self, lexicon: list[tuple], spared: frozenset = frozenset()):
        """lexicon: (term, whether it is a stem) and, if not edits_allowed(), the edits that the term allows."""
        self.spared = spared
        self.children: list[dict[str, int]] = [{}]
        self.word_edits, self.stem_edits = [-1], [-1]  # edits that a term ending at the node allows
        for term, stem, *edits in lexicon:
            at = 0
            for ch in term:
                if ch not in self.children[at]:
                    self.children[at][ch] = len(self.children)
                    self.children.append({})
                    self.word_edits.append(-1)
                    self.stem_edits.append(-1)
                at = self.children[at][ch]
            own = self.stem_edits if stem else self.word_edits
            own[at] = max(own[at], edits[0] if edits else edits_allowed(term, stem))
        self.most = [max(a, b) for a, b in zip(self.word_edits, self.stem_edits)]  # over all terms at or below the node
        for node in range(len(self.children) - 1, -1, -1):
            self.most[node] = max([self.most[node], *(self.most[c] for c in self.children[node].values())])
        self.known: dict[str, int] = {}
        self._forget()

    def _forget(self) -> None:
        """The automaton with its start state alone."""
        self.pairs = 0
        self.states: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.step: list[dict[str, int]] = []
        self.by_end: list[int] = []  # least edits if the word ends here, or 9
        self.by_stem: list[int] = []  # least edits of a stem read in full, or 9
        self.start = self._state({(0, 0)})

    def _state(self, pairs: set[tuple[int, int]]) -> int:
        least: dict[int, int] = {}
        todo = sorted(pairs, key=lambda p: p[1])
        while todo:
            node, e = todo.pop()
            if e > self.most[node] or least.get(node, 9) <= e:
                continue
            least[node] = e
            todo += [(c, e + 1) for c in self.children[node].values()]  # a character of the term left out
        key = frozenset(least.items())
        if key not in self.states:
            self.states[key] = len(self.sets)
            self.pairs += len(key) + 1
            self.sets.append(key)
            self.step.append({})
            self.by_end.append(min((e for n, e in key if e <= self.word_edits[n]), default=9))
            self.by_stem.append(min((e for n, e in key if e <= self.stem_edits[n]), default=9))
        return self.states[key]

    def _next(self, state: int, ch: str) -> int:
        after = set()
        for node, e in self.sets[state]:
            after.add((node, e + 1))  # ch is one too many
            for c, child in self.children[node].items():
                after.add((child, e if c == ch else e + 1))
        to = self._state(after)
        if len(self.step[state]) < 512:
            self.step[state][ch] = to
        return to

    def match(self, word: str) -> int:
        """Least edits by which the word or its beginning meets a term; 9 if none does."""
        if self.pairs > PAIR_MEMORY:
            self._forget()
        state, best = self.start, 9
        for ch in word:
            to = self.step[state].get(ch)
            state = self._next(state, ch) if to is None else to
            best = min(best, self.by_stem[state])
            if not self.sets[state]:
                return best
        return min(best, self.by_end[state])

    def look(self, token: str) -> int:
        """match() of a raw token without its outer punctuation, remembered."""
        found = self.known.get(token)
        if found is None:
            if len(self.known) > WORD_MEMORY:
                self.known.clear()
            word = token.strip(EDGE)
            found = self.known[token] = 9 if word in self.spared else self.match(word)
        return found


def quoted_words(tokens: list[str]) -> set[int]:
    """Places of the words between a mark that opens a word and the next one that closes a word, SPAN words apart at most."""
    out, opened = set(), None
    for i, t in enumerate(tokens):
        if not any(q in t for q in QUOTES):
            continue
        core = t.strip(EDGE)
        at = t.find(core) if core else len(t)
        lead, trail = t[:at], t[at + len(core) :] if core else ""
        if any(q in lead for q in QUOTES):
            if not core and opened is not None:  # a mark alone closes what is open
                trail = lead
            else:
                opened = i
        if opened is not None and any(q in trail for q in QUOTES):
            if i - opened <= SPAN:
                out.update(range(opened, i + 1))
            opened = None
    return out


def words_of(text: str | None) -> list[str]:
    return (text or "").lower().split()


def find(tokens: list[str], matcher: Matcher) -> dict[str, int]:
    """Edits of the words that meet the lexicon."""
    look = matcher.look
    return {w: e for w in set(tokens) if (e := look(w)) < 9}


def features(tokens: list[str], hits: dict[str, int]) -> list[float]:
    if not hits:
        return [0.0] * len(FEATURES)
    abuse = fuzzy = quoted = 0
    spoken = quoted_words(tokens)
    for i, t in enumerate(tokens):
        if t in hits:
            if i in spoken:
                quoted += 1
            elif hits[t] == 0:
                abuse += 1
            else:
                fuzzy += 1
    return [float(abuse > 0), min(abuse, 4) / 4, float(fuzzy > 0), min(fuzzy, 4) / 4, min(1.0, 20 * (abuse + fuzzy) / len(tokens)), min(quoted, 4) / 4]


def misspelled(token: str, rng: random.Random) -> str:
    """One letter of the word changed, doubled, left out or put in."""
    core = token.strip(EDGE)
    if len(core) < 4:
        return token
    k, c = rng.randrange(1, len(core)), rng.choice("abcdefghijklmnopqrstuvwxyz")
    wrong = rng.choice([core[:k] + c + core[k + 1 :], core[:k] + core[k - 1] + core[k:], core[:k] + core[k + 1 :], core[:k] + c + core[k:]])
    return token.replace(core, wrong)


def training_rows(label: int, text: str | None, matcher: Matcher) -> list[tuple]:
    """label, weight and features of a document and, if it is toxic and has terms, of its misspelled and quoted copies."""
    tokens = words_of(text)
    hits = find(tokens, matcher)
    rows = [(label, 1.0, *features(tokens, hits))]
    if label == 1 and hits:
        rng = random.Random(len(tokens))
        wrong = [misspelled(t, rng) if t in hits else t for t in tokens]
        rows.append((1, COPY_WEIGHT, *features(wrong, {w: e or 1 for w, e in find(wrong, matcher).items()})))
        marked = [f'"{t.strip(EDGE)}"' if t in hits else t for t in tokens]
        rows.append((0, COPY_WEIGHT, *features(marked, find(marked, matcher))))
    return rows


def _terms(token: str) -> list[tuple[str, bool]]:
    w = token.strip(EDGE)
    if len(w) < 3 or not w[0].isalpha():
        return []
    return [(w, False), *((w[:k], True) for k in STEM_LENGTHS if len(w) > k)]


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of either label per term, summed over a partition of the sample."""
    counts: list[Counter] = [Counter(), Counter()]
    for batch in batches:
        for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            counts[label].update({t for w in set((text or "").lower().split()) for t in _terms(w)})
    keys = sorted(counts[1])  # a term of no toxic document is of no use
    for k in range(0, len(keys), 20_000):
        part = keys[k : k + 20_000]
        yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in part]), pa.array([s for _, s in part]), pa.array([counts[1][t] for t in part], pa.int64()), pa.array([counts[0][t] for t in part], pa.int64())], names=["term", "stem", "toxic", "clean"])


def _context_counts(batches: Iterator[pa.RecordBatch], wanted: frozenset) -> Iterator[pa.RecordBatch]:
    """Distinct (word before, word after) of each wanted term, by label."""
    seen: set = set()
    for batch in batches:
        for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            tokens = ["", *(text or "").lower().split(), ""]
            of = {w: [t for t in _terms(w) if t in wanted] for w in set(tokens)}
            for a, w, b in zip(tokens, tokens[1:], tokens[2:]):
                for t in of[w]:
                    seen.add((*t, label, f"{a} {b}"))
    rows = sorted(seen)
    for k in range(0, len(rows), 20_000):
        cols = list(zip(*rows[k : k + 20_000]))
        yield pa.RecordBatch.from_arrays([pa.array(cols[0]), pa.array(cols[1]), pa.array(cols[2], pa.int32()), pa.array(cols[3])], names=["term", "stem", "label", "context"])


def _near_words(batches: Iterator[pa.RecordBatch], lexicon: list[tuple[str, bool]]) -> Iterator[pa.RecordBatch]:
    """Documents of either label per word that the lexicon accepts and that is no term, and per term with such a misspelling."""
    matcher, terms = Matcher(lexicon), {t for t, stem in lexicon if not stem}
    alone = {t: Matcher([t]) for t in lexicon if edits_allowed(*t)}
    near: dict[str, list] = {}
    counts: list[Counter] = [Counter(), Counter()]
    for batch in batches:
        for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            found = {w.strip(EDGE) for w in set(words_of(text)) if matcher.look(w) < 9} - terms
            for w in found - near.keys():
                near[w] = [t for t, m in alone.items() if 0 < m.match(w) < 9]
            counts[label].update({("", False, w) for w in found} | {(*t, "") for w in found for t in near[w]})
    keys = sorted(set(counts[0]) | set(counts[1]))
    cols = list(zip(*keys)) if keys else [(), (), ()]
    yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.bool_()), pa.array(cols[2], pa.string()), *(pa.array([counts[k][w] for w in keys], pa.int64()) for k in (1, 0))], names=["term", "stem", "word", "toxic", "clean"])


def learn_lexicon(sample: DataFrame, n_toxic: int, n_clean: int) -> tuple[list[tuple[str, bool, int]], frozenset]:
    """The terms with the edits they allow, and words that the lexicon would accept though clean documents use them.

    sample has label and text and is bounded, so everything here is; no term is dropped for its number.
    """
    least = max(MIN_CONTEXTS, int(MIN_SHARE * n_toxic))
    counted = sample.mapInArrow(_document_counts, "term string, stem boolean, toxic long, clean long").groupBy("term", "stem").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    in_toxic, in_clean = F.col("toxic") / max(1, n_toxic), F.col("clean") / max(1, n_clean)
    top = counted.where((F.col("toxic") >= F.greatest(F.lit(2), F.lit(least / 4))) & (in_toxic >= 4 * in_clean))
    wanted = frozenset((r["term"], r["stem"]) for r in top.collect())
    if not wanted:
        return [], frozenset()
    found = (
        sample.mapInArrow(lambda it: _context_counts(it, wanted), "term string, stem boolean, label int, context string")
        .groupBy("term", "stem").agg(F.countDistinct(F.when(F.col("label") == 1, F.col("context"))).alias("toxic"), F.countDistinct(F.when(F.col("label") == 0, F.col("context"))).alias("clean"))
        .where((F.col("toxic") >= least) & (in_toxic >= RARER * in_clean)).collect()
    )
    lexicon = choose_terms({(r["term"], r["stem"]): (r["toxic"], r["clean"]) for r in found})
    if not lexicon:
        return [], frozenset()
    near = sample.mapInArrow(lambda it: _near_words(it, lexicon), "term string, stem boolean, word string, toxic long, clean long").groupBy("term", "stem", "word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    words, of_term = F.col("term") == "", F.col("term") != ""
    told = near.where((words & (F.col("clean") >= SPARED_IN) & (in_toxic < 20 * in_clean)) | (of_term & (in_clean >= NOISY) & (in_toxic < 20 * in_clean))).collect()
    noisy = {(r["term"], r["stem"]) for r in told if r["term"]}
    return [(t, stem, 0 if (t, stem) in noisy else edits_allowed(t, stem)) for t, stem in lexicon], frozenset(r["word"] for r in told if not r["term"])


def choose_terms(ok: dict[tuple[str, bool], tuple[int, int]]) -> list[tuple[str, bool]]:
    """The shortest stems stand for their longer forms; a longer one that loses no tenth of the toxic contexts and is as clean replaces its stem."""
    kept: list[tuple[str, bool]] = []
    for term, stem in sorted(ok, key=lambda t: (len(t[0]), not t[1], t[0])):
        if any(s and term.startswith(x) for x, s in kept):
            continue
        toxic, clean = ok[(term, stem)]
        if not (stem and any((x, s) != (term, stem) and x.startswith(term) and n >= 0.9 * toxic and c <= clean for (x, s), (n, c) in ok.items())):
            kept.append((term, stem))
    return kept


def fit_layer(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, signs: tuple[int, ...] | None = None, ridge: float = 0.5) -> np.ndarray:
    """Weights and bias (last) of a logistic layer, by Newton's method; a weight of the wrong sign is held at zero."""
    c = np.ones(len(x)) if weight is None else weight
    free = list(range(x.shape[1]))
    while True:
        a = np.column_stack([x[:, free], np.ones(len(x))])
        w, pen = np.zeros(a.shape[1]), np.append(np.full(len(free), ridge), 1e-3)
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
            step = np.linalg.solve((a * (c * p * (1 - p))[:, None]).T @ a + np.diag(pen), a.T @ (c * (p - y)) + pen * w)
            w -= step
            if np.abs(step).max() < 1e-6:
                break
        wrong = [k for k, j in enumerate(free) if signs and w[k] * signs[j] < 0]
        if not wrong:
            break
        worst = max(wrong, key=lambda k: abs(w[k]))
        free.pop(worst)
    out = np.zeros(x.shape[1] + 1)
    out[free], out[-1] = w[:-1], w[-1]
    return out


class Model:
    def __init__(self, lexicon: list[tuple[str, bool, int]], spared: frozenset, weights: list[float]):
        self.lexicon, self.spared, self.weights = lexicon, spared, weights

    def scorer(self, docs: DataFrame, text: Column) -> Column:
        """A score column for any DataFrame; the text column is the only input."""
        lexicon, spared, weights = self.lexicon, self.spared, np.array(self.weights)

        @F.pandas_udf("double")
        def score(texts):
            import pandas as pd

            matcher = _matcher(lexicon, spared)
            out = []
            for t in texts:  # one text's words at a time
                words = words_of(t)
                out.append(features(words, find(words, matcher)))
            give_back()
            x = np.column_stack([np.array(out).reshape(len(out), len(FEATURES)), np.ones(len(out))])
            return pd.Series(1 / (1 + np.exp(-np.clip(x @ weights, -40, 40))))

        return score(text)


_matchers: dict = {}


def _matcher(lexicon: list[tuple[str, bool, int]], spared: frozenset) -> Matcher:
    key = (tuple(lexicon), spared)
    if key not in _matchers:
        _matchers.clear()
        _matchers[key] = Matcher(lexicon, spared)
    return _matchers[key]


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = SAMPLE) -> Model:
    """Lexicon and layer from at most per_class labelled documents of either class outside the held-out fold."""
    sample, counts = labelled_sample(docs, labels, label_col, FOLDS, HELD_FOLD, per_class, id_col, text_col)
    shown = {k: min(per_class, counts.get(k, 0)) for k in (0, 1)}
    lexicon, spared = learn_lexicon(sample, shown[1], shown[0]) if shown[1] else ([], frozenset())
    names = ["label", "weight", *FEATURES]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = _matcher(lexicon, spared)
        for batch in batches:
            rows = [r for label, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for r in training_rows(label, t, matcher)]
            cols = list(zip(*rows)) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *(pa.array(c, pa.float64()) for c in cols[1:])], names=names)

    rows = sample.mapInArrow(measure, "label int, " + ", ".join(f"{f} double" for f in names[1:])).collect() if lexicon else []  # bounded: 4 * per_class
    if not rows:
        return Model([], frozenset(), [0.0] * len(FEATURES) + [-4.0])
    rows = np.array(sorted(tuple(r) for r in rows))
    return Model(lexicon, spared, fit_layer(rows[:, 2:], rows[:, 0], rows[:, 1], SIGNS).tolist())


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = SAMPLE) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted.

    Scores read the text alone, whole whatever its length. Null and empty texts have no hits and score as
    a clean text; repeated rows get equal scores. Without labelled toxic rows no term is known and nothing
    is toxic. Other columns, whatever their names, are not read.
    """
    model = fit(docs, labels, id_col, text_col, label_col, per_class)
    return docs.select(
        F.col(id_col).alias("doc_id"), (fold(F.col(id_col), FOLDS) == HELD_FOLD).alias("held_out"), model.scorer(docs, F.col(text_col)).alias("score")
    ).withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without those scored toxic; all columns stay as they are."""
    model = fit(docs, labels, id_col, text_col)
    return docs.where(model.scorer(docs, F.col(text_col)) < THRESHOLD)
