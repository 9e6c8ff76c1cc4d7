"""Quality rules by weak supervision (DataFrame functions only).

Base counts come from one scan of the whole texts. Each rule then votes good (+1), bad (-1) or
abstains (0). Documents are counted per vote pattern (at most 3 ** rules rows, whatever the input),
and expectation-maximisation over that table estimates how often each rule votes either way on good
and on bad documents. A document's posterior probability of being good replaces the usual demand
that all rules pass.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, words

SYMBOLS = "#*$%&|<>"
WINDOW = 8
ROUNDS = 40
#: A document is kept at this posterior probability of being good.
KEEP_AT = 0.5
#: Before any data: the share of good documents and, per vote, P(vote | good) and P(vote | bad). A bad
#: document mostly breaks one rule and passes the others, so a good vote says little and a bad vote much.
PRIOR_GOOD = 0.8
PRIOR_WEIGHT = 10.0
PRIOR = {1: (0.9, 0.7), 0: (0.08, 0.1), -1: (0.02, 0.2)}


def _pair_up(a: Column, step: int) -> Column:
    """Hash of a[i] and a[i + step] for every i that has both."""
    n = F.greatest(F.size(a) - step, F.lit(0))
    return F.zip_with(F.slice(a, F.lit(1), n), F.slice(a, F.lit(1 + step), n), lambda x, y: F.xxhash64(x, y))


def _covered(positions: Column) -> Column:
    """Words under the windows that start at the sorted positions."""
    n = F.size(positions)
    gaps = F.zip_with(F.slice(positions, F.lit(1), n - 1), F.slice(positions, F.lit(2), n - 1), lambda p, q: F.least(F.lit(WINDOW), q - p))
    return F.when(n > 0, F.aggregate(gaps, F.lit(WINDOW), lambda s, g: s + g)).otherwise(F.lit(0))


def _twice(sorted_pairs: Column) -> Column:
    """Sorted positions of entries whose hash stands beside an equal one."""
    n = F.size(sorted_pairs)
    beside = F.zip_with(
        F.slice(sorted_pairs, F.lit(1), n - 1), F.slice(sorted_pairs, F.lit(2), n - 1),
        lambda x, y: F.when(x["h"] == y["h"], F.array(x["p"], y["p"])),
    )
    return F.array_sort(F.array_distinct(F.flatten(F.filter(beside, lambda x: x.isNotNull()))))


def base_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the counts that the rules read.

    Equal windows are found by 64-bit hashes within one document. A null text has no words.
    """
    df = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    df = df.withColumn("w", words(F.col("text"))).withColumn("lines", F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    df = df.select(
        "doc_id",
        F.size("w").alias("n_words"),
        F.length(F.array_join("w", "")).alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).alias("n_symbols"),
        F.size("lines").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        (F.length("text") - F.length(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))).alias("n_upper"),
        (F.length("text") - F.length(F.translate("text", "!", ""))).alias("n_shouts"),
        (F.length("text") - F.length(F.translate("text", ".", ""))).alias("n_stops"),
        F.length(F.regexp_replace("text", r"[\p{L}\p{N}\p{M}\s]+", "")).alias("n_marks"),
        F.size(F.filter("w", lambda x: x.rlike(r"^\p{L}+[.,;:?]?$"))).alias("n_plain"),
        F.size(F.array_distinct("w")).alias("n_distinct"),
        F.transform("w", lambda x: F.xxhash64(x)).alias("h"),
    )
    df = df.withColumn("h", _pair_up(F.col("h"), 1)).withColumn("h", _pair_up(F.col("h"), 2)).withColumn("h", _pair_up(F.col("h"), 4))
    pairs = F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
    df = df.withColumn("pairs", F.when(F.size(F.array_distinct("h")) < F.size("h"), pairs)).drop("h")
    df = df.withColumn("at", F.when(F.col("pairs").isNotNull(), _twice(F.col("pairs")))).drop("pairs")
    df = df.withColumn("n_repeat_words", F.when(F.col("at").isNotNull(), _covered(F.col("at"))).otherwise(F.lit(0))).drop("at")
    return df.select("doc_id", *[F.col(c).cast("long").alias(c) for c in df.columns if c != "doc_id"])


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, F.lit(-1)).when(good, F.lit(1)).otherwise(F.lit(0))


def rules() -> dict[str, Column]:
    """The votes, by name, over the columns of base_counts()."""
    c, n = F.col, F.greatest(F.col("n_words"), F.lit(1))
    return {
        "symbols": _vote(c("n_symbols") * 50 <= n, c("n_symbols") * 4 > n),
        "marks": _vote(c("n_marks") * 16 <= c("word_chars"), c("n_marks") * 10 > c("word_chars")),
        "plain_words": _vote(c("n_plain") * 10 >= 9 * n, c("n_plain") * 10 < 6 * n),
        "capitals": _vote(c("n_upper") * 10 <= c("word_chars"), c("n_upper") * 10 > 3 * c("word_chars")),
        "shouts": _vote(c("n_shouts") * 100 <= n, c("n_shouts") * 10 > n),
        "repeats": _vote(c("n_repeat_words") * 20 <= n, c("n_repeat_words") * 5 > n),
        "lines": _vote(c("n_dup_lines") * 10 <= c("n_lines"), c("n_dup_lines") * 10 > 3 * c("n_lines")),
        "variety": _vote(c("n_distinct") * 4 >= n, c("n_distinct") * 10 < n),
        "sentences": _vote(c("n_stops") * 40 >= n, (c("n_stops") * 100 < n) & (c("n_words") >= 100)),
        "word_length": _vote((c("word_chars") >= 3 * n) & (c("word_chars") <= 9 * n), (c("word_chars") < 2 * n) | (c("word_chars") > 15 * n)),
    }


def fit(patterns: list[tuple[tuple[int, ...], int]], n_rules: int, rounds: int = ROUNDS) -> tuple[float, list[dict[int, tuple[float, float]]]]:
    """EM over vote patterns: the share of good documents and, per rule and vote, P(vote | good), P(vote | bad).

    Estimates are smoothed by the prior as if by PRIOR_WEIGHT more documents of either class, so a
    rule that never votes keeps its prior.
    """
    total, weight, prior = sum(n for _, n in patterns), PRIOR_WEIGHT, PRIOR
    good, table = PRIOR_GOOD, [dict(prior) for _ in range(n_rules)]
    for _ in range(rounds):
        sums, g_all = [{v: [0.0, 0.0] for v in prior} for _ in range(n_rules)], 0.0
        for votes, n in patterns:
            z = math.log(good / (1 - good)) + sum(math.log(t[v][0] / t[v][1]) for t, v in zip(table, votes))
            p = 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))
            g_all += n * p
            for s, v in zip(sums, votes):
                s[v][0] += n * p
                s[v][1] += n * (1 - p)
        good = (g_all + weight * PRIOR_GOOD) / (total + weight)
        g_n, b_n = g_all + weight, total - g_all + weight
        table = [{v: ((s[v][0] + weight * prior[v][0]) / g_n, (s[v][1] + weight * prior[v][1]) / b_n) for v in prior} for s in sums]
    return good, table


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_at: float = KEEP_AT) -> DataFrame:
    """One row per input row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, posterior.

    base_failed: under 20 words, or over 30 % of them in repeated windows of 8; such a row is not
    kept whatever its posterior. Null and empty texts fail. An empty table gives an empty result.
    """
    votes = rules()
    df = cut(base_counts(docs, id_col, text_col)).withColumns({f"v_{k}": v for k, v in votes.items()})
    names = [f"v_{k}" for k in votes]
    seen = df.groupBy(*names).agg(F.count(F.lit(1)).alias("n")).collect()  # at most 3 ** rules rows
    good, table = fit(sorted((tuple(r[x] for x in names), r["n"]) for r in seen), len(names))
    z = F.lit(math.log(good / (1 - good)))
    for name, t in zip(names, table):
        z = z + F.when(F.col(name) == 1, math.log(t[1][0] / t[1][1])).when(F.col(name) == -1, math.log(t[-1][0] / t[-1][1])).otherwise(math.log(t[0][0] / t[0][1]))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return (
        df.withColumn("base_failed", failed).withColumn("posterior", 1 / (1 + F.exp(-z)))
        .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.col("posterior") >= keep_at)).alias("kept"), F.round("posterior", 6).alias("posterior"), *names)
    )
