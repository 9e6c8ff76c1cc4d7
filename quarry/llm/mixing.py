"""Mixing sources to target weights by iterative proportional fitting (DataFrame functions only).

Token counts are summed per cell (source, language, topic). Raking scales the cell weights to the
source, language and topic marginals in turn until every marginal is met to TOLERANCE, or a block of
rounds brings them no nearer (targets that contradict each other). Few cells are held in one
partition, where chained window sums need no shuffle; many are raked by partial sums per category,
joined back. Each document is then kept with its cell's calibrated probability, decided by a hash of
its id: no random state, the same answer after a lost executor.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, unit_hash, words

DIMENSIONS = ("source", "lang", "topic")
#: Target share of a category: its token share to this power, normalised. 1 keeps the mixture, 0 makes it even.
TEMPER = {"source": 0.7, "lang": 0.8, "topic": 0.9}
#: Rounds between two looks at the marginals, and how near they must come (shares of all tokens).
BLOCK, TOLERANCE = 12, 1e-12
SEED = 29
#: A category of a tempered dimension that holds less than this part of the mean share there is rare: it doesn't set the scale.
RARE = 0.1


def topic_of(text: Column, n_words: Column) -> Column:
    """For tables without a topic column: a coarse class from the form of the whole text."""
    t = F.coalesce(text, F.lit(""))
    bars = F.length(t) - F.length(F.replace(t, F.lit("|"), F.lit("")))
    return (
        F.when(bars * 10 > n_words, F.lit("table"))
        .when(n_words >= 1000, F.lit("long"))
        .when(n_words >= 200, F.lit("article"))
        .otherwise(F.lit("brief"))
    )


#: Up to so many cells (categories, not rows) are raked in one partition and broadcast; beyond it rounds and joins shuffle.
FEW_CELLS = 10_000


def _marginals(cells: DataFrame, temper: dict[str, float], targets: dict[str, dict[str, float]]) -> DataFrame:
    """cells with goal_d (the target share of its category) and common_d (the category isn't rare) for each dimension d."""
    total = cells.agg(F.sum("tokens")).first()[0] or 0.0
    per = {d: cells.groupBy(d).agg((F.sum("tokens") / F.lit(total or 1.0)).alias("share")) for d in DIMENSIONS}
    for d in DIMENSIONS:
        stated = targets.get(d)
        if stated is None:
            per[d] = per[d].withColumn("goal", F.pow("share", F.lit(float(temper[d])))).withColumn("named", F.lit(False))
        else:
            goal, named = F.lit(None).cast("double"), F.col(d).isin(list(stated))
            for name, weight in stated.items():
                goal = F.when(F.col(d) == name, F.lit(float(weight))).otherwise(goal)
            per[d] = per[d].withColumn("named", named).withColumn("goal", F.when(named, goal).otherwise(F.col("share")))
    sums = None  # three rows
    for d in DIMENSIONS:
        one = per[d].agg(F.lit(d).alias("d"), F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("named"), F.col("goal"))).alias("named"), F.sum(F.when(~F.col("named"), F.col("goal"))).alias("rest"))
        sums = one if sums is None else sums.unionByName(one)
    for r in sums.collect():
        d, named, rest = r["d"], r["named"] or 0.0, r["rest"] or 0.0
        left = max(0.0, 1.0 - named) if named and rest else 1.0  # what the stated weights leave is for the categories without one
        whole = named + (left if rest else 0.0) if named else 1.0
        goal = F.when(F.col("named"), F.col("goal") / F.lit(whole or 1.0)).otherwise(F.col("goal") * F.lit(left / (rest or 1.0) / (whole or 1.0)))
        common = F.lit(True) if d in targets else F.col("share") * F.lit(r["n"]) >= RARE
        cells = cells.join(per[d].select(d, goal.alias(f"goal_{d}"), common.alias(f"common_{d}")), d)
    return cells


def _scaled(d: str, now: Column) -> Column:
    return F.when(now > 0, F.col("weight") * F.col(f"goal_{d}") / now).otherwise(F.lit(0.0))


def _raked(cells: DataFrame, few: bool) -> DataFrame:
    """One block of rounds."""
    for _ in range(BLOCK):
        for d in DIMENSIONS:
            if few:
                cells = cells.withColumn("weight", _scaled(d, F.sum("weight").over(Window.partitionBy(d))))
            else:
                sums = cells.groupBy(d).agg(F.sum("weight").alias("now"))
                cells = cut(cells.join(sums, d).withColumn("weight", _scaled(d, F.col("now"))).drop("now"))
    return cut(cells)


def rake(cells: DataFrame, temper: dict[str, float] | None = None, targets: dict[str, dict[str, float]] | None = None, few_cells: int = FEW_CELLS) -> DataFrame:
    """cells(source, lang, topic, tokens) with weight (share of the mixture), keep_probability and residual.

    The probability is weight / token share, scaled so that the largest among cells without a rare
    category is 1, and 1 at most: no document is used twice, and as much of the corpus stays as the
    targets of the common categories allow. Cells with a rare category stay whole if their ratio is
    larger still; they hold at most RARE of the tokens per dimension, so the others always set the
    scale. Stated targets are met for rare categories, too; categories that they don't name share what
    they leave, in proportion to their tokens. residual is the largest distance of a category's share
    from its goal that is left.
    """
    cells = cut(cells)
    few = cells.count() <= few_cells
    total = cells.agg(F.sum("tokens")).first()[0] or 1.0
    cells = cut(_marginals(cells, temper or TEMPER, targets or {}).withColumn("weight", F.col("tokens") / F.lit(total)))
    residual = before = float("inf")
    while residual > TOLERANCE:
        cells = _raked(cells.coalesce(1) if few else cells, few)
        off = None
        for d in DIMENSIONS:
            one = cells.groupBy(d).agg(F.abs(F.sum("weight") - F.first(f"goal_{d}")).alias("off")).select("off")
            off = one if off is None else off.unionByName(one)
        residual = off.agg(F.max("off")).first()[0] or 0.0
        if residual > 0.5 * before:
            break
        before = residual
    ratio = F.col("weight") / F.col("tokens")
    common = F.col("common_source") & F.col("common_lang") & F.col("common_topic")
    top = cells.agg(F.max(F.when(common, ratio)).alias("common"), F.max(ratio).alias("any")).first()
    scale = F.lit(float(top["common"] or top["any"] or 1.0))
    return cells.withColumn("keep_probability", F.when(F.col("tokens") > 0, F.least(ratio / scale, F.lit(1.0))).otherwise(F.lit(0.0))).select(*DIMENSIONS, "tokens", "weight", "keep_probability", F.lit(residual).alias("residual"))


def _cell_of(text_col: str, source_col: str, lang_col: str, topic_col: str | None) -> list[Column]:
    """source, lang, topic and tokens of a row."""
    tokens = F.size(words(F.col(text_col))).cast("long") + 1
    topic = F.coalesce(F.col(topic_col), F.lit("(none)")) if topic_col else topic_of(F.col(text_col), tokens - 1)
    return [F.coalesce(F.col(source_col), F.lit("(none)")).alias("source"), F.coalesce(F.col(lang_col), F.lit("(none)")).alias("lang"), topic.alias("topic"), tokens.alias("tokens")]


def _fit(counted: DataFrame, temper, targets) -> DataFrame:
    """source, lang, topic, p of every cell, marked for broadcast if they are few."""
    cells = counted.groupBy(*DIMENSIONS).agg(F.sum("tokens").cast("double").alias("tokens"))
    fitted = cut(rake(cells, temper, targets)).select(*DIMENSIONS, F.round("keep_probability", 9).alias("p"))
    return F.broadcast(fitted) if fitted.count() <= FEW_CELLS else fitted


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", topic_col: str | None = None, temper: dict[str, float] | None = None, targets: dict[str, dict[str, float]] | None = None, seed: int = SEED) -> DataFrame:
    """One row per input row: doc_id, source, lang, topic, n_tokens, keep_probability, kept.

    n_tokens counts words of the whole text plus one for the end of the document, so that empty and null
    texts have a weight too. A null source, language or topic is the category ``(none)``; without
    topic_col the topic is a class of the text's form. Rows of equal id in one cell share their fate, and
    so do rows without an id. An empty table gives an empty result. Other columns, whatever their names,
    are not read.
    """
    rows = cut(docs.select(F.col(id_col).alias("doc_id"), *_cell_of(text_col, source_col, lang_col, topic_col)))
    return rows.join(_fit(rows, temper, targets), list(DIMENSIONS)).select(
        "doc_id", *DIMENSIONS, F.col("tokens").alias("n_tokens"), F.col("p").alias("keep_probability"), (unit_hash(F.col("doc_id"), seed) < F.col("p")).alias("kept"),
    )


def sample_mixture(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", topic_col: str | None = None, temper: dict[str, float] | None = None, targets: dict[str, dict[str, float]] | None = None, seed: int = SEED) -> DataFrame:
    """The rows of docs that mix() keeps, with all columns as they are; texts are shuffled only if the cells are many."""
    rows = docs.select(F.struct("*").alias("doc"), F.col(id_col).alias("i"), *_cell_of(text_col, source_col, lang_col, topic_col))
    cells = _fit(rows.select(*DIMENSIONS, "tokens"), temper, targets)
    return rows.join(cells, list(DIMENSIONS)).where(unit_hash(F.col("i"), seed) < F.col("p")).select("doc.*")


def _sql(rounds: int = 2 * BLOCK) -> str:
    """The same with a fixed number of rounds, in which the given tables meet their marginals to the last digits."""
    steps = [r"""
WITH r AS (SELECT doc_id, coalesce(source, '(none)') AS source, coalesce(lang, '(none)') AS lang, coalesce(text, '') AS t,
  len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')) AS n FROM documents),
d AS (SELECT doc_id, source, lang, n + 1 AS n_tokens, CASE WHEN (length(t) - length(replace(t, '|', ''))) * 10 > n THEN 'table'
  WHEN n >= 1000 THEN 'long' WHEN n >= 200 THEN 'article' ELSE 'brief' END AS topic FROM r),
c AS (SELECT source, lang, topic, CAST(sum(n_tokens) AS DOUBLE) AS tokens FROM d GROUP BY ALL)"""]
    for x in DIMENSIONS:
        share = f"SELECT {x}, sum(tokens) / (SELECT sum(tokens) FROM c) AS share FROM c GROUP BY 1"
        steps.append(f"g_{x} AS (SELECT {x}, pow(share, {TEMPER[x]}) / sum(pow(share, {TEMPER[x]})) OVER () AS goal, share * count(*) OVER () >= {RARE} AS common FROM ({share}))")
    steps.append("w0 AS MATERIALIZED (SELECT source, lang, topic, tokens, tokens / sum(tokens) OVER () AS weight FROM c)")
    k = 0
    for _ in range(rounds):
        for x in DIMENSIONS:
            steps.append(f"w{k + 1} AS MATERIALIZED (SELECT w.source, w.lang, w.topic, w.tokens, w.weight * g.goal / sum(w.weight) OVER (PARTITION BY w.{x}) AS weight FROM w{k} w JOIN g_{x} g ON g.{x} = w.{x})")
            k += 1
    joins = " ".join(f"JOIN g_{x} ON g_{x}.{x} = w.{x}" for x in DIMENSIONS)
    steps.append(f"q AS (SELECT w.source, w.lang, w.topic, weight / tokens AS ratio, {' AND '.join(f'g_{x}.common' for x in DIMENSIONS)} AS common FROM w{k} w {joins})")
    steps.append("p AS (SELECT source, lang, topic, round(least(1.0, ratio / coalesce(max(ratio) FILTER (common) OVER (), max(ratio) OVER ())), 9) AS keep_probability FROM q)")
    return ",\n".join(steps) + f"""
SELECT d.doc_id, d.source, d.lang, d.topic, d.n_tokens, p.keep_probability,
  CAST(('0x' || substr(md5('{SEED}:' || d.doc_id), 1, 13)) AS BIGINT) / 4503599627370496.0 < p.keep_probability AS kept
FROM d JOIN p ON p.source = d.source AND p.lang = d.lang AND p.topic = d.topic
"""


SQL = _sql()
