"""Code matching: exact, look-alike, check-digit-corrected and fuzzy, first tier that hits wins."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoints import cut
from ..functions import ean, text
from ..functions.similarity import code_similarity
from . import near_codes

FIELDS = ("article", "product_code", "ean13")
# Scores of the tiers, and the fuzzy tier's rules.
EXACT, SKELETON, CORRECTED, FUZZY_CAP = 1.0, 0.97, 0.95, 0.949
STRONG = 0.95
#: Distinct tokens that go in one block against all codes; edits of their first walk; tasks a core.
TOKEN_BLOCK, FIRST_RADIUS, TASKS_A_CORE = 1 << 17, 2, 2
CUTOFF, THRESHOLD, TOP, OSA_WEIGHT, JW_WEIGHT, PER_CHAR, MOST = 0.72, 0.80, 20, 0.6, 0.4, 0.02, 0.10


def code_index(catalog: DataFrame) -> DataFrame:
    """external_id, field, raw, norm, skel: one row per product and filled code."""
    pairs = F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(f).alias("field"), F.col(f).alias("raw")) for i, f in enumerate(FIELDS)])
    one = catalog.select("external_id", F.explode(pairs).alias("c")).select("external_id", "c.*")
    one = one.where(F.col("raw").isNotNull()).withColumn("norm", text.norm_code(F.col("raw"))).where(F.col("norm") != "")
    return one.withColumn("skel", text.skeleton(F.col("norm")))


def exact(tokens: DataFrame, codes: DataFrame) -> DataFrame:
    return tokens.join(codes, tokens["token_norm"] == codes["norm"]).select(tokens["*"], "external_id", "field", "pos", "norm", F.lit(EXACT).alias("score"), F.lit("exact").alias("tier"), F.lit(1).alias("level"))


def look_alike(tokens: DataFrame, codes: DataFrame) -> DataFrame:
    t = tokens.withColumn("token_skel", text.skeleton(F.col("token_norm")))
    return t.join(codes, t["token_skel"] == codes["skel"]).select(*[t[c] for c in tokens.columns], "external_id", "field", "pos", "norm", F.lit(SKELETON).alias("score"), F.lit("exact_normalized").alias("tier"), F.lit(2).alias("level"))


def corrected(tokens: DataFrame, codes: DataFrame) -> DataFrame:
    t = tokens.where(text.is_ean_shape(F.col("token_norm"))).withColumn("candidate", F.explode(ean.variants(F.col("token_norm"))))
    return t.join(codes, t["candidate"] == codes["norm"]).select(*[t[c] for c in tokens.columns], "external_id", "field", "pos", "norm", F.lit(CORRECTED).alias("score"), F.lit("ean_corrected").alias("tier"), F.lit(3).alias("level"))


def _near(tokens: list[str], norms: DataFrame, last: int | None) -> DataFrame:
    """token_norm, norm, edits: at most TOP of each token from each range of the codes."""
    asked = norms.sparkSession.sparkContext.broadcast(tokens)

    def run(batches):
        codes = pa.concat_arrays([pa.array([], pa.string()), *(b["norm"].cast(pa.string()) for b in batches)])
        tree, words = near_codes.Tree(sorted(codes.to_pylist())), pa.array(asked.value, pa.string())
        codes = codes.take(pc.sort_indices(codes))
        for t, s, edits in near_codes.nearest(tree, asked.value, CUTOFF, TOP, last):
            yield pa.RecordBatch.from_arrays([words.take(pa.array(t)), codes.take(pa.array(s)), pa.array(edits)], ["token_norm", "norm", "edits"])

    return norms.mapInArrow(run, "token_norm string, norm string, edits long")


def _top(near: DataFrame) -> DataFrame:
    """The TOP by similarity and code; rn is the place."""
    near = near.withColumn("osa", F.round(1 - F.col("edits") / F.greatest(F.length("token_norm"), F.length("norm")), 9))
    return near.withColumn("rn", F.row_number().over(Window.partitionBy("token_norm").orderBy(F.desc("osa"), "norm"))).where(F.col("rn") <= TOP)


def fuzzy(tokens: DataFrame, codes: DataFrame) -> DataFrame:
    """Distinct codes near each distinct token.

    Blocks of TOKEN_BLOCK tokens walk down the prefix trees of ranges of codes, and meet only prefixes near them. A first walk goes
    to FIRST_RADIUS edits; tokens of which a farther code could still be among the TOP walk again, as far as the cutoff allows.
    """
    words = tokens.select("token_norm").where("token_norm IS NOT NULL").distinct()
    n = max(1, -(-words.count() // TOKEN_BLOCK))
    tasks = TASKS_A_CORE * codes.sparkSession.sparkContext.defaultParallelism
    norms = cut(codes.select("norm").distinct().repartitionByRange(tasks, "norm"))
    longest = norms.agg(F.max(F.length("norm"))).first()[0] or 0
    found = []
    for k in range(n):
        block = sorted(words.where(F.pmod(F.xxhash64("token_norm"), F.lit(n)) == k).toArrow()["token_norm"].to_pylist())
        if not block:
            continue
        first = cut(_top(_near(block, norms, FIRST_RADIUS)))
        full = dict(zip(*(c.to_pylist() for c in first.where(F.col("rn") == TOP).select("token_norm", "osa").toArrow().columns)))
        sizes = np.array([len(t) for t in block])
        bar = np.array([full.get(t, -1.0) for t in block])
        again = (near_codes.radii(sizes, longest, CUTOFF) > FIRST_RADIUS) & (bar <= near_codes.best_beyond(sizes, longest, FIRST_RADIUS) + 1e-8)
        rest = [t for t, more in zip(block, again) if more]
        if rest:
            open_ = tokens.sparkSession.createDataFrame([(t,) for t in rest], "token_norm string")
            first = first.join(open_, "token_norm", "left_anti").unionByName(_top(_near(rest, norms, None)))
        found.append(first)
    near = found[0] if found else tokens.sparkSession.createDataFrame([], "token_norm string, norm string")
    for x in found[1:]:
        near = near.unionByName(x)
    scored = near.select("token_norm", "norm").withColumn("s", code_similarity("token_norm", "norm"))
    raw = OSA_WEIGHT * F.col("s.osa") + JW_WEIGHT * F.col("s.jw") - F.least(PER_CHAR * F.abs(F.length("token_norm") - F.length("norm")), F.lit(MOST))
    scored = scored.withColumn("raw", raw).where(F.col("raw") >= THRESHOLD).select("token_norm", "norm", F.round(F.least("raw", F.lit(FUZZY_CAP)), 4).alias("score"))
    return tokens.join(scored, "token_norm").join(codes.select("norm", "external_id", "field", "pos"), "norm").select(*[tokens[c] for c in tokens.columns], "external_id", "field", "pos", "norm", "score", F.lit("fuzzy").alias("tier"), F.lit(4).alias("level"))


def cascade(tokens: DataFrame, codes: DataFrame, with_fuzzy: bool = True) -> DataFrame:
    """tokens(query_id, token_pos, token_norm): the hits of the first tier that has any, per token."""
    strong = exact(tokens, codes).unionByName(look_alike(tokens, codes)).unionByName(corrected(tokens, codes))
    first = Window.partitionBy("query_id", "token_pos")
    strong = strong.withColumn("best", F.min("level").over(first)).where(F.col("level") == F.col("best")).drop("best")
    if not with_fuzzy:
        return strong
    left = tokens.join(strong.select("query_id", "token_pos").distinct(), ["query_id", "token_pos"], "left_anti")
    return strong.unionByName(fuzzy(left, codes))


def best_per_product(hits: DataFrame) -> DataFrame:
    """One row per query and product: the best score, then the earlier token and field."""
    w = Window.partitionBy("query_id", "external_id").orderBy(F.desc("score"), "token_pos", "pos", "norm")
    out = hits.withColumn("rn", F.row_number().over(w)).where(F.col("rn") == 1).drop("rn")
    rank = Window.partitionBy("query_id").orderBy(F.desc("score"), "token_pos", "external_id")
    return out.withColumn("code_rank", F.row_number().over(rank).cast("long"))
