"""Check-digit corrections and judgements of groups, against the forms that make every candidate and pair."""

import random

from pyspark.sql import functions as F

from quarry.functions import ean
from quarry.operators import evaluate


def test_candidates_equal_the_checked_ones(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice("0123456789") for _ in range(13)) for _ in range(300)] + ["4006381333931", "0" * 13, "400638133393", "40063813X3931", "40063813339311", "", None]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", ean.correction_candidates(F.col("t")).alias("a"), ean._checked_candidates(F.col("t")).alias("b"))
    assert all(r["a"] == r["b"] for r in got.where("t IS NULL OR t RLIKE '^[0-9]{13}$' OR length(t) <> 13").collect())


def test_judgements_of_groups_equal_those_of_pairs(spark):
    rng = random.Random(6)
    members = [(g, d, rng.choice([0, 1, 1, 2, 3])) for g in range(4) for d in range(g * 100, g * 100 + (3, 9, 40, 25)[g])] + [(7, 900, 0)]
    queries = [(q, q % 5 if q < 30 else 7) for q in range(31)]
    hits = [(q, d, r) for q in range(31) for r, d in enumerate(rng.sample(range(400), 12), 1)]
    m = spark.createDataFrame(members, "group long, doc_id long, grade long")
    q = spark.createDataFrame(queries, "query_id long, group long")
    h = spark.createDataFrame(hits, "query_id long, doc_id long, rank long")
    rows = lambda df: {r[0]: tuple(round(x, 9) for x in r[1:]) for r in df.collect()}
    grouped = evaluate.per_query_of_groups(h, q, m)
    assert rows(grouped) == rows(evaluate.per_query(h, q.join(m, "group").select("query_id", "doc_id", "grade"))) and len(rows(grouped)) == 25


def test_rows_are_checked_once(spark):
    from quarry.sources import imports

    rows = spark.createDataFrame([(1, "a", " n  m ", "12", "x"), (2, None, "n", "1", "y"), (3, "c", " ", "z", "")], "__row long, id string, name string, `ціна` string, brand string")
    good, bad = imports.split_valid(imports.checked(imports.map_columns(rows)))
    assert [(r["external_id"], r["name"], r["price"]) for r in good.collect()] == [("a", "n m", 12.0)]
    assert [tuple(r) for r in bad.collect()] == [(2, "external_id: missing"), (3, "name: missing; price: not a number")]
    assert good._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") <= 5
