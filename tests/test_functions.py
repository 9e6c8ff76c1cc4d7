from pyspark.sql import functions as F

from quarry.functions import ean, text
from quarry.functions.similarity import jaro_winkler, osa_distance, osa_similarity
from quarry.operators import coverage


def column(spark, values, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(f(F.col("v"))).collect()]


def test_code_forms(spark):
    assert column(spark, ["gsb 13-re", "НВ-500т", "ＡＢ１２", None], text.norm_code) == ["GSB13RE", "HB500T", "AB12", None]
    assert len(set(column(spark, ["BOSCH06", "B0SCHO6", "8QSCHO6"], text.skeleton))) == 1


def test_code_like(spark):
    yes = ["GSB-13-RE", "GSB13RE", "HW-1234K", "4006381333931", "A123456", "НВ-1234"]
    no = ["18V", "5Ah", "230V", "1500W", "500ГБ", "18в", "10мм", "0.5л", "2000mAh", "пилосос", "Bosch", "Li-Ion", "X1", "13"]
    assert column(spark, yes, text.is_code_like) == [True] * len(yes)
    assert column(spark, no, text.is_code_like) == [False] * len(no)


def test_check_digits(spark):
    assert column(spark, ["400638133393"], ean.check_digit) == ["1"]
    assert column(spark, ["4006381333931", "4006381333932", "12"], ean.is_valid) == [True, False, False]
    found = column(spark, ["4006381333932"], ean.correction_candidates)[0]
    assert len(found) == 13 and found[-1] == "4006381333931"
    assert column(spark, ["4006381333931", "400638133393", "14006381333931", "77"], ean.variants) == [["4006381333931"], ["4006381333931"], ["4006381333931"], []]


def test_similarity():
    assert osa_distance("CA", "ABC") == 3 and osa_distance("AB", "BA") == 1
    score = lambda a, b: round(min(0.6 * osa_similarity(a, b) + 0.4 * jaro_winkler(a, b) - min(0.02 * abs(len(a) - len(b)), 0.1), 0.949), 4)
    assert score("GSB13RF", "GSB13RE") == 0.8914
    assert score("HW124K", "HW1234K") == 0.8829
    assert score("GSB31RE", "GSB13RE") == 0.9010


def test_coverage(spark):
    rows = [("материнська плата hdmi lga 1200",), ("материнська плата lga 1200",), ("чайник 1200 вт",), ("монітор 27 дюймів",)]
    df = spark.createDataFrame(rows, "hay string").withColumn("q", F.lit("мат плата з hdmi на 1200"))
    df = df.withColumn("w", coverage.haystack_words(F.col("hay"))).withColumn("g", coverage.unit_groups(F.col("w")))
    df = df.withColumn("r", coverage.requirements(text.significant_tokens(F.col("q"))))
    df = df.withColumn("m", coverage.missing(F.col("r"), F.col("hay"), F.col("w"), F.col("g"))).select(coverage.ratio(F.col("r"), F.col("m")), "m")
    got = [tuple(r) for r in df.collect()]
    assert [g[0] for g in got] == [1.0, 0.75, 0.25, 0.0] and got[1][1] == ["hdmi"]


def test_unit_groups_cover(spark):
    df = spark.createDataFrame([("27 дюймів",)], "hay string").withColumn("w", coverage.haystack_words(F.col("hay"))).withColumn("g", coverage.unit_groups(F.col("w")))
    assert df.select(coverage.token_covered(F.lit("inch"), F.col("hay"), F.col("w"), F.col("g"))).first()[0]


def test_point_id_is_a_version_5_uuid(spark):
    import uuid

    got = column(spark, ["part-1", "ключ"], text.point_id)
    assert got == [str(uuid.uuid5(uuid.UUID("3f1d9a52-8c47-5b0e-9d61-2a7e4c90b8f3"), v)) for v in ("part-1", "ключ")]


def test_content_hash_tells_types_apart(spark):
    e = lambda t, s, n: F.array(F.struct(F.lit("k").alias("key"), F.struct(F.lit(t).alias("t"), F.lit(s).cast("string").alias("s"), F.lit(n).cast("double").alias("n")).alias("value")))
    row = spark.range(1).select(text.content_hash([F.lit("a")], e("s", "1", None)).alias("a"), text.content_hash([F.lit("a")], e("n", None, 1.0)).alias("b"), text.content_hash([F.lit(None).cast("string")], e("n", None, 1.0)).alias("c")).first()
    assert len(set(row)) == 3
