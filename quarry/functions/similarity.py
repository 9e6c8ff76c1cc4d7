"""String and vector similarities. Spark has neither restricted edit distance nor Jaro-Winkler: one Arrow UDF has both."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType, StructField, StructType


def osa_distance(a: str, b: str) -> int:
    """Edits and swaps of neighbours, no part edited twice."""
    two, one = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(one[j] + 1, row[j - 1] + 1, one[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, two[j - 2] + 1)
            row.append(d)
        two, one = one, row
    return one[-1]


def osa_similarity(a: str, b: str) -> float:
    most = max(len(a), len(b))
    return 1 - osa_distance(a, b) / most if most else 1.0


def jaro_winkler(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    used, first = [False] * len(b), []
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == x:
                used[j] = True
                first.append(x)
                break
    if not first:
        return 0.0
    second = [y for y, u in zip(b, used) if u]
    m, t = len(first), sum(x != y for x, y in zip(first, second)) / 2
    jaro = (m / len(a) + m / len(b) + (m - t) / m) / 3
    same = 0
    for x, y in zip(a[:4], b[:4]):
        if x != y:
            break
        same += 1
    return jaro + same * 0.1 * (1 - jaro)


@pandas_udf(StructType([StructField("osa", DoubleType()), StructField("jw", DoubleType())]))
def code_similarity(a, b):
    import pandas as pd

    return pd.DataFrame({"osa": [osa_similarity(x, y) for x, y in zip(a, b)], "jw": [jaro_winkler(x, y) for x, y in zip(a, b)]})


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))
