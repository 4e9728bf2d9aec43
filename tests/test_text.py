import random

from pyspark.sql import functions as F

from ledgerloom.functions.text import concat_nonempty, indel_ratio, indel_similarity, jaccard, tokenize


def _lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j], row[j + 1])
    return row[-1]


def test_indel_against_a_table():
    random.seed(1)
    for _ in range(300):
        a, b = ("".join(random.choice("abé ") for _ in range(random.randint(0, 70))) for _ in range(2))
        want = 1.0 if not a + b else 2 * _lcs(a, b) / (len(a) + len(b))
        assert indel_similarity(a, b) == want


def test_tokens_and_jaccard(spark):
    rows = spark.createDataFrame([(0, "Café-12 ACH ach", "ach 12"), (1, "", None), (2, "a", "--"), (3, "A b", "b a")], "i int, a string, b string")
    out = rows.select("i", tokenize(F.col("a")).alias("t"), jaccard(tokenize(F.col("a")), tokenize(F.col("b"))).alias("j"), indel_ratio("a", "b").alias("r")).orderBy("i").collect()
    assert out[0]["t"] == ["caf", "12", "ach"]
    assert [round(r["j"], 6) for r in out] == [0.666667, 1.0, 0.0, 1.0]
    assert out[1]["r"] == 1.0


def test_concat(spark):
    got = spark.range(1).select(concat_nonempty(F.array(F.lit("a"), F.lit(""), F.lit(None).cast("string"), F.lit("b"))).alias("x")).first()["x"]
    assert got == "a b"
