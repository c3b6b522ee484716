"""Small awkward inputs shared by the tests of the training-data operators."""

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"

LOREM = ("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau "
         "upsilon phi chi psi omega one two three four five six seven eight nine ten eleven twelve").split()


def words(n, start=0, step=1):
    """n words, different for different starts."""
    return " ".join(f"{LOREM[(start + i * step) % len(LOREM)]}{(start * 7 + i) % 23}" for i in range(n))


def awkward():
    """NULLs in every column, empty and blank texts, repeated rows and ids, ties, a long text."""
    base = words(60, 3)
    return [
        (1, base, "en", "a", 10), (2, base, "en", "b", 10), (2, base, "en", "b", 10), (None, base, None, None, None),
        (3, None, "en", "a", 0), (4, "", "en", "a", 0), (5, "   \n\t ", "fr", "a", 6), (None, None, None, None, None),
        (6, words(5000, 9), "en", "hot", 1), (7, words(60, 4), None, "hot", 1), (8, "x", "en", "hot", 1),
        (9, base + " extra", "en", "a", 1), (10, "one", "en", "a", 1), (11, "Ünïcödé 文字 " + base, "de", "a", 1),
    ]


def frame(spark, rows, extra=True):
    """Documents with (by default) extra columns whose names operators use inside."""
    df = spark.createDataFrame(rows, SCHEMA)
    if extra:
        from pyspark.sql import functions as F

        for name in ("row", "name", "level", "fp", "key", "score", "kept", "label", "n", "pos", "words"):
            df = df.withColumn(name, F.lit("x"))
    return df.repartition(3).cache()
