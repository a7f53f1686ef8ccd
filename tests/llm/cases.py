"""Awkward inputs that every operator and stage must take."""

from pyspark.sql import DataFrame, SparkSession

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
PROSE = "The quick brown fox jumps over the lazy dog. It then runs far away into the dark green woods, and sleeps. "


def documents(spark: SparkSession, rows) -> DataFrame:
    full = [(*r, *(None,) * (5 - len(r))) for r in rows]
    return spark.createDataFrame([(i, t, a, s, None if t is None else len(t)) for i, t, a, s, _ in full], DOCS)


def awkward(spark: SparkSession) -> DataFrame:
    """Nulls in any column, empty and very long texts, ties and repeated rows."""
    long = " ".join(f"word{k} number{k % 97} runs on." for k in range(20_000))
    return documents(
        spark,
        [
            (0, PROSE + "Once.", "en", "a"),
            (1, PROSE + "Once.", "en", "a"),
            (1, PROSE + "Once.", "en", "a"),
            (2, None, None, None),
            (3, "", "en", "b"),
            (4, " \t\n ", "en", "b"),
            (None, PROSE + "Nobody knows this one by any name at all.", "en", None),
            (None, None, None, None),
            (5, long, "en", "a"),
            (6, "x" * 100_000, "en", "b"),
            (7, "a b", None, "é"),
            (8, "A B", "de", "z"),
            (9, "You are a st0000pid id1ot, s t u p i d!", "en", "a"),
            (10, "naïve café — ünïcödé 東京 🎉 ǅ İstanbul ΣΑΣ <|endoftext|> it's we'll 12 34", "xx", "a"),
        ],
    )


def clashing(df: DataFrame, *names: str) -> DataFrame:
    """The same rows with extra columns under names that operators use."""
    return df.selectExpr("*", *[f"'x' AS `{n}`" for n in names])
