"""Documents with nulls, empty and long texts, ties, repeated rows and columns whose names clash with results."""

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, n_words long, taken long"
LONG = " ".join(f"word{k % 977} and" for k in range(20_000))
TEXTS = [
    None, "", "  \t\n ", "one", "one", "a b c", "A B C", "x" * 50_000, LONG, LONG, LONG + " more",
    "call +49 (30) 1234-5678 or jane.doe@mail.example.org now", "line one\nline one\n\nline two\nline one", "wow!!! #$%& <b> | \x0b\x0c end",
    "Grüße aus Köln, naïve café \U0001f600     tail", "repeat this now repeat this now repeat this now",
]


def rows() -> list[tuple]:
    out = [(k if k != 5 else None, t, None if k % 5 == 0 else "en", (None, "web", "news", "code")[k % 4], None, 7, 8, 9) for k, t in enumerate(TEXTS)]
    return [*out, out[3], out[3]]


def documents(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(rows(), SCHEMA)


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)
