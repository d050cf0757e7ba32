import pytest
from pyspark.sql import functions as F

PROSE = (
    "the quick brown fox jumps over a lazy dog while seven small boats drift along the quiet river and old men "
    "talk about rain and harvest until the evening bell rings over roofs gardens and the long road to the sea where "
    "children count ships lamps and stars before they walk home through narrow lanes with bread apples and a song "
)
LONG = " ".join(f"word{i % 977}x{i % 31}" for i in range(40_000))
ROWS = [
    (1, PROSE, "en", "a"), (2, PROSE, "en", "a"), (2, PROSE, "en", "a"), (3, None, None, None), (4, "", "en", "b"),
    (None, PROSE + "tail", None, "b"), (5, " \n\t ", "xx", None), (6, "é ß 日本語 ©", "xx", "b"), (7, LONG, "en", "c"),
    (8, "one two", "en", "c"), (9, PROSE.upper(), "en", "c"), (9, "other text of the same id", "en", "c"), (10, None, None, None),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty, blank and very long texts, repeated rows and ids, columns with clashing names."""
    from riskweave.llm.tables import share_package

    share_package(spark)
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string").coalesce(3)
    for clash in ("fp", "node", "th", "h", "w", "p", "weight", "topic", "tokens", "hits", "rank", "kept", "first", "label"):
        df = df.withColumn(clash, F.lit("clash"))
    return df


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
