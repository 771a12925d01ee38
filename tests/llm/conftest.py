import pytest
from pyspark.sql import functions as F

#: A text longer than a slice of the scanners.
LONG = ("the quick brown fox jumps over it again and " * 30_000).strip()
ROWS = [
    (1, "the cat sat on the mat and looked at the dog for a long while", "en", "a", 10),
    (2, "the cat sat on the mat and looked at the dog for a long while", "en", "a", 10),
    (3, None, "en", None, None),
    (4, "", None, "b", 0),
    (5, "   \n\t ", "de", "b", 5),
    (6, "one two", "de", "c", 7),
    (7, "ein Hund und eine Katze laufen über die Straße in die Stadt", "de", "c", 50),
    (8, LONG, "en", "a", 1),
    (9, "🙂 中文 <|endoftext|> 123 &amp;", "zh", "d", 3),
    (9, "🙂 中文 <|endoftext|> 123 &amp;", "zh", "d", 3),
    (None, "no id here at all my friend", "en", "a", 2),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = "size shard slot score key block node root group unit rank copies placements held_out n_shingles code k1 quality __u".split()


def clashing(df):
    """The frame with extra columns that have the operators' inner names."""
    return df.withColumns({c: F.lit("x") for c in CLASHES})


@pytest.fixture(scope="session")
def odd_docs(spark):
    return clashing(spark.createDataFrame(ROWS, SCHEMA)).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return clashing(spark.createDataFrame([], SCHEMA))
