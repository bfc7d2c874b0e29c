import pytest

ODD = [
    (1, "Ing the and of. Reheea a hehaly tion rees thble thatatha that only as the eresha for.", "en", "s", 1),
    (2, "Ing the and of. Reheea a hehaly tion rees thble thatatha that only as the eresha for.", "en", "s", 1),
    (2, "Ing the and of. Reheea a hehaly tion rees thble thatatha that only as the eresha for.", "en", "s", 1),
    (3, None, None, None, None), (4, "", "", "", 0), (5, " \t\n ", "en", "s", 4), (6, "one", "en", "s", 3), (None, "null id é 🙂", "en", None, 1),
    (7, "word " * 60_000, "en", "s", 300_000), (8, "x" * 200_000, "en", "s", 200_000), (9, "a\x00b <|endoftext|> İΣ ﬁ", "en", "s", 1),
]


@pytest.fixture
def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and extra columns whose names clash with outputs."""
    df = spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string, n_chars long")
    return df.selectExpr("*", "'x' as score", "1 as n_words", "array(1) as hits", "'y' as items", "2 as pii", "'z' as `key`", "3 as shard", "4 as length", "5 as start")


@pytest.fixture
def none(odd):
    return odd.limit(0)
