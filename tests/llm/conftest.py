import random

import pytest

SCHEMA = (
    "doc_id bigint, text string, source string, lang string, size string, target string, taken int, part string, score string, key string,"
    " id string, row string, digest string, words string, texts string, batch string, n_words string, spans string"
)
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(60)) for _ in range(n))


def extra(k: int) -> tuple:
    return ("en", "clash", "clash", k, "clash", "clash", "clash", "clash", "clash", "clash", "clash", "clash", "clash", "clash", "clash")


@pytest.fixture(scope="session")
def odd_rows():
    """NULLs in every column, empty and very long texts, ties, repeated rows."""
    long = prose(1, 30_000)
    rows = [
        (1, prose(2, 120), "a"), (2, prose(2, 120), "a"), (3, prose(3, 80), None), (4, None, "b"), (5, "", "b"), (6, " \n\t ", "b"),
        (7, long, "c"), (7, long, "c"), (8, "one", "c"), (8, "two words", "c"), (None, prose(4, 60), "a"), (None, None, None), (9, "ünï ¢ode 日本 語\n" * 3, "日"),
        (10, prose(2, 119) + " changed", "a"), (11, "<|endoftext|> x  y\n\n z  w   end", "b"),
    ]
    rows = [(*r, *extra(k)) for k, r in enumerate(rows)]
    rows.append((12, *[None] * (len(rows[0]) - 1)))
    rows.append(rows[-1])
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def entry_queries():
    import __spark_entry__

    return __spark_entry__.queries()
