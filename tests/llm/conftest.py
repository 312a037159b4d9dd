import random

import pytest

WORDS = "ba be bi bo bu da de di do du ka ke ki ko ku la le li lo lu ma me mi mo mu na ne ni no nu".split()


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + rng.choice(WORDS) + rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text, lang, source) with every awkward case: nulls, empty and long texts, ties, repeats, copies of all kinds."""
    rng = random.Random(5)
    rows = [(i, prose(rng, rng.randint(1, 120)), rng.choice(["aa", "bb"]), rng.choice(["s1", "s2", "s3", None])) for i in range(120)]
    base = prose(rng, 200)
    rows += [(200 + i, base, "aa", "hot") for i in range(40)]
    rows += [(300 + i, base + f" w{i}", "aa", "hot") for i in range(40)]
    rows += [(400, None, None, None), (401, "", "aa", "s1"), (402, "  \n\t ", None, "s2"), (403, prose(rng, 30_000), "bb", "s3"), (404, "x" * 50_000, "bb", "s3")]
    rows += [(405, "... !!! 12 34", "aa", "s1"), (406, "<|endoftext|> and <|endof", "aa", "s1"), (407, "İğ ÇŞ 日本語 한국어 \U0001f600‍ á", "aa", "s1")]
    rows += [rows[3], rows[3], (None, "without an id", "aa", "s1")]
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    df = spark.createDataFrame(corpus, "doc_id bigint, text string, lang string, source string")
    # Extra columns whose names the operators use themselves.
    return df.selectExpr("*", "1 as size", "'x' as score", "2 as fp", "'y' as shard", "3 as need", "4 as n", "5 as component_id", "6 as lang_pred").repartition(5).cache()


@pytest.fixture(scope="session")
def nothing(docs):
    return docs.limit(0)
