import random

import pytest

pytest.importorskip("lakeglass.llm")


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls everywhere, empty and long texts, repeats, and columns with clashing names."""
    rnd = random.Random(5)
    words = ["the", "of", "and", "house", "river", "tree", "Ünïcode", "漢字", "x1"]
    rows = [
        (1, "the house and the river of the tree " * 3, "en", "a"), (2, None, "en", None), (3, "", None, "b"), (4, " \n\t ", "en", "a"), (5, "one two", "en", "a"),
        (6, "the house and the river of the tree " * 3, "fr", "a"), (6, "the house and the river of the tree " * 3, "fr", "a"), (7, "12345 !!! ...", "de", None),
        (8, " ".join(rnd.choice(words) for _ in range(20_000)), "en", "c"), (9, "a" * 50_000, None, "c"), (10, "One TWO", "en", "a"), (11, "<|endoftext|> <s> ▁▁ <0x41>", "en", "z"),
    ]
    clash = "id bigint, size string, n int, token string, score string, shard string, h int, rank string, s string"
    df = spark.createDataFrame([(*r, 0, "x", 1, "t", "y", "z", 2, "r", "q") for r in rows], f"doc_id bigint, text string, lang string, source string, {clash}")
    return df.repartition(3)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("false")
