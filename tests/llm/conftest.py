import pytest


@pytest.fixture(scope="session")
def documents(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Null and empty texts, null ids and sources, repeated rows, ties, a very long text, and columns whose names clash with ours."""
    word = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu "
    rows = [
        (1, word * 8, "a"), (2, word * 8, "a"), (2, word * 8, "a"), (3, None, "a"), (4, "", None), (None, word * 8, None), (None, None, "b"), (5, "\t\n \x0b", "b"),
        (6, "Ünïcödé 漢字 ▁mark \x85\u2003gap " * 5, "c"), (7, " ".join(f"w{i}" for i in range(60_000)), "c"), (8, "one two", "c"), (8, "one two three", "c"),
    ]
    clash = ("size", "shard", "slot", "n_words", "kept", "hashes_", "fp", "block_", "target", "taken", "n_removed", "text_key_", "key", "row_")
    schema = "doc_id long, text string, source string, lang string, n_chars long, " + ", ".join(f"{c} string" for c in clash)
    return spark.createDataFrame([(*r, "en", len(r[1] or ""), *["x"] * len(clash)) for r in rows], schema)


@pytest.fixture(scope="session")
def no_documents(odd_documents):
    return odd_documents.limit(0)
