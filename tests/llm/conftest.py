import pytest

#: Columns that clash with names that the operators use inside.
EXTRA = ("node", "bucket", "size", "slot", "shard", "position", "turn", "spans", "score", "_text", "_n", "_key", "kept", "content")


@pytest.fixture(scope="session")
def edges(spark):
    """Documents with nulls in every column, empty and very long texts, repeated rows and ids, and clashing columns."""
    long = " ".join(f"w{i * i % 9973}" for i in range(200_000))
    rows = [
        (1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu", "en", "a", 3),
        (2, None, None, None, None),
        (3, "", "en", "a", 0),
        (4, " \n\t ", "en", "b", 4),
        (5, long, "en", "a", 1),
        (6, "x " * 50_000, "en", "a", 1),
        (7, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu", "de", "b", 1),
        (7, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu", "de", "b", 1),
        (None, "a text without an id that stands alone among all the others here", "en", None, 1),
        (8, "Größe \U0001f600 naïve é́ x y", "fr", "c", 1),
    ]
    rows = [r + ("clash",) * len(EXTRA) for r in rows]
    kinds = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"{c} string" for c in EXTRA)
    return spark.createDataFrame(rows, kinds)


@pytest.fixture(scope="session")
def no_rows(edges):
    return edges.where("doc_id < 0")
