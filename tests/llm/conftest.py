import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, score double, spans string, copies int"


def row(doc_id, text, source="s", lang="en"):
    return (doc_id, text, lang, source, None if text is None else len(text), 7, 0.5, "x", 3)


@pytest.fixture(scope="session")
def messy(spark):
    """Nulls in every column, empty and long texts, repeated rows, columns named like results."""
    words = [f"w{i % 997}x{i % 13}" for i in range(60_000)]
    rows = [row(1, ""), row(2, None), row(3, "word"), row(4, " ".join(words)), row(5, "a b c d e f g h\nsecond line"),
            row(6, "a b c d e f g h\nsecond line"), row(6, "a b c d e f g h\nsecond line"), row(None, "no id, a text of its own"),
            row(7, "Ünï çödé \u2028 token = \"24be64439e3e49cf46b2d7c90f3602a3\"", None, None), (8, None, None, None, None, None, None, None, None),
            row(9, "x\ty\x0bz " * 40, "t"), row(10, "\n\n \t"), row(11, "idiot scum " * 5, "t")]
    rows += [row(100 + i, f"common words here and a number {i} to make it differ {i * i}", "big") for i in range(60)]
    return spark.createDataFrame(rows, DOCS).repartition(5)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCS)
