import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, fp long, component_id long, _text string, rank int, taken long"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, and columns whose names operators use themselves."""
    texts = [
        (0, None, None, None), (1, "", "en", "a"), (2, "   \n\t", "en", "a"), (3, "the end", "en", None), (4, "the end", "en", "b"), (4, "the end", "en", "b"),
        (5, "1234 5678", None, "b"), (6, "word " * 60_000, "en", "a"), (7, "x" * 100_000, "de", "c"), (8, "<|endoftext|> mail a.b@c.de <|startoftext|>", "en", "c"), (9, "日本語のテキスト 😀 é́ \x1c \x85", "xx", "d"),
        (None, "no id at all", "en", "d"), (10, "Ünïcode ÀÉ.\r\nlines, and 'll don't", "fr", "e"),
    ]
    rows = [(i, t, lang, s, None if t is None else len(t), 0.5, 1, 2, "clash", 3, 4) for i, t, lang, s in texts]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="session")
def empty(odd):
    return odd.where("false")
