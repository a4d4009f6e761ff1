import pytest

LONG = "a very long text of words " * 4000 + "end"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows
    and extra columns whose names the operators use themselves."""
    en, de = "the idea of the thing and the other ones that were there", "der einheit und die ordnung von den anderen dingen nicht mit"
    rows = [(1, en, "en", "a"), (2, en, "en", "a"), (2, en, "en", "a"), (3, None, None, None), (4, "", "en", "b"), (5, LONG, "en", "b"), (None, de, "de", "c"),
            (None, None, None, None), (7, "123 $$$ \n\n", None, "c"), (8, "word", "de", "d"), (9, de + "\n" + de, "de", "d"), (10, "\u00e9\U0001f600 \u4e2d\u6587", "zh", "e"),
            (11, en + " and more", "en", "a"), (12, "\n\n\n", "", ""), (13, "W0RTHLESS i d i o t p@thetic", "en", "f")]
    extra = "score string, kept string, node string, row string, h string, depth string, n_chars string, __id string, __run string, label string, packed string, item string"
    n = len(extra.split(","))
    return spark.createDataFrame([(*r, *["x"] * n) for r in rows], "doc_id bigint, text string, lang string, source string, " + extra)
