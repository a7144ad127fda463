import pytest

SMALL = "/root/testdata/sf0.001"

#: Texts with the cases every operator must take: null, empty, blanks, ties, copies, a very long one.
EDGE_TEXTS = [
    None,
    "",
    " \t\n",
    "one",
    "a b c",
    "A  B\nC\x0bD",
    "same words here again and again for the test of ties and copies in this table of texts ok",
    "same words here again and again for the test of ties and copies in this table of texts ok",
    "naïve ümlaut ß ﬁ 漢字 😀 text with many kinds of letters",
    "1234 5678 --- !!!",
    "la " * 30000,
    " ".join(f"w{n}" for n in range(30000)),
]


@pytest.fixture
def edge(spark):
    """doc_id, text, lang, source, n_chars and columns whose names the operators use themselves."""
    rows = [(n, t, "en" if n % 2 else None, "src0", len(t) if t else None) for n, t in enumerate(EDGE_TEXTS)]
    rows += [rows[6], rows[6], (None, "no id here", None, None, None), (None, None, None, None, None)]
    names = "doc_id long, text string, lang string, source string, n_chars long"
    clash = ", fp string, score string, kept string, label string, ids string, item_id string, n_words string, value string"
    return spark.createDataFrame([(*r, *"abcdefgh") for r in rows], names + clash)


@pytest.fixture
def empty(edge):
    return edge.limit(0)
