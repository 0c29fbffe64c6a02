import pytest

#: Extra columns named like those that operators use inside.
CLASHES = {
    c: "string"
    for c in "id _text ids bytes spans row slot start block turn text_hash n_chars_ h u t nth node key n sig digest words lines label url rule method vector entry query_id rank score rejected held_out part file first".split()
}
PROSE = "the quick brown fox jumps over the lazy dog while seven wise owls watch from an old oak tree near the quiet river bank"


@pytest.fixture(scope="session")
def odd_rows():
    """(doc_id, text): nulls, empty, blank, very long, repeated rows, repeated ids, a null id."""
    long = " ".join(f"word{i * 7919 % 10007}" for i in range(40_000))
    return [
        (1, PROSE),
        (2, None),
        (3, ""),
        (4, " \t\n\x0b  "),
        (5, long),
        (6, PROSE),
        (7, PROSE.upper().replace("QUICK", "slow") + " end"),
        (8, "x" * 5_000 + " " * 3_000 + "=" * 700),
        (9, "naïve Straße 漢字 😀 l'été 's 're 　 end"),
        (10, "one row"),
        (10, "one row"),
        (11, "first text of an id that comes twice in the table"),
        (11, "second text of an id that comes twice in the table"),
        (None, "a row without an id that stands for nothing at all here"),
    ]


@pytest.fixture
def odd_docs(spark, odd_rows):
    """The odd rows with extra columns of clashing names and null sources and languages."""
    rows = [(i, t, None if k % 3 == 0 else f"s{k % 2}", None if k % 4 == 0 else "en", *["x"] * len(CLASHES)) for k, (i, t) in enumerate(odd_rows)]
    schema = "doc_id long, text string, source string, lang string, " + ", ".join(f"`{c}` {t}" for c, t in CLASHES.items())
    return spark.createDataFrame(rows, schema)


@pytest.fixture
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string, lang string, n_chars long")
