import pytest

#: Texts that operators must handle: null, empty, white space, repeats, ties, several scripts, a very long one.
ODD = [
    (0, None), (1, ""), (2, " \t\n "), (3, "one"), (4, "One two THREE four"), (5, "one two three four five six"), (6, "one  two\tthree four five six"),
    (6, "one  two\tthree four five six"), (7, "Ärger über Öl, naïve café 東京 123 4.5!"), (8, "it's we'll  double  spaces \n\n new\tline "), (9, "x" * 3000), (10, "word " * 4000),
    (11, "a\0b \x1c c d   e"), (None, "no id at all here"), (None, "no id at all here"), (12, "<|endoftext|> is text"), (13, "in<|endoftext|>side <|endoftext|><|endoftext|> and <|endoftext|"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """The odd texts, with columns whose names clash with those that operators make."""
    extra = [f"'{n}' as {n}" for n in ("digest", "fp", "kept", "score", "norm", "label", "block", "piece", "length", "n", "rank", "share")]
    return spark.createDataFrame(ODD, "doc_id long, text string").selectExpr("*", *extra).repartition(3, "text")


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")
