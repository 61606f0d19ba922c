import pytest

#: Texts that meet the corner cases: null, empty, white space, ties, repeats, control strings, a long text.
LONG = "word " * 60_000
TEXTS = [None, "", " \n\t", "a", "a", "two words", "two words", "Two words", "x y z", "X y z", "don't  stop\n\nnow", LONG,
         "mail a.b@mail1.example.com or +1 (974) 555-3436", "<|endoftext|> in <|im_end|>", "é ü ñ ß 中文 😀", None, "all rights reserved"]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Ids with nulls and repeats, a null source, and columns whose names clash with likely helper names."""
    rows = [(None if i % 7 == 6 else i // 2 * 2, t, "src%d" % (i % 3) if i % 5 else None, "k", float(i), True, "p/q") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, _key string, _n double, kept boolean, _text string")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("false")
