import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LINE = "This line is well over forty characters long, so it counts."


def doc(i, text, source="s", lang="en"):
    return (i, text, lang, source, None if text is None else len(text))


@pytest.fixture(scope="session")
def hard_docs():
    """Nulls, empty and very long texts, repeated rows, ties and wide characters."""
    words = " ".join(f"w{k}" for k in range(60))
    rows = [doc(k, f"{LINE}\nown {k}\n  {LINE.upper()}\t") for k in range(1, 7)]
    rows += [doc(10, None), doc(11, ""), doc(12, "   \n\t"), doc(None, words), doc(13, words), doc(13, words), doc(14, words + " x"), doc(15, "é" * 50 + "\n\nß"), doc(16, "a b c", None), doc(17, "A B  c", None, None)]
    rows += [doc(18, " ".join(f"long{k % 977}" for k in range(40_000)), "big"), doc(19, "l<|endoftext|>r don't stop now  twice\ttab\n", "z")]
    return rows


@pytest.fixture()
def docs(spark, hard_docs):
    return spark.createDataFrame(hard_docs, SCHEMA)


@pytest.fixture()
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
