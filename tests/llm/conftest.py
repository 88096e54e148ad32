import random

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, hash string, copy int, starts string, size string, `row` int, k int, words string, n_words int"


@pytest.fixture(scope="session")
def messy(spark):
    """Nulls in every column, empty and very long texts, repeated rows, ties, and columns of clashing names."""
    draw = random.Random(5)
    vocabulary = ["".join(draw.choices("abcdeéß", k=draw.randint(2, 9))) for _ in range(400)]
    prose = lambda n: " ".join(draw.choices(vocabulary, k=n)) + "."
    passage, base = prose(80), prose(300)
    words = base.split()
    near = " ".join([*words[:100], "changed", *words[101:]])
    texts = [prose(120), base, base, near, None, "", " \t\n", "one two three", "one two three", "one  two three", prose(60) + "\n" + passage, passage + "\n" + prose(70), prose(30_000), passage, "don't 12 ½ 日本 <|endoftext|>\r\n\r\n x", "x" * 50_000, "a b " * 200, "#$% " * 80 + "\n" + "|| " * 60]
    rows = [(i, t, "en", f"s{i % 3}" if i % 5 else None, None if i % 4 == 0 else 7, "h", i, "z", "q", i, None, "w", 3) for i, t in enumerate(texts)]
    rows += [rows[1], rows[1], rows[0], (None, base, None, None, None, None, None, None, None, None, None, None, None), (None, None, None, "s0", 1, None, None, None, None, None, None, None, None), (3, base, "de", "s1", 1, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, COLUMNS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], COLUMNS)
