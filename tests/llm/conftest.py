import pytest

ODD_TEXTS = [
    None, "", " ", "\n\t\v", "a", "A b", "the SAME row twice", "the SAME row twice",
    "İstanbul ǅ ΑΣ 數字 ١٢ é é 😀👍🏽  nbsp em", "x" * 5000, "word " * 3000, "don't we'll 'twas i'm i'd '", "12345 67,8.9 a1b2 <|endoftext|> tail<|endoftext|>",
    "\x00nul\x1f\x7f", "idiot! You are a stupid moron.", "ab" * 700 + " " + "ab" * 700,
]


@pytest.fixture
def odd(spark):
    """Documents with nulls, empty and long texts, repeats and columns whose names could clash."""
    rows = [(i, t, "en" if i % 2 else None, None, 1, "x", 0.5) for i, t in enumerate(ODD_TEXTS)] + [(3, "same id again", "de", "s", None, "y", None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, hash string, score double")
