import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long"
#: A text beyond any batch size that still runs fast.
LONG = ("lorem ipsum dolor sit amet " * 8000).strip()


@pytest.fixture
def make_docs(spark):
    """Documents of (doc_id, text[, source]) rows, optionally with columns whose names the operators use inside."""

    def make(rows, extra=False):
        df = spark.createDataFrame([(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows], DOC)
        if extra:
            from pyspark.sql import functions as F

            for name in ("fp", "key", "rep", "count", "copy_no", "shuffle_key", "mix_source", "cdf", "draws", "score", "toxic", "chunk", "same", "bands", "u", "v", "n"):
                df = df.withColumn(name, F.lit("clash"))
        return df

    return make


@pytest.fixture
def odd_rows():
    """Nulls, empties, white space, one word, a very long text, repeated rows and equal texts."""
    return [(1, None), (2, ""), (3, "  \t\n"), (4, "word"), (5, LONG), (6, "a b c d e f"), (6, "a b c d e f"), (7, "a b c d e f"), (None, "a b c d e f"), (8, "çé  日本   x\x1cy")]
