import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    def make(rows, extra=False):
        full = [(i, t, lang, src, None if t is None else len(t)) for i, t, lang, src in (r if len(r) == 4 else (*r, "en", "s") for r in rows)]
        df = spark.createDataFrame(full, DOCS).repartition(3)
        if extra:  # columns whose names operators use themselves
            from pyspark.sql import functions as F

            df = df.withColumns({c: F.lit(7) for c in ("size", "target", "taken", "digest", "keep_id", "n", "node", "block", "word", "rank", "_digest", "_key", "_size", "_copy") if c not in df.columns})
        return df

    return make


#: Nulls, empty and short texts, ties, repeated rows, null ids, odd letters.
ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, "one two"), (5, "one two"), (None, "one two"), (None, None), (6, "a" * 5000), (7, "ümläut ☃ 漢字 \x00 x"), (8, "word " * 3000)]
