import pytest

#: Columns whose names clash with ones that operators use inside.
EXTRA = ["rep", "key", "n", "h", "rank", "component", "_t", "lines", "size", "t"]


@pytest.fixture
def documents(spark):
    """documents(rows): a table of (doc_id, text[, source]) with the usual columns and clashing ones."""

    def make(rows, partitions=3):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or ""), *[7] * len(EXTRA)) for r in rows]
        shape = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} int" for c in EXTRA)
        return spark.createDataFrame(full, shape).repartition(partitions)

    return make
