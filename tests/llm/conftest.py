from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text[, lang[, source]]), with columns whose names operators use inside."""

    def build(rows, extra=True):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(full, SCHEMA)
        if extra:
            for name in ("size", "label", "node", "key", "h", "hits", "score", "row", "n", "rank", "grp"):
                df = df.selectExpr("*", f"'x' AS {name}")
        return df

    return build


@pytest.fixture(scope="session")
def odd(make):
    """Null and empty texts, null ids and sources, repeated rows, one very long text, ties."""
    long_text = " ".join(f"word{i % 997}" for i in range(60_000))
    return make(
        [
            (1, None), (2, ""), (3, "   \n\t "), (4, "one two"), (None, "a text without an id that is long enough to have shingles of its own", None, None),
            (5, long_text), (6, "same row here"), (6, "same row here"), (7, "Same Row here", None), (8, "12345 !!! ???"), (9, "é è ê ñ ü"), (10, "\n\n\n"), (11, "x" * 5000),
        ]
    )


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.limit(0)
