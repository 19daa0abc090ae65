from __future__ import annotations

import pytest

from tallyflow.session import stage_path

# Columns that operators use inside; a table may have them too.
CLASHES = ("row", "size", "name", "label", "part", "n", "score", "tokens", "key", "kept", "copies", "chunk", "block")
BASE = "doc_id long, text string, lang string, source string, n_chars long"
SCHEMA = BASE + "".join(f", {c} string" for c in CLASHES)


@pytest.fixture(scope="session")
def table(spark):
    """Makes a written table of documents with clashing extra columns from (doc_id, text, source)."""

    def make(rows):
        full = [(i, t, None, s, None, *["x"] * len(CLASHES)) for i, t, s in rows]
        path = stage_path(spark, "test-documents")
        spark.createDataFrame(full, SCHEMA).repartition(3).write.parquet(path)
        return spark.read.parquet(path)

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and blank texts, repeated rows and keys, ties, long and foreign texts."""
    base = " ".join(f"w{i}" for i in range(300))
    near = " ".join(f"w{i}" if i % 60 else "other" for i in range(300))
    far = " ".join(f"w{i}" if i % 9 else "other" for i in range(300))
    long = " ".join(f"v{i % 7001}" for i in range(40_000))
    return [
        (None, None, None), (None, "", "s1"), (1, None, "s1"), (2, "", None), (3, " \t\n\x0b\f\r ", "s2"),
        (4, base, "s1"), (5, base.upper(), "s2"), (5, base.upper(), "s2"), (6, near, "s1"), (7, far, "s1"),
        (8, "two words", "s1"), (9, "Two Words", "s3"), (10, "two words more here", "s3"), (None, base, "s1"),
        (11, long, "s2"), (12, long + " end", "s2"), (13, "Ünï ñandú   日本語 🙂 x\u0085y", "s2"), (13, "another text", "s1"),
        (14, "a a a a a a a a a a\na a\n\na a\na b", "s1"), (15, base + " " + base, "s2"), (16, base[:200] + "\n" + near[300:], "s1"),
    ]
