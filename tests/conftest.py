from __future__ import annotations

import contextlib
import gzip
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from tallyflow.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        app="tallyflow-tests",
        master="local[4]",
        shuffle_partitions=4,
        spark__ui__enabled="false",
        spark__driver__memory="4g",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def conf(spark):
    """Sets session options for the length of a ``with`` block."""

    @contextlib.contextmanager
    def change(**options):
        names = {k.replace("__", "."): v for k, v in options.items()}
        before = {k: spark.conf.get(k) for k in names}
        for k, v in names.items():
            spark.conf.set(k, v)
        try:
            yield
        finally:
            for k, v in before.items():
                spark.conf.set(k, v)

    return change


@pytest.fixture
def write(tmp_path):
    """Writes lines to a file below the test's folder; gzip by its name."""

    def save(name: str, *lines: str) -> str:
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        text = "\n".join(lines) + "\n"
        if name.endswith(".gz"):
            path.write_bytes(gzip.compress(text.encode()))
        else:
            path.write_text(text, encoding="utf-8")
        return str(path)

    return save


def rows(df, *columns):
    """Rows as a sorted list of tuples."""
    picked = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in picked.collect()), key=lambda r: tuple(map(str, r)))
