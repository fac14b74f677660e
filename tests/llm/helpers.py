"""Small tables with every odd case, and comparison of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = "documents embeddings pages benchmark labels conversations".split()
#: Columns that operators use inside, as extra columns of their input.
CLASHING = "spans string, items string, n_words string, ids string, decoded string, score string, " \
    "cell string, value string, set_id string, key string, kinds_ string, n string"


def documents(spark: SparkSession, rows: list[tuple], extra: bool = True) -> DataFrame:
    """(doc_id, text) rows as documents, with extra columns whose names clash."""
    names = [c.split()[0] for c in CLASHING.split(", ")] if extra else []
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    data = [
        (i, t, "en", f"src{(i or 0) % 3}", None if t is None else len(t), *["x"] * len(names)) for i, t in rows
    ]
    return spark.createDataFrame(data, schema + (", " + CLASHING if extra else ""))


def sorted_rows(frame: DataFrame, *columns: str) -> list[tuple]:
    return sorted(map(tuple, frame.select(*columns).collect()), key=repr)


def assert_same(frame: DataFrame, relation) -> int:
    columns = sorted(relation.columns)
    assert sorted(frame.columns) == columns
    ours = sorted_rows(frame, *columns)
    at = [list(relation.columns).index(c) for c in columns]
    theirs = sorted((tuple(r[i] for i in at) for r in relation.fetchall()), key=repr)
    assert ours == theirs
    return len(ours)
