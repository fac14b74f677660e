"""Row-for-row comparison of a Spark result with a DuckDB result."""

from __future__ import annotations

TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "date": "DATE",
         "string": "VARCHAR"}


def assert_same(frame, relation) -> int:
    columns = list(relation.columns)
    assert sorted(frame.columns) == sorted(columns)
    ours = {name: TYPES[kind] for name, kind in frame.dtypes}
    theirs = {name: str(kind) for name, kind in zip(columns, relation.types)}
    assert ours == theirs
    order = sorted(columns)
    found = sorted(repr(tuple(r)) for r in frame.select(*order).collect())
    at = [columns.index(c) for c in order]
    wanted = sorted(repr(tuple(r[i] for i in at)) for r in relation.fetchall())
    assert len(found) == len(wanted)
    assert found == wanted
    return len(found)
