"""Compare a Spark result with a DuckDB result, ignoring row and column order."""

from __future__ import annotations

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark"
    " labels conversations"
).split()


def duckdb_rows(sql: str, sf_dir: str):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    cursor = con.execute(sql)
    names = [c[0] for c in cursor.description]
    types = [str(c[1]) for c in cursor.description]
    return names, types, cursor.fetchall()


def _sorted(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    plain = [tuple(row[i] for i in order) for row in rows]
    return sorted(plain, key=lambda r: tuple((v is None, str(type(v)), v if v is not None else 0) for v in r))


def difference(df, sql: str, sf_dir: str) -> str | None:
    """What differs, or None."""
    names, types, expected = duckdb_rows(sql, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    spark_types = dict(df.dtypes)
    wanted = {"BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "DOUBLE": "double", "BOOLEAN": "boolean"}
    for name, kind in zip(names, types):
        if wanted.get(kind) != spark_types[name]:
            return f"type of {name}: {spark_types[name]} != {kind}"
    got, want = _sorted(df.columns, rows), _sorted(names, expected)
    if len(got) != len(want):
        return f"{len(got)} rows, expected {len(want)}"
    for a, b in zip(got, want):
        if a != b:
            return f"first difference: {a} != {b}"
    return None
