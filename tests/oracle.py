"""Rows of a Spark query and of its SQL in DuckDB, in a form that can be compared."""

from pathlib import Path

import duckdb


def views(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if v != v else repr(v)
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return str(v)


KINDS = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "float": "FLOAT", "smallint": "SMALLINT", "date": "DATE"}


def kind(name: str) -> str:
    return kind(name[6:-1]) + "[]" if name.startswith("array<") else KINDS.get(name, name)


def compare(spark_df, con, sql: str) -> str:
    """Empty if columns, types and rows agree."""
    rel = con.sql(sql)
    want = dict(zip(rel.columns, map(str, rel.types), strict=True))
    got = {n: kind(k) for n, k in spark_df.dtypes}
    if got != want:
        return f"schema: {got} against {want}"
    names = sorted(got)
    a = sorted(([plain(r[n]) for n in names] for r in spark_df.collect()), key=repr)
    order = [rel.columns.index(n) for n in names]
    b = sorted(([plain(r[i]) for i in order] for r in rel.fetchall()), key=repr)
    if a != b:
        odd = next(((x, y) for x, y in zip(a, b) if x != y), None)
        return f"rows: {len(a)} against {len(b)}; first difference {odd}"
    return ""
