"""What tests share: rows in a fixed order, and comparison with DuckDB SQL."""

import os

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SF = "/root/testdata/sf0.001"


def rows(df) -> list[tuple]:
    """All rows as tuples, sorted by what they look like."""
    return sorted((tuple(r) for r in df.collect()), key=repr)


def plain(v):
    """A value of either engine in one form."""
    if v is None or v != v:
        return None
    if isinstance(v, (bytes, bytearray)):
        return bytes(v).hex()
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    if isinstance(v, float):
        return round(v, 9)
    return v


def same(df, sql: str, sf_dir: str) -> None:
    """Holds a DataFrame against DuckDB SQL over the same tables, columns by name."""
    import duckdb

    con = duckdb.connect()
    for t in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{t}'")
    found = con.execute(sql)
    names = [x[0] for x in found.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    expected = sorted(repr([plain(r[names.index(c)]) for c in order]) for r in found.fetchall())
    got = sorted(repr([plain(r[c]) for c in order]) for r in df.collect())
    assert got == expected
