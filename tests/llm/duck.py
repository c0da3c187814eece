import glob
import os

import duckdb


def same_rows(df, sql, sf):
    """Whether a Spark result and a SQL query over the same tables have equal rows."""
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    out = con.execute(sql)
    names = sorted(c[0] for c in out.description)
    rows = [dict(zip([c[0] for c in out.description], r)) for r in out.fetchall()]
    assert names == sorted(df.columns)
    key = lambda r: tuple(repr(r[c]) for c in names)
    assert sorted(map(key, rows)) == sorted(key(r.asDict()) for r in df.collect())
