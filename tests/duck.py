import glob
import os

import duckdb


def same_rows(df, sql, sf):
    """Whether a Spark result and a SQL query over the same tables have equal rows."""
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    out = con.execute(sql)
    names = [c[0] for c in out.description]
    rows = [dict(zip(names, r)) for r in out.fetchall()]
    assert sorted(names) == sorted(df.columns)
    tell = lambda v: v if isinstance(v, str) else repr(int(v)) if isinstance(v, int) else repr(v)
    key = lambda r: tuple(tell(r[c]) for c in sorted(names))
    want, got = sorted(map(key, rows)), sorted(key(r.asDict()) for r in df.collect())
    assert got == want, [x for x in zip(got, want) if x[0] != x[1]][:3]
