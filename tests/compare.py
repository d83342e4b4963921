"""Holds a query's rows against its SQL twin's, as the driver does: columns by name, rows in any order."""

import datetime
import math
import os

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


def plain(x):
    if isinstance(x, bool) or x is None or isinstance(x, str):
        return x
    if isinstance(x, (int, float)) or type(x).__name__ == "Decimal":
        x = float(x)
        return "nan" if math.isnan(x) else round(x, 5) + 0.0
    return str(x) if isinstance(x, (datetime.date, datetime.datetime)) else [plain(y) for y in x]


def differences(df, con, sql: str, show: int = 3) -> str:
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    order = sorted(names)
    want = sorted(([plain(r[names.index(c)]) for c in order] for r in cur.fetchall()), key=str)
    got = sorted(([plain(r[c]) for c in order] for r in df.collect()), key=str)
    if got == want:
        return "" if got else "no rows"
    a, b = {str(x) for x in got}, {str(x) for x in want}
    return f"{len(got)} and {len(want)} rows; ours only {sorted(a - b)[:show]}; SQL only {sorted(b - a)[:show]}"
