"""Compare every registered query with its oracle on a data directory: ``python tests/oracle_compare.py [sf_dir] [name...]``."""

import datetime
import decimal
import os
import sys

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, float | decimal.Decimal):
        return f"{float(v):.6g}"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in data)


def compare(spark, con, name, query, oracle, sf_dir):
    """None, or what differs."""
    df = query(spark, sf_dir)
    got = rows(df.columns, df.collect())
    cur = con.execute(oracle)
    names = [d[0] for d in cur.description]
    want = rows(names, cur.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    if got != want:
        only, missing = [r for r in got if r not in want][:3] if len(got) < 3000 else got[:2], [r for r in want if r not in got][:3] if len(want) < 3000 else want[:2]
        return f"{len(got)} and {len(want)} rows; only here {only}; only there {missing}"
    return None


if __name__ == "__main__":
    import __spark_entry__ as e
    from sluice.session import session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark, con, oracles = session(cpus=int(os.environ.get("BENCH_CPUS", "4")), memory="6g"), connect(sf), e.oracle_sql()
    bad = 0
    for name, q in e.queries().items():
        if name in oracles and (len(sys.argv) < 3 or name in sys.argv[2:]):
            try:
                found = compare(spark, con, name, q, oracles[name], sf)
            except Exception as x:  # noqa: BLE001
                found = f"{type(x).__name__}: {str(x)[:600]}"
            if found:
                bad += 1
                print("DIFF", name, found, flush=True)
    print("compared", sum(n in oracles for n in e.queries()), "of", len(e.queries()), "different", bad)
