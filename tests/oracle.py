"""Run catalog queries next to their SQL twins: python -m tests.oracle [dir] [name ...]"""

import datetime
import math
import sys
import time

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def connect(sf_dir: str):
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def cell(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return repr(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return f"{type(v).__name__}:{v}"


def normal(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(cell(row[i]) for i in order) for row in rows)


def compare(spark, con, sf_dir, name, fn, sql):
    t = time.time()
    df = fn(spark, sf_dir)
    rows = [tuple(x) for x in df.collect()]
    spent = time.time() - t
    if sql is None:
        return len(rows), None, spent, ""
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = normal(names, cur.fetchall())
    got = normal(df.columns, rows)
    note = ""
    if sorted(names) != sorted(df.columns):
        note = f"columns {sorted(df.columns)} != {sorted(names)}"
    elif got != want:
        gs, ws = set(got), set(want)
        note = f"{sorted(names)}\n   spark-only {sorted(gs - ws)[:2]}\n   sql-only   {sorted(ws - gs)[:2]}"
    return len(rows), not note and len(got) == len(want), spent, note or ("" if len(got) == len(want) else f"{len(got)} != {len(want)}")


def main(argv):
    import __spark_entry__ as e
    from hourlake.session import get_session

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    spark = get_session("oracle", "local[8]", **{
        "spark.sql.shuffle.partitions": 8, "spark.ui.enabled": "false", "spark.driver.memory": "12g",
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con, q, o = connect(sf_dir), e.queries(), e.oracle_sql()
    chosen = [n for n in q if not argv[1:] or any(n.startswith(a) for a in argv[1:])]
    bad = 0
    for n in chosen:
        try:
            rows, ok, spent, note = compare(spark, con, sf_dir, n, q[n], o.get(n))
        except Exception as x:  # noqa: BLE001
            rows, ok, spent, note = -1, False, 0.0, f"{type(x).__name__}: {str(x)[:600]}"
        bad += ok is False
        if ok is not True or rows == 0:
            print(f"{'rows-only' if ok is None else 'ok' if ok else 'BAD'} {n} rows={rows} {spent:.1f}s {note}", flush=True)
    print(f"{len(chosen)} queries, {sum(n in o for n in chosen)} with SQL, {bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
