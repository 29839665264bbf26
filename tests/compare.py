"""Compare registered queries with their SQL answers: ``python tests/compare.py DIR [name …]``."""
import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark"
          " labels conversations").split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.12g}")
    if isinstance(value, int):
        return float(value) if abs(value) < 2**53 else value
    if type(value).__name__ == "Decimal":
        return float(value)
    return value


def spark_rows(df):
    names = sorted(df.columns)
    return names, Counter(tuple(_norm(r[n]) for n in names) for r in df.collect())


def duck_rows(con, sql):
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), Counter(tuple(_norm(r[i]) for i in order) for r in cur.fetchall())


def difference(spark, con, fn, sql, sf_dir):
    """None when both sides agree, else a short description."""
    got_names, got = spark_rows(fn(spark, sf_dir))
    want_names, want = duck_rows(con, sql)
    if got_names != want_names:
        return f"columns {got_names} vs {want_names}"
    if got != want:
        missing, extra = want - got, got - want
        return (f"{sum(got.values())} vs {sum(want.values())} rows; {sum(missing.values())} missing e.g."
                f" {list(missing)[:2]}; {sum(extra.values())} extra e.g. {list(extra)[:2]}")
    return None if sum(got.values()) else "both sides are empty"


def main(argv):
    import __spark_entry__ as contract
    from spendledger.session import local_session

    spark = local_session("compare", cores="8")
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir, names = argv[0], argv[1:]
    con, bad = connect(sf_dir), 0
    for name, fn in contract.queries().items():
        if names and name not in names:
            continue
        sql, start = contract.oracle_sql().get(name), time.time()
        try:
            problem = difference(spark, con, fn, sql, sf_dir) if sql else f"rows only: {fn(spark, sf_dir).count()}"
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        bad += bool(problem) and bool(sql)
        print(f"{'ok  ' if not problem else 'DIFF' if sql else 'rows'} {name} {time.time() - start:.1f}s {problem or ''}",
              flush=True)
    print("differences:", bad)


if __name__ == "__main__":
    main(sys.argv[1:])
