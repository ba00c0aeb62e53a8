"""Run registered queries against their SQL in DuckDB: python -m tests.compare [-d sf_dir] [name-prefix ...]"""

from __future__ import annotations

import math
import sys
import time
import traceback

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


SPENT: dict[str, float] = {}


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "NaN"
        return float(f"{v:.9g}") + 0.0
    return v


def _key(row):
    return tuple((v is None, str(type(v)), str(v)) for v in row)


def check(spark, con, name, sf_dir, queries, oracles):
    """None when equal, else a description of the difference."""
    begun = time.time()
    df = queries[name](spark, sf_dir)
    cols = sorted(df.columns)
    got = [tuple(_norm(v) for v in row) for row in df.select(*[f"`{c}`" for c in cols]).collect()]
    SPENT[name] = time.time() - begun
    if name not in oracles:
        return None if got else "no rows"
    rel = con.sql(oracles[name])
    names = list(rel.columns)
    kinds = dict(zip(names, [str(t) for t in rel.types], strict=True))
    if sorted(names) != cols:
        return f"columns {cols} vs {sorted(names)}"
    want_kind = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    bad = {c: (t, kinds[c]) for c, t in df.dtypes if want_kind.get(t) != kinds[c]}
    if bad:
        return f"types {bad}"
    idx = [names.index(c) for c in cols]
    want = [tuple(_norm(row[i]) for i in idx) for row in rel.fetchall()]
    got.sort(key=_key)
    want.sort(key=_key)
    if got == want:
        return None if got else "both empty"
    a, b = set(map(str, got)), set(map(str, want))
    return (
        f"{cols}\n rows {len(got)} vs {len(want)}; only spark {len(a - b)}: {sorted(a - b)[:3]}\n"
        f"                 only sql {len(b - a)}: {sorted(b - a)[:3]}"
    )


def main(argv):
    sys.path.insert(0, "/root/repo")
    from __spark_entry__ import oracle_sql, queries
    from rubrica.session import get_session

    sf_dir = "/root/testdata/sf0.001"
    if argv and argv[0] == "-d":
        sf_dir, argv = argv[1], argv[2:]
    spark = get_session(
        "compare", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "16g"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, q, o = connect(sf_dir), queries(), oracle_sql()
    failed = 0
    for name in q:
        if argv and not any(name.startswith(p) for p in argv):
            continue
        t = time.time()
        try:
            res = check(spark, con, name, sf_dir, q, o)
        except Exception as exc:
            res = f"{type(exc).__name__}: {str(exc)[:1500]}"
            if "-v" in sys.argv:
                traceback.print_exc()
        tag = "ok  " if res is None else "FAIL"
        failed += res is not None
        print(f"{tag} {name} {SPENT.get(name, 0):.1f}s of {time.time() - t:.1f}s {'(rows only)' if name not in o else ''} {res or ''}", flush=True)
    print("failed", failed)
    return failed


if __name__ == "__main__":
    sys.exit(bool(main(sys.argv[1:])))
