"""Run registered queries in Spark and their oracle SQL in DuckDB; compare.

Usage: ``python tests/oracle_harness.py [sf_dir] [name-prefix ...]``.
Rows are compared order-insensitively; floats to 9 significant digits.
"""

from __future__ import annotations

import math
import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


STRICT = os.environ.get("ORACLE_STRICT") == "1"  # compare floats bit-exactly


def _norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        if STRICT:
            return v + 0.0  # -0.0 == 0.0
        return float(f"{v:.9g}")
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    return v


def canon(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda r: tuple((x is None, str(x)) for x in r))


def _spark_cat(dt) -> str:
    n = type(dt).__name__
    if n in ("ByteType", "ShortType", "IntegerType", "LongType"):
        return "int"
    if n in ("FloatType", "DoubleType"):
        return "float"
    if n == "DecimalType":
        return "decimal"
    if n == "ArrayType":
        return "list<" + _spark_cat(dt.elementType) + ">"
    return {"StringType": "string", "BooleanType": "bool", "StructType": "struct"}.get(n, n)


def _duck_cat(t: str) -> str:
    t = str(t).upper()
    if t.endswith("[]"):
        return "list<" + _duck_cat(t[:-2]) + ">"
    if t in ("TINYINT", "SMALLINT", "INTEGER", "BIGINT", "HUGEINT", "UTINYINT", "USMALLINT", "UINTEGER", "UBIGINT"):
        return "int"
    if t in ("FLOAT", "DOUBLE"):
        return "float"
    if t.startswith("DECIMAL"):
        return "decimal"
    if t == "VARCHAR":
        return "string"
    if t == "BOOLEAN":
        return "bool"
    if t.startswith("STRUCT"):
        return "struct"
    return t


def compare(spark, con, sf_dir: str, name: str, query, sql: str | None):
    t0 = time.time()
    df = query(spark, sf_dir)
    spark_cols = df.columns
    spark_rows = [tuple(r) for r in df.collect()]
    t1 = time.time()
    if sql is None:
        return dict(name=name, ok=None, rows=len(spark_rows), spark_s=round(t1 - t0, 2))
    res = con.execute(sql)
    duck_cols = [d[0] for d in res.description]
    duck_types = {d[0]: _duck_cat(d[1]) for d in res.description}
    spark_types = {f.name: _spark_cat(f.dataType) for f in df.schema.fields}
    duck_rows = res.fetchall()
    t2 = time.time()
    info = dict(name=name, rows=len(spark_rows), oracle_rows=len(duck_rows),
                spark_s=round(t1 - t0, 2), duck_s=round(t2 - t1, 2))
    if sorted(spark_cols) != sorted(duck_cols):
        return dict(info, ok=False, why=f"columns {spark_cols} vs {duck_cols}")
    bad_types = {c: (spark_types[c], duck_types[c]) for c in spark_cols
                 if c in duck_types and spark_types[c] != duck_types[c]}
    if bad_types:
        info["type_mismatch"] = bad_types
    a = canon(spark_rows, spark_cols)
    b = canon(duck_rows, duck_cols)
    if a != b:
        diff = [x for x in a if x not in set(b)][:3]
        diff2 = [x for x in b if x not in set(a)][:3]
        return dict(info, ok=False, why=f"values differ: spark-only {diff} duck-only {diff2}",
                    cols=sorted(spark_cols))
    return dict(info, ok=True)


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    prefixes = argv[2:]
    import __spark_entry__ as E
    from labelforge.session import get_spark

    spark = get_spark()
    con = duck(sf_dir)
    qs, os_ = E.queries(), E.oracle_sql()
    bad = 0
    for name, q in qs.items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        try:
            r = compare(spark, con, sf_dir, name, q, os_.get(name))
        except Exception as e:  # report and go on
            r = dict(name=name, ok=False, why=f"{type(e).__name__}: {str(e)[:400]}")
        if r.get("ok") is False:
            bad += 1
        print(r, flush=True)
    print(f"FAILED: {bad}")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv) else 0)
