"""Regenerate oracle/casts.py: per key, the DuckDB result columns whose type
must be widened so both engines report BIGINT / DOUBLE."""

import os
import sys

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from oracle.queries import SQL  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()
INTS = {"TINYINT", "SMALLINT", "INTEGER", "HUGEINT", "UTINYINT", "USMALLINT", "UINTEGER", "UBIGINT"}


def main(sf="/root/testdata/sf0.01"):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    casts = {}
    for k in sorted(SQL):
        rows = con.execute(f"DESCRIBE ({SQL[k]})").fetchall()
        c = {}
        for name, typ, *_ in rows:
            if typ in INTS:
                c[name] = "BIGINT"
            elif typ.startswith("DECIMAL") or typ == "FLOAT":
                c[name] = "DOUBLE"
        if c:
            casts[k] = c
    with open(os.path.join(ROOT, "oracle", "casts.py"), "w") as f:
        f.write('"""Generated by tools/gen_casts.py: result columns widened to BIGINT / DOUBLE."""\n\n')
        f.write("CASTS = {\n")
        for k, c in casts.items():
            f.write(f"    {k!r}: {c!r},\n")
        f.write("}\n")
    print(len(casts), "keys with casts")


if __name__ == "__main__":
    main()
