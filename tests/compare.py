"""Compare a Spark result with DuckDB's on the same tables, order aside."""

from __future__ import annotations

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
SAME_TYPE = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE", "boolean": "BOOLEAN",
    "timestamp_ntz": "TIMESTAMP",
}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def differences(df, con, sql: str, limit: int = 3) -> list[str]:
    """Empty when columns, types and rows agree exactly."""
    cursor = con.execute(sql)
    oracle_types = {d[0]: str(d[1]) for d in cursor.description}
    spark_types = {f.name: SAME_TYPE.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in df.schema.fields}
    out = []
    if oracle_types != spark_types:
        wrong = {c for c in oracle_types.keys() | spark_types.keys() if oracle_types.get(c) != spark_types.get(c)}
        out.append("types: " + ", ".join(f"{c}: spark {spark_types.get(c)} oracle {oracle_types.get(c)}" for c in sorted(wrong)))
        if set(oracle_types) != set(spark_types):
            return out
    names = sorted(spark_types)
    place = {d[0]: k for k, d in enumerate(cursor.description)}
    oracle_rows = sorted(([row[place[c]] for c in names] for row in cursor.fetchall()), key=repr)
    table = df.select(*[f"`{c}`" for c in names]).toArrow().to_pydict()
    spark_rows = sorted(map(list, zip(*[table[c] for c in names])), key=repr)
    if len(oracle_rows) != len(spark_rows):
        out.append(f"rows: spark {len(spark_rows)} oracle {len(oracle_rows)}")
    bad = [(a, b) for a, b in zip(spark_rows, oracle_rows) if a != b]
    if bad:
        out.append(f"{len(bad)} rows differ; {names}")
        out += [f"spark {a} | oracle {b}" for a, b in bad[:limit]]
    return out
