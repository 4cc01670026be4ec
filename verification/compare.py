"""Run the registered queries in Spark and their SQL in DuckDB and compare: python -m verification.compare [sf_dir] [names]"""

from __future__ import annotations

import sys
import time

import duckdb
import pandas as pd

from verification.oracles import ORACLES
from verification.queries import QUERIES

TABLES = ("documents", "labels", "embeddings", "conversations", "benchmark", "pages")
TYPES = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "int": "INTEGER", "boolean": "BOOLEAN"}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def canonical(frame: pd.DataFrame) -> list[str]:
    """Rows as sorted texts, columns by name."""
    frame = frame[sorted(frame.columns)]
    rows = frame.astype(object).where(frame.notna(), None).itertuples(index=False, name=None)
    return sorted(repr(tuple(float(v) + 0.0 if isinstance(v, float) else v for v in row)) for row in rows)


def compare(spark, connection, sf_dir: str, name: str) -> str:
    """'' if equal, else what differs."""
    started = time.time()
    df = QUERIES[name](spark, sf_dir)
    got = df.toPandas()
    spark_seconds = time.time() - started
    if name not in ORACLES:
        return f"rows only ({len(got)} rows, {spark_seconds:.2f}s)" if len(got) else "no rows"
    relation = connection.sql(ORACLES[name])
    expected_types = dict(zip(relation.columns, map(str, relation.types)))
    got_types = {c: TYPES.get(t, t) for c, t in df.dtypes}
    if got_types != expected_types:
        return f"DIFFERENT schema: {got_types} / {expected_types}"
    got_rows, expected_rows = canonical(got), canonical(relation.df())
    if got_rows == expected_rows:
        return f"equal ({len(got)} rows, {spark_seconds:.2f}s)"
    wrong = sorted(set(got_rows) ^ set(expected_rows))
    sample = "\n   ".join(row[:300] for row in wrong[:4])
    return f"DIFFERENT: {len(got_rows)} / {len(expected_rows)} rows, {len(wrong)} differ\n   {sample}"


def main() -> int:
    from staycoder.session import build_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session(master="local[8]", conf={"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    connection = connect(sf_dir)
    failed = 0
    for name in sys.argv[2:] or QUERIES:
        try:
            result = compare(spark, connection, sf_dir, name)
        except Exception as error:  # report and go on
            result = f"FAILED: {str(error)[:800]}"
        failed += result.startswith(("DIFFERENT", "FAILED", "no rows"))
        print(f"{name}: {result}", flush=True)
    print(f"{failed} not equal")
    return failed


if __name__ == "__main__":
    sys.exit(main())
