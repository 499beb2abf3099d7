"""Run registered queries next to their DuckDB statements and compare whole results."""

from __future__ import annotations

import sys
import time

import duckdb

# The smallest tables.
DATA = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return db


def canonical(columns: list[str], rows) -> tuple[list[str], list[str]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(repr(tuple(row[i] for i in order)) for row in rows)


def compare(spark, db, folder: str, make, sql: str) -> str | None:
    """None when equal, else what differs."""
    frame = make(spark, folder)
    ours = canonical(frame.columns, [tuple(r) for r in frame.collect()])
    cursor = db.execute(sql)
    theirs = canonical([d[0] for d in cursor.description], cursor.fetchall())
    if ours[0] != theirs[0]:
        return f"columns {ours[0]} against {theirs[0]}"
    if ours[1] != theirs[1]:
        extra, missing = sorted(set(ours[1]) - set(theirs[1])), sorted(set(theirs[1]) - set(ours[1]))
        return f"rows {len(ours[1])} against {len(theirs[1])}; ours only {[e[:300] for e in extra[:2]]}; theirs only {[m[:300] for m in missing[:2]]}"
    return None


def main(folder: str, wanted: list[str]) -> None:
    import __spark_entry__ as entry
    from trawlkit.session import build_session

    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    db, oracles, failed = connect(folder), entry.oracle_sql(), 0
    for name, make in entry.queries().items():
        if wanted and not any(w in name for w in wanted):
            continue
        began = time.time()
        try:
            if name in oracles:
                problem = compare(spark, db, folder, make, oracles[name])
            else:
                problem = None if make(spark, folder).count() else "no rows"
        except Exception as error:  # report and go on
            problem = f"{type(error).__name__}: {str(error)[:1200]}"
        failed += problem is not None
        kind = "sql" if name in oracles else "rows"
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} {kind} {time.time() - began:.2f}s {problem or ''}", flush=True)
    print(f"{failed} failed")


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])
