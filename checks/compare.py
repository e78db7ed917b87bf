"""Runs registered queries against their SQL: python -m checks.compare FOLDER [NAME ...]"""

import glob
import os
import sys
import time

import duckdb


def oracle_connection(folder):
    con = duckdb.connect()
    for path in sorted(glob.glob(f"{folder}/*.parquet")):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _canonical(columns, rows):
    """Columns by name, rows by value; numbers exactly as they are."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cells = [tuple(None if row[i] is None else str(row[i]) for i in order) for row in rows]
    return sorted(cells, key=lambda row: tuple((v is None, v or "") for v in row))


DUCKDB_KINDS = {
    "BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string",
    "TIMESTAMP": "timestamp_ntz", "DATE": "date", "HUGEINT": "hugeint", "BOOLEAN": "boolean",
}


def difference(spark_frame, con, sql):
    """None where both agree, else what differs first."""
    expected = con.execute(sql)
    types = {d[0]: DUCKDB_KINDS.get(str(d[1]), str(d[1])) for d in expected.description}
    have = dict(spark_frame.dtypes)
    if have != types:
        odd = {k: (have.get(k), types.get(k)) for k in {*have, *types} if have.get(k) != types.get(k)}
        return f"types (ours, sql): {odd}"
    wanted = _canonical([d[0] for d in expected.description], expected.fetchall())
    rows = _canonical(spark_frame.columns, spark_frame.collect())
    if len(rows) != len(wanted):
        return f"rows: {len(rows)} and {len(wanted)}"
    for ours, theirs in zip(rows, wanted):
        if ours != theirs:
            return f"values of {sorted(have)}: {ours} and {theirs}"
    return None


def main(folder, names):
    from checks.oracle import ORACLE
    from checks.queries import QUERIES
    from fleetmeter.session import build_session

    spark = build_session(
        "compare", "local[8]", 8,
        {"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
         "spark.driver.memory": "8g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = oracle_connection(folder)
    failed = 0
    for name in names or QUERIES:
        begin = time.time()
        try:
            frame = QUERIES[name](spark, folder)
            if name in ORACLE:
                found = difference(frame, con, ORACLE[name]) or "same"
            else:
                found = f"no SQL, {frame.count()} rows"
        except Exception as error:  # report every query, then fail
            found = f"error: {str(error)[:600]}"
        failed += not (found == "same" or found.startswith("no SQL"))
        print(f"{name:34} {time.time() - begin:6.2f}s {found}", flush=True)
    print(f"{len(names or QUERIES)} queries, {failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(bool(main(sys.argv[1], sys.argv[2:])))
