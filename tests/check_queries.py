"""Command line: ``python -m tests.check_queries [sf] [name ...]`` compares queries with their SQL."""

from __future__ import annotations

import sys
import time

from __spark_entry__ import oracle_sql, queries
from tests.oracle import compare, connect
from tests.conftest import build_session


def main(scale: str, names: list[str]) -> int:
    root = f"/root/testdata/sf{scale}"
    spark, con, bad = build_session(), connect(root), 0
    everything, sql = queries(), oracle_sql()
    for name in everything:
        if names and not any(n == name or (n.endswith("*") and name.startswith(n[:-1])) for n in names):
            continue
        started = time.time()
        try:
            rows, problem = compare(everything[name](spark, root), con, sql.get(name))
        except Exception as error:  # report and go on with the next one
            rows, problem = 0, f"{type(error).__name__}: {str(error)[:900]}"
        bad += problem is not None
        mark = "ok " if problem is None else "BAD"
        print(f"{mark} {name:28s} {rows:7d} rows {time.time() - started:6.2f}s {'' if name in sql else '(rows only)'}", flush=True)
        if problem:
            print("    ", problem[:1500], flush=True)
    print(f"{bad} problems")
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1] if len(sys.argv) > 1 else "0.001", sys.argv[2:]) > 0)
