"""python tests/check.py [sf] [name-part ...]: compare registered queries with their SQL twins.

With PLANS=1 it also names plan nodes worth a look.
"""

from __future__ import annotations

import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import __spark_entry__ as entry_module  # noqa: E402
from oracle import compare, connect  # noqa: E402

from tablewright.session import build_session, clear_scratch  # noqa: E402


def main(sf: str, parts: list[str]) -> int:
    sf_dir = f"/root/testdata/sf{sf}"
    spark = build_session(
        master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    oracles = entry_module.oracle_sql()
    failed, started = [], time.time()
    for name, run in entry_module.queries().items():
        if parts and not any(p in name for p in parts):
            continue
        t = time.time()
        try:
            df = run(spark, sf_dir)
            if os.environ.get("PLANS"):
                plan = df._jdf.queryExecution().executedPlan().toString()
                found = [w for w in ("CartesianProduct", "BroadcastNestedLoopJoin", "SinglePartition", "ArrowEvalPython", "BatchEvalPython") if w in plan]
                if found:
                    print(f"plan {name}: {found}")
            if name in oracles:
                problem = compare(df, con, oracles[name])
                note = "" if problem is None else problem
            else:
                problem, note = None, f"rows only: {len(df.collect())}"
        except Exception as e:
            problem = note = f"{type(e).__name__}: {str(e)[:600]}"
            if os.environ.get("TRACE"):
                traceback.print_exc()
        if problem:
            failed.append(name)
        print(f"{'FAIL' if problem else 'ok  '} {time.time() - t:6.2f}s {name} {note}", flush=True)
    clear_scratch(spark)
    print(f"{len(failed)} failed in {time.time() - started:.0f}s: {failed}")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1] if len(sys.argv) > 1 else "0.01", sys.argv[2:]))
