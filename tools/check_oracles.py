"""Run registered queries against their DuckDB oracles (local stand-in for the driver gate).

usage: python tools/check_oracles.py [sf_dir] [name-substring ...]
"""
import sys
import time

sys.path.insert(0, "/root/repo")
sys.path.insert(0, "/root/repo/tests")

from harness import compare, duck_connect, type_mismatches  # noqa: E402

from airshed.plans.registry import DOUBLES, ORACLES, QUERIES, load_all  # noqa: E402
from airshed.session import build_session  # noqa: E402


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    pats = sys.argv[2:]
    load_all()
    spark = build_session("local[8]")
    con = duck_connect(sf)
    ok_n = bad_n = 0
    for name, fn in QUERIES.items():
        if pats and not any(p in name for p in pats):
            continue
        t = time.time()
        try:
            df = fn(spark, sf)
            if name in ORACLES:
                ok, msg = compare(df, con, ORACLES[name])
                dtypes = dict(df.dtypes)
                missing = [c for c, t_ in dtypes.items() if t_ == "double" and c not in DOUBLES.get(name, [])]
                if missing:
                    ok, msg = False, f"double columns not rounded in oracle: {missing}; " + msg
                types = type_mismatches(df, con, ORACLES[name])
                if types:
                    ok, msg = False, f"type mismatch {types}; " + msg
            else:
                n = df.count()
                ok, msg = True, f"rows-only {n}"
        except Exception as e:  # report and continue
            ok, msg = False, f"ERROR {type(e).__name__}: {str(e)[:300]}"
        ok_n += ok
        bad_n += not ok
        print(f"{'OK ' if ok else 'BAD'} {name:28s} {time.time() - t:6.2f}s {msg}", flush=True)
    print(f"ok={ok_n} bad={bad_n}")


if __name__ == "__main__":
    main()
