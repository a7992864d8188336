"""Compare registered queries with their SQL: python tests/check.py [name ...] [--sf 0.01]"""

import sys
import time
import traceback
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from oracle import connect, differences  # noqa: E402

from palaver.plans.catalogue import ORACLES, QUERIES  # noqa: E402
from palaver.session import local_session  # noqa: E402

args = [a for a in sys.argv[1:] if not a.startswith("--")]
sf = next((a.split("=")[1] for a in sys.argv[1:] if a.startswith("--sf=")), "0.01")
folder = f"/root/testdata/sf{sf}"
spark = local_session("8")
spark.sparkContext.setLogLevel("ERROR")
con = connect(folder)
names = [n for n in QUERIES if not args or n in args or any(a.endswith("*") and n.startswith(a[:-1]) for a in args)]
bad = 0
for name in names:
    start = time.time()
    try:
        df = QUERIES[name](spark, folder)
        if name in ORACLES:
            problems = differences(df, con, ORACLES[name])
            n = ""
        else:
            n = f" rows-only {len(df.collect())}"
            problems = []
    except Exception as error:  # noqa: BLE001
        problems, n = [f"{type(error).__name__}: {str(error)[:700]}"], ""
        if "--trace" in sys.argv:
            traceback.print_exc()
    bad += bool(problems)
    print(f"{'FAIL' if problems else 'ok  '} {name} {time.time() - start:.1f}s{n}", *problems, sep="\n     " if problems else " ", flush=True)
print(f"{len(names)} queries, {bad} failed")
