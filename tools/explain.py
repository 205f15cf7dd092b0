"""Print the physical plan of registered queries: python tools/explain.py name ... [--sf 0.01]"""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from placewise import checks  # noqa: E402
from placewise.session import build_session  # noqa: E402

parser = argparse.ArgumentParser()
parser.add_argument("names", nargs="+")
parser.add_argument("--sf", default="0.01")
parser.add_argument("--mode", default="simple")
args = parser.parse_args()
spark = build_session("local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false"})
spark.sparkContext.setLogLevel("ERROR")
checks.load_all()
for name in args.names:
    print("=====", name)
    checks.QUERIES[name](spark, f"/root/testdata/sf{args.sf}").explain(args.mode)
