"""Print the formatted physical plan of registered queries.

Usage: python tools/explain.py [--sf DIR] name [name ...]
"""

from __future__ import annotations

import argparse
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def main() -> None:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("names", nargs="+")
    a = ap.parse_args()
    from vendorlytics import registry
    from vendorlytics.session import get_session
    spark = get_session("local[8]", 8)
    qs = registry.queries()
    for n in a.names:
        print(f"==== {n}")
        qs[n](spark, a.sf).explain("formatted")
    spark.stop()


if __name__ == "__main__":
    main()
