"""Print the formatted physical plan of registered queries.

    python tools/explain.py churn_table [more keys] [--sf /root/testdata/sf0.01]
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from cohortlens.plans import catalog  # noqa: E402
from cohortlens.session import build_session  # noqa: E402


def main(argv):
    sf_dir = "/root/testdata/sf0.01"
    if "--sf" in argv:
        i = argv.index("--sf")
        sf_dir = argv[i + 1]
        argv = argv[:i] + argv[i + 2:]
    spark = build_session("local[8]", 8)
    for key in argv[1:]:
        print(f"==== {key} ({sf_dir})")
        catalog.queries()[key](spark, sf_dir).explain("formatted")
    spark.stop()


if __name__ == "__main__":
    main(sys.argv)
