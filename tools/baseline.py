"""Time the SQL of the headline queries in DuckDB, single node, on the same tables:
python tools/baseline.py [sf_dir] [threads]."""

from __future__ import annotations

import glob
import json
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from bench import HEADLINE
from copyledger.registry.queries import ORACLES


def main(sf_dir: str = "/root/testdata/sf0.1", threads: str = "8") -> None:
    con = duckdb.connect(config={"threads": int(threads)})
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path).removesuffix('.parquet')} AS SELECT * FROM '{path}'")

    def run(name: str) -> float:
        start = time.perf_counter()
        con.execute(ORACLES[name]).to_arrow_table()
        return round(time.perf_counter() - start, 3)

    print(json.dumps({name: min(run(name) for _ in range(3)) for name in HEADLINE}))


if __name__ == "__main__":
    main(*sys.argv[1:])
