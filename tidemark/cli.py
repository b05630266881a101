"""Command line: search a store, or show its counts.

    python -m tidemark.cli STORE [--dossier ID] [--search QUERY | --stats | --overview] [--limit N]
"""

from __future__ import annotations

import argparse
import time

from pyspark.sql import SparkSession

from .operators.tables import Store


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(description="Search a content store or show its counts.")
    p.add_argument("store")
    p.add_argument("--dossier")
    p.add_argument("--search")
    p.add_argument("--stats", action="store_true")
    p.add_argument("--overview", action="store_true")
    p.add_argument("--limit", type=int, default=20)
    a = p.parse_args(args)
    store = Store(SparkSession.builder.getOrCreate(), a.store, a.dossier)
    if a.search:
        store.search(a.search, int(time.time() * 1000), a.limit).show(a.limit, truncate=80)
    elif a.overview:
        store.overview().show(a.limit)
    else:
        store.stats().show()
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
