"""Command line client of a store: ``python -m tidemark.cli --root DIR put KEY VALUE | get KEY | delete KEY | status``.

Exit codes: 0 done or found, 1 not found, 2 an error, whose text goes to standard error.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from tidemark.functions.kv import MEMTABLE_LIMIT
from tidemark.operators.consistency import Consistency, NotLeader
from tidemark.plans.store import KVStore
from tidemark.session import get_session


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tidemark")
    p.add_argument("--root", required=True, help="folder of the store")
    sub = p.add_subparsers(dest="command", required=True)
    put = sub.add_parser("put", help="write one value")
    put.add_argument("key")
    put.add_argument("value")
    get = sub.add_parser("get", help="read one value")
    get.add_argument("key")
    get.add_argument("--consistency", default="STRONG", help="STRONG, FAST or EVENTUAL, in any case")
    get.add_argument("--node", help="replica to ask; the leader by default")
    sub.add_parser("delete", help="remove one key").add_argument("key")
    sub.add_parser("status", help="runs, memtable and committed position")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """Run one command; a session may be passed in, else a local one is made."""
    a = _parser().parse_args(argv)
    try:
        level = Consistency.parse(a.consistency) if a.command == "get" else None
        spark = spark or get_session("tidemark-cli")
        store = KVStore(spark, a.root, memtable_limit=MEMTABLE_LIMIT)
        if a.command == "put":
            store.put(spark.createDataFrame([(a.key, a.value)], "k string, v string"))
            print("OK")
        elif a.command == "delete":
            store.delete(spark.createDataFrame([(a.key,)], "k string"))
            print("OK")
        elif a.command == "get":
            row = store.get_one(a.key, level, a.node).first()
            print(row["v"] if row["found"] else "not found")
            return 0 if row["found"] else 1
        else:
            m = store.manifest.load()
            held = m.get("memtable", [])
            print(f"version {m['version']}, {len(m['runs'])} runs, {len(held)} memtable batches of {sum(x['n_bytes'] for x in held)} bytes, committed {store.commit_seq()}")
    except (ValueError, NotLeader, RuntimeError, KeyError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
