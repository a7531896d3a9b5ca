"""Command line: python -m tidemark ROOT COMMAND...

    python -m tidemark file:///data/store execute "QUERY cpu FROM 0 TO now LIMIT 10"
    python -m tidemark file:///data/store stream "QUERY cpu FROM 0 TO now"
    python -m tidemark file:///data/store watch cpu* host=web*      (prints changes as they come)
    python -m tidemark file:///data/store snapshots | validate NAME | restore [NAME] | prune KEEP | verify | metrics | quarantine | vacuum
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from tidemark.engine import Engine, plain_row
from tidemark.sources.store import TABLES
from tidemark.streaming import feed


def run(engine: Engine, args: argparse.Namespace, say=print) -> int:
    store, rest = engine.store, args.rest
    if args.command == "execute":
        answer = engine.execute_json(*rest)
        say(answer)
        return int(json.loads(answer)["status"] != "OK")
    if args.command == "stream":
        for row in engine.stream(*rest):
            say(json.dumps(row, default=str))
    elif args.command == "watch":
        folders = {t: f[-1] for t, f in store.current().items()}
        changes = feed.tail_all(engine.spark, store.root, folders, TABLES).filter(feed.subscription(rest[0] if rest else "", dict(x.split("=", 1) for x in rest[1:])))

        def show(batch, _):
            for row in batch.toLocalIterator():
                say(json.dumps(plain_row(row), default=str))

        writer = changes.writeStream.foreachBatch(show)
        (writer.trigger(availableNow=True) if args.once else writer).start().awaitTermination()
    elif args.command == "snapshots":
        for s in store.snapshots():
            say(json.dumps({k: s[k] for k in ("name", "seq", "parent")}))
    elif args.command == "validate":
        wrong = store.validate(rest[0])
        say(json.dumps(wrong))
        return int(bool(wrong))
    elif args.command == "restore":
        say(engine.restore(rest[0] if rest else None, args.overwrite))
    elif args.command == "prune":
        say(json.dumps(store.prune(int(rest[0]))))
    else:
        say(json.dumps({"verify": engine.verify, "metrics": engine.metrics, "quarantine": store.quarantine, "vacuum": store.vacuum}[args.command]()))
    return 0


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tidemark", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("root")
    parser.add_argument("command", choices=["execute", "stream", "watch", "snapshots", "validate", "restore", "prune", "verify", "metrics", "quarantine", "vacuum"])
    parser.add_argument("rest", nargs="*")
    parser.add_argument("--overwrite", action="store_true", help="restore into a store that has rows")
    parser.add_argument("--once", action="store_true", help="watch: what is there, then end")
    args = parser.parse_args(argv)
    return run(Engine(SparkSession.builder.appName("tidemark").getOrCreate(), args.root), args)


if __name__ == "__main__":
    sys.exit(main())
