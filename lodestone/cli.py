"""A thin command line: index, search, watch, config.  Exit status: 0 matches, 1 none, 2 an error."""

from __future__ import annotations

import argparse
import json
import os
import subprocess
import sys
import time

from pyspark.sql import SparkSession

from .api import Engine, load_config, to_json, to_text
from .constants import DEBOUNCE_MS
from .embed import MODELS, REGISTRY, model_embedder
from .plans.planner import SearchOptions
from .sources import remote


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lodestone")
    p.add_argument("--store", required=True)
    p.add_argument("--config")
    p.add_argument("--embedder", choices=sorted([*REGISTRY, *MODELS]), default="hashing")
    p.add_argument("--models", default=os.path.expanduser("~/.cache/lodestone"), help="folder of the named models' files")
    verbs = p.add_subparsers(dest="verb", required=True)
    s = verbs.add_parser("search")
    s.add_argument("query")
    s.add_argument("--path", default=".")
    s.add_argument("--limit", type=int, default=10)
    s.add_argument("--context", action="store_true")
    s.add_argument("--glob", action="append", default=[])
    s.add_argument("--filters", action="append", default=[])
    s.add_argument("--json", action="store_true")
    s.add_argument("--debug", action="store_true", help="print the plan and the access path")
    s.add_argument("--remote", action="store_true")
    i = verbs.add_parser("index")
    i.add_argument("path", nargs="?", default=".")
    i.add_argument("--force", action="store_true")
    i.add_argument("--stats", action="store_true")
    i.add_argument("--batch-size", type=int)
    i.add_argument("--profile", action="store_true", help="print the seconds of each phase")
    i.add_argument("--json", action="store_true")
    i.add_argument("--detach", action="store_true", help="build in a process of its own")
    i.add_argument("--remote", action="store_true")
    w = verbs.add_parser("watch")
    w.add_argument("path", nargs="?", default=".")
    w.add_argument("--events", help="folder of notification records; without it the tree is watched")
    w.add_argument("--checkpoint", required=True)
    w.add_argument("--debounce-ms", type=int, default=DEBOUNCE_MS)
    w.add_argument("--once", action="store_true")
    w.add_argument("--remote", action="store_true")
    c = verbs.add_parser("config")
    c.add_argument("--show", action="store_true", default=True)
    return p


def _embedder(args: argparse.Namespace):
    return model_embedder(args.embedder, args.models) if args.embedder in MODELS else REGISTRY[args.embedder]()


def run(args: argparse.Namespace, spark: SparkSession) -> int:
    engine = Engine(spark, args.path, args.store, _embedder(args), batch=getattr(args, "batch_size", None))
    store = remote.choose(load_config(args.config), engine.store.root.rsplit("/", 1)[-1]) if args.remote else None
    if args.remote and store is None:
        raise ValueError("no remote store is configured")
    if args.verb == "index":
        if args.stats:
            print(json.dumps(engine.stats(), default=str))
            return 0
        report = engine.index(force=args.force)
        if args.json:
            print(json.dumps(report.__dict__))
        else:
            print(f"{report.mode}: {report.files} files, {report.chunks} chunks, {report.cache_hits} of them known")
        if args.profile:
            print("\n".join(f"{phase}: {seconds:.2f} s" for phase, seconds in report.seconds.items()), file=sys.stderr)
        if store is not None:
            engine.push(store, reset=True)
        return 0
    if args.verb == "watch":
        engine.watch(args.events, args.checkpoint, store, args.once, args.debounce_ms).awaitTermination()
        return 0
    started = time.time()
    if store is not None:
        found = engine.search_remote(args.query, store, args.limit)
        found = found.withColumnRenamed("text", "snippet")
    else:
        found = engine.search(args.query, SearchOptions(limit=args.limit, glob=args.glob, filters=args.filters, full_context=args.context))
    if getattr(args, "debug", False):
        print(found._jdf.queryExecution().toString(), file=sys.stderr)
    text, status = to_text(found)
    print(to_json(found, args.query, args.limit, int(1000 * (time.time() - started)), engine.snapshot().metadata) if args.json else text)
    return status


def main(argv: list[str] | None = None) -> int:
    argv = sys.argv[1:] if argv is None else argv
    args = parser().parse_args(argv)
    if args.verb == "config":
        print(json.dumps(load_config(args.config), indent=2, default=str))
        return 0
    if getattr(args, "detach", False):
        child = subprocess.Popen([sys.executable, "-m", "lodestone.cli", *(a for a in argv if a != "--detach")], stdin=subprocess.DEVNULL, stdout=subprocess.DEVNULL, stderr=subprocess.DEVNULL, start_new_session=True)
        print(child.pid)
        return 0
    try:
        return run(args, SparkSession.builder.appName("lodestone").getOrCreate())
    except Exception as e:  # noqa: BLE001 - the process's last resort
        print(e, file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
