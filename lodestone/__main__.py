"""python -m lodestone ingest|search|ask|status|scan|collect|dashboard|diagnose|serve|reset"""

from __future__ import annotations

import argparse
import itertools
import json
import time

from pyspark.sql import SparkSession

from lodestone import serve
from lodestone.operators import diagnostics
from lodestone.plans.engine import Engine
from lodestone.sources import config, files, journal


def main() -> None:
    p = argparse.ArgumentParser(prog="lodestone")
    p.add_argument("--config")
    of = p.add_subparsers(dest="command", required=True)
    a = of.add_parser("ingest")
    a.add_argument("-p", "--path", action="append")
    a.add_argument("-f", "--file-list")
    for name in ("search", "ask"):
        a = of.add_parser(name)
        a.add_argument("text")
        a.add_argument("-k", "--top-k", type=int)
        a.add_argument("-t", "--type")
    of.add_parser("status")
    a = of.add_parser("scan")
    a.add_argument("-p", "--path", action="append")
    a.add_argument("-o", "--output")
    a = of.add_parser("collect")
    a.add_argument("-v", "--volume", action="append", default=[], metavar="NAME=FOLDER", help="a folder of saved journal pages, with state.json and an index of paths")
    a.add_argument("-o", "--output", required=True)
    a = of.add_parser("dashboard")
    a.add_argument("--every", type=float, default=10.0)
    a.add_argument("--times", type=int)
    of.add_parser("diagnose")
    a = of.add_parser("serve")
    a.add_argument("--host", default="127.0.0.1")
    a.add_argument("-p", "--port", type=int, default=8080)
    a = of.add_parser("reset")
    a.add_argument("-y", "--yes", action="store_true")
    args = p.parse_args()
    spark = SparkSession.builder.appName("lodestone").getOrCreate()
    engine = Engine(spark, config.load(args.config))
    if args.command == "ingest":
        print(json.dumps(engine.ingest(args.path, args.file_list)))
    elif args.command == "search":
        for r in engine.search(args.text, args.top_k, args.type).collect():
            print(f"{r['score']:.4f}  {r['file_path']}\n        " + r["text"][:300].replace("\n", " "))
    elif args.command == "ask":
        print(json.dumps(engine.ask(args.text, args.top_k, args.type), ensure_ascii=False, indent=1))
    elif args.command == "status":
        print(json.dumps(engine.status()))
    elif args.command == "scan":
        found = files.scan(spark, args.path or engine.config.scan_paths, engine.files.read())
        files.write_list(found, args.output) if args.output else found.show(50, False)
    elif args.command == "collect":
        volumes = {}
        for v in args.volume:
            name, _, folder = v.partition("=")
            volumes[name] = journal.saved_volume(spark, folder)
        print(files.collect(spark, volumes, f"{engine.config.store}/journal.json", args.output, str(int(time.time()))))
    elif args.command == "dashboard":
        for n in itertools.count(1):
            print(json.dumps(engine.report()), flush=True)
            if args.times and n >= args.times:
                break
            time.sleep(args.every)
    elif args.command == "diagnose":
        steps = [("catalog", engine.status), ("search", lambda: engine.search("product key serial number").count()), ("ask", lambda: engine.ask("What product keys do I have?")["answer"])]
        for r in diagnostics.timed(steps):
            print(f"{r['state']:8} {r['step']:8} {r['seconds']:6.1f} s  {r['error'] or r['result']}")
    elif args.command == "serve":
        serve.server(engine, args.host, args.port).serve_forever()
    elif args.yes or input("This deletes all indexed data. Go on? [y/N] ").strip().lower() == "y":
        engine.reset()


if __name__ == "__main__":
    main()
