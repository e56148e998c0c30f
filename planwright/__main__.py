"""python -m planwright build MODEL.json [--xlsx OUT.xlsx] | query SNAPSHOT MODEL PIVOT | rules SNAPSHOT MODEL"""

from __future__ import annotations

import argparse
import json


def main(argv: list[str] | None = None) -> int:
    a = argparse.ArgumentParser(prog="planwright", description=__doc__)
    sub = a.add_subparsers(dest="command", required=True)
    b = sub.add_parser("build", help="apply a model document and print its outputs")
    b.add_argument("document")
    b.add_argument("--xlsx")
    b.add_argument("--save")
    q = sub.add_parser("query", help="print a pivot of a snapshot")
    q.add_argument("snapshot")
    q.add_argument("model")
    q.add_argument("pivot")
    r = sub.add_parser("rules", help="print a model's rules")
    r.add_argument("snapshot")
    r.add_argument("model")
    args = a.parse_args(argv)
    from pyspark.sql import SparkSession

    from .engine import Engine
    from .operators import grid
    from .sources import document, store, workbook

    spark = SparkSession.builder.appName("planwright").getOrCreate()
    if args.command == "build":
        with open(args.document, encoding="utf-8") as f:
            doc = json.load(f)
        e = Engine(spark)
        for text in document.apply(e, doc).values():
            print(text, end="\n\n")
        if args.xlsx:
            with open(args.xlsx, "wb") as f:
                f.write(workbook.export(e, doc["model"]))
        if args.save:
            store.save(e, args.save)
    else:
        e = store.open_snapshot(spark, args.snapshot)
        if args.command == "query":
            print(grid.markdown(grid.query(e, args.model, args.pivot)))
        else:
            m = e.model(args.model)
            for o in [*m.tables.values(), *m.pivots.values()]:
                print(f"// {o.id}\n{store.rules_text(o)}\n")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
