"""Command line: read, schema, admit, verify, export, packs, calibrate."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from .kernel.canonical import loads


def _json(path: str | None):
    return loads(Path(path).read_text(encoding="utf-8")) if path else None


def _spark():
    from .session import session, ship

    s = session()
    ship(s)
    return s


def _packets(spark, path: str):
    rows = spark.read.json(path) if path.endswith((".json", ".jsonl")) else spark.read.parquet(path)
    return rows


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="evidora", description=__doc__)
    verbs = p.add_subparsers(dest="verb", required=True)
    a = verbs.add_parser("read", help="files of a folder to texts and nodes")
    a.add_argument("folder")
    a.add_argument("out")
    a = verbs.add_parser("schema", help="check or lint a schema, or print the schema of an extractor's reply")
    a.add_argument("action", choices=["check", "lint", "extractor", "candidate"])
    a.add_argument("schema", nargs="?")
    a = verbs.add_parser("admit", help="decide packets (doc_id, text, candidates); write decisions, receipts and a summary")
    for n in ("packets", "schema", "out"):
        a.add_argument(n)
    a.add_argument("--policy")
    a = verbs.add_parser("verify", help="decide packets again and compare with the receipts of a folder")
    for n in ("packets", "schema", "out"):
        a.add_argument(n)
    a.add_argument("--policy")
    a = verbs.add_parser("export", help="admitted facts of a folder of decisions")
    a.add_argument("out")
    a.add_argument("to")
    verbs.add_parser("packs", help="list the built-in packs")
    a = verbs.add_parser("bound", help="one-sided 95 %% bound of k in n")
    a.add_argument("k", type=int)
    a.add_argument("n", type=int)
    args = p.parse_args(argv)

    if args.verb == "packs":
        from .kernel.canonical import digest
        from .kernel.packs import BUILT_IN

        for (name, version), pack in sorted(BUILT_IN.items()):
            print(name, version, pack["type"], digest(f"pack-{pack['type']}", pack))
        return 0
    if args.verb == "bound":
        from .operators.calibration import upper_95

        print(upper_95(args.k, args.n))
        return 0
    if args.verb == "schema":
        from . import api
        from .kernel.schema import PacketError, Schema

        try:
            if args.action == "check":
                print(Schema.of(_json(args.schema)).sha256)
            elif args.action == "lint":
                from .kernel.lint import lint

                for code, field, what in lint(_json(args.schema)):
                    print(field, code, what)
            else:
                print(json.dumps(api.candidate_schema() if args.action == "candidate" else api.extractor_schema(_json(args.schema)), indent=1))
        except PacketError as e:
            print(e, file=sys.stderr)
            return 1
        return 0
    spark = _spark()
    if args.verb == "read":
        from .sources.files import read_files

        read_files(spark, args.folder).write.parquet(args.out)
        return 0
    from .operators import gate

    if args.verb == "export":
        gate.facts(spark.read.parquet(f"{args.out}/decisions")).write.json(args.to)
        return 0
    schema, policy = _json(args.schema), _json(args.policy)
    rows = gate.admit(_packets(spark, args.packets), schema, policy)
    if args.verb == "verify":
        status = gate.verify(spark.read.parquet(f"{args.out}/receipts"), gate.receipts(rows, schema, policy)).filter("status <> 'same'")
        bad = status.limit(20).collect()
        for r in bad:
            print(r["doc_id"], r["status"])
        return int(bool(bad))
    rows.write.parquet(f"{args.out}/decisions")
    rows = spark.read.parquet(f"{args.out}/decisions")
    gate.receipts(rows, schema, policy).write.parquet(f"{args.out}/receipts")
    gate.summary(rows).write.parquet(f"{args.out}/summary")
    gate.coverage(_packets(spark, args.packets), rows, schema).write.parquet(f"{args.out}/coverage")
    return 0


if __name__ == "__main__":
    sys.exit(main())
