"""The workspace on the command line: ``python -m quirelake COMMAND ...``; ``--json`` for machine-readable answers."""

from __future__ import annotations

import argparse
import json
import sys
import uuid
from dataclasses import asdict, is_dataclass

from pyspark.sql import DataFrame, SparkSession

from quirelake.plans.engine import Workspace, WorkspaceError


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="quirelake", description=__doc__)
    top.add_argument("--json", action="store_true", help="answer in JSON")
    top.add_argument("--folder", default=".", help="the workspace")
    sub = top.add_subparsers(dest="command", required=True)
    add = lambda name, *names: [c := sub.add_parser(name), *[c.add_argument(n) for n in names]][0]
    add("init")
    add("status")
    add("inspect", "path")
    read = add("read", "path")
    read.add_argument("--selector", nargs=2, metavar=("KIND", "VALUE"), default=(None, None))
    read.add_argument("--max-tokens", type=int, default=2000)
    read.add_argument("--cursor", type=int)
    deps = add("deps", "path", "sheet", "address")
    deps.add_argument("--reverse", action="store_true")
    edit = add("edit", "path", "kind", "payload")
    edit.add_argument("--tx")
    edit.add_argument("--expect")
    apply = add("apply", "path")
    apply.add_argument("--tx")
    add("discard", "path", "tx")
    staged = sub.add_parser("staged")
    staged.add_argument("path", nargs="?")
    add("history", "path")
    add("diff", "path").add_argument("version", type=int)
    revert = add("revert", "path")
    revert.add_argument("version", type=int)
    revert.add_argument("--tx")
    find = add("search", "query")
    find.add_argument("--glob")
    add("viz")
    return top


def run(ws: Workspace, a: argparse.Namespace) -> object:
    match a.command:
        case "init":
            ws.init()
            return {"workspace": ws.folder, "parsed": ws.refresh()}
        case "status":
            return ws.status()
        case "inspect":
            return ws.inspect(a.path)
        case "read":
            return ws.read(a.path, *a.selector, max_tokens=a.max_tokens, cursor=a.cursor)
        case "deps":
            return ws.deps(a.path, a.sheet, a.address, "reverse" if a.reverse else "forward")
        case "edit":
            tx = a.tx or uuid.uuid4().hex
            return {"tx_id": tx, "diff": ws.edit(a.path, a.kind, json.loads(a.payload), tx, a.expect)}
        case "apply":
            return {"versions": [ws.apply(a.path, a.tx)] if a.tx else ws.apply_all(a.path)}
        case "discard":
            ws.discard(a.path, a.tx)
            return {"discarded": a.tx}
        case "staged":
            return ws.staged(a.path)
        case "history":
            return ws.history(a.path)
        case "diff":
            return ws.diff(a.path, a.version)
        case "revert":
            tx = a.tx or uuid.uuid4().hex
            return {"tx_id": tx, "diff": ws.revert(a.path, a.version, tx)}
        case "search":
            return ws.search(a.query, a.glob)
        case _:
            return ws.metrics()


def shown(answer: object, as_json: bool) -> str:
    if isinstance(answer, DataFrame):
        rows = [r.asDict(recursive=True) for r in answer.collect()]
        return json.dumps(rows, ensure_ascii=False, default=str) if as_json else "\n".join("\t".join("" if v is None else str(v) for v in r.values()) for r in rows)
    if is_dataclass(answer):
        return json.dumps(asdict(answer), ensure_ascii=False) if as_json else answer.content + (f"\n[{answer.estimated_tokens} tokens; go on at {answer.cursor}]" if answer.truncated else "")
    return json.dumps(answer, ensure_ascii=False, default=str, indent=None if as_json else 2)


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(args)
    session = spark or SparkSession.builder.appName("quirelake").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    try:
        print(shown(run(Workspace(session, a.folder), a), a.json))
        return 0
    except WorkspaceError as error:
        print(json.dumps({"code": error.code, "message": str(error)}) if a.json else str(error), file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
