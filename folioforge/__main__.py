"""python -m folioforge {ingest,query,export,reconcile,verify,all}"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from folioforge.operators import layout
from folioforge.session import Config, Session, merge_lines, verify_lines

QUESTIONS = ("What are these documents about?", "Which works do they build on?")


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="folioforge", description="A bibliographic knowledge graph on Spark.")
    out.add_argument("--working-dir")
    out.add_argument("--data-dir")
    out.add_argument("--backend", choices=("live", "stub"), default="stub", help="live takes a profiler that the program is given; stub reads header lines")
    out.add_argument("--metadata-lookup", choices=("auto", "on", "off"), default="auto", help="auto is on for the live backend where METADATA_LOOKUP is not 0")
    out.add_argument("--catalogues", nargs=2, metavar=("FIRST", "SECOND"), help="JSON lines of the two catalogues")
    sub = out.add_subparsers(dest="command", required=True)
    for name, said in (("ingest", "read new documents"), ("query", "ask questions"), ("export", "write a canvas"), ("reconcile", "merge nodes that are one entity"), ("verify", "check a canvas file"), ("all", "ingest, query, export")):
        command = sub.add_parser(name, help=said)
        if name in ("query", "all"):
            command.add_argument("question", nargs="*")
            command.add_argument("--mode", choices=("hybrid", "mix", "both"), default="both")
        if name in ("export", "all"):
            command.add_argument("--out")
            command.add_argument("--max-nodes", type=int)
            command.add_argument("--algorithm", choices=(layout.SPRING, layout.ATLAS), default=layout.SPRING)
            command.add_argument("--no-verify", action="store_true")
        if name == "verify":
            command.add_argument("path")
            command.add_argument("--allow-overlap", action="store_true")
    return out


def looks_up(backend: str, choice: str, config: Config) -> bool:
    return choice == "on" or choice == "auto" and backend == "live" and config.metadata_lookup


def run(spark: SparkSession, argv: list[str], profile=None, **given) -> int:
    """One command; ``profile``, and what else a Session takes, come from the caller. The status is 1 where a canvas has errors."""
    args = parser().parse_args(argv)
    config = Config().with_overrides(working_dir=args.working_dir, data_dir=args.data_dir, canvas_path=getattr(args, "out", None))
    say = lambda lines: print("\n".join(lines))
    if args.command == "verify":
        ok, lines = verify_lines(spark, args.path, args.allow_overlap)
        say(lines)
        return int(not ok)
    if args.backend == "live" and profile is None:
        raise SystemExit("the live backend needs a profiler: call folioforge.__main__.run with one")
    if args.catalogues and looks_up(args.backend, args.metadata_lookup, config):
        given["catalogues"] = tuple(spark.read.text(p).withColumnRenamed("value", "json") for p in args.catalogues)
    session = Session(spark, config, **({"profile": profile} if profile else {}), **given)
    if args.command in ("ingest", "all"):
        say(session.ingest().lines())
    if args.command == "reconcile":
        say(merge_lines(session.reconcile()))
    if args.command in ("query", "all"):
        say(session.query(args.question or list(QUESTIONS), ["hybrid", "mix"] if args.mode == "both" else [args.mode]))
    if args.command in ("export", "all"):
        path = session.export(args.out, args.max_nodes, args.algorithm)
        say([f"Canvas written to {path}"])
        if not args.no_verify:
            ok, lines = verify_lines(spark, path)
            say(lines)
            return int(not ok)
    return 0


if __name__ == "__main__":
    sys.exit(run(SparkSession.builder.appName("folioforge").getOrCreate(), sys.argv[1:]))
