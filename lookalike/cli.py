"""Command line: ``python -m lookalike hash|cluster|plan|apply|web``."""

from __future__ import annotations

import argparse
import sys

from . import __version__, engine
from .sources.interchange import in_own_folder


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="lookalike", description="Find and resolve near-duplicate images.")
    top.add_argument("-V", "--version", action="version", version=__version__)
    sub = top.add_subparsers(dest="command")
    one = sub.add_parser("hash", help="hash the images under a folder")
    one.add_argument("root")
    one.add_argument("--algo", default="phash")
    one.add_argument("--out", default="hashes.csv")
    one = sub.add_parser("cluster", help="group the items of an index")
    one.add_argument("index")
    one.add_argument("--radius", type=int, default=10)
    one.add_argument("--out", default="clusters.csv")
    one = sub.add_parser("plan", help="decide which file of each cluster to keep")
    one.add_argument("clusters")
    one.add_argument("--out", default="plan.csv")
    one = sub.add_parser("apply", help="move the files to delete into a quarantine folder")
    one.add_argument("plan")
    one.add_argument("--quarantine", default="./quarantine")
    one.add_argument("--hardlink", action="store_true")
    one.add_argument("--dry-run", action="store_true")
    one = sub.add_parser("web", help="serve the review page's API")
    one.add_argument("--port", type=int, default=7070)
    one.add_argument("--plan")
    one.add_argument("--clusters")
    return top


def main(argv: list[str] | None = None) -> int:
    """Exit status: 0 done; 2 for an unknown algorithm or a missing input of hash or cluster; else 1."""
    top = parser()
    try:
        args = top.parse_args(argv)
    except SystemExit as e:
        return int(e.code or 0)
    if not args.command:
        top.print_help()
        return 0
    spark = engine.session()
    try:
        if args.command == "hash":
            out = in_own_folder(args.out)
            print(f"Hashed {engine.hash_images(spark, args.root, out, args.algo)} images into {out}")
        elif args.command == "cluster":
            out = in_own_folder(args.out)
            n = engine.cluster_images(spark, args.index, out, args.radius)
            print(f"{n['n_clusters']} clusters, {n['n_duplicate_clusters']} with duplicates, in {out}")
        elif args.command == "plan":
            out = in_own_folder(args.out)
            n = engine.generate_plan(spark, args.clusters, out)
            print(f"{n['n_keep']} to keep, {n['n_delete']} to delete, in {out}")
        elif args.command == "apply":
            for row in engine.apply_plan(spark, args.plan, args.quarantine, dry_run=args.dry_run, hardlink=args.hardlink):
                print(f"{row['status']}: {row['path']} -> {row['target']}")
        else:
            from .service import Service, serve

            serve(Service(spark, args.clusters, args.plan), args.port)
        return 0
    except (FileNotFoundError, ValueError) as e:
        print(e, file=sys.stderr)
        return 2 if args.command in ("hash", "cluster") and (isinstance(e, FileNotFoundError) or "unknown algorithm" in str(e)) else 1
    except Exception as e:  # any failure of a stage ends the command with status 1
        print(e, file=sys.stderr)
        return 1
