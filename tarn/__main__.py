"""``python -m tarn scan fs --path=P`` and ``python -m tarn scan git --repo=R``: findings as JSON lines.

Progress, diagnostics and, last, a summary go to standard error. With ``--state`` a
repository's run is incremental: only what its refs have gained since is scanned.
"""

from __future__ import annotations

import argparse
import json
import sys
import time


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tarn")
    kinds = p.add_subparsers(dest="command", required=True).add_parser("scan").add_subparsers(dest="source", required=True)
    fs = kinds.add_parser("fs")
    fs.add_argument("--path", required=True)
    fs.add_argument("--skip-hidden", action="store_true")
    fs.add_argument("--respect-gitignore", action="store_true")
    fs.add_argument("--max-file-size", type=int, default=100 << 20)
    git = kinds.add_parser("git")
    git.add_argument("--repo", required=True)
    git.add_argument("--start-set", choices=("default", "remotes", "branches_and_tags"), default="default")
    git.add_argument("--mode", choices=("history", "snapshot"), default="history")
    git.add_argument("--merge-mode", choices=("all_parents", "first_parent"), default="all_parents")
    git.add_argument("--state", help="a folder of earlier runs' contexts, findings, seen blobs and watermarks; without it every run is the first")
    for k in (fs, git):
        k.add_argument("--shared", help="a folder that all executors share, where the session has no spark.checkpoint.dir")
        k.add_argument("--output", help="a folder for JSON lines; standard output without it")
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    from pyspark.sql import SparkSession

    from tarn.sources import events

    spark = SparkSession.builder.appName("tarn").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    if args.shared:
        spark.sparkContext.setCheckpointDir(args.shared)
    began = time.time()
    lines, tell = (_files if args.source == "fs" else _repository)(spark, args)
    if args.output:
        lines.write.text(args.output)
        n = spark.read.text(args.output).count()
    else:
        from tarn.sources.storage import drop, materialise

        # Written first: reading one partition after the other must not scan them so.
        written, n = materialise(lines, "events"), 0
        for row in written.toLocalIterator():
            print(row.value)
            n += 1
        drop(written)
    objects, size, problems, complete = tell()
    out = [events.progress_event(args.source, "scan", objects, size, n), *(events.diagnostic_event("warn", p) for p in problems)]
    out.append(events.summary_event(args.source, "complete" if complete else "partial", int((time.time() - began) * 1000), size, n, len(problems)))
    print("\n".join(map(json.dumps, out)), file=sys.stderr)
    return 0


def _files(spark, args):
    """(lines, what to tell of the run once they are written)."""
    from pyspark.sql import Observation

    from tarn.sources import events
    from tarn.sources.files import scan_path

    seen = Observation()
    found = scan_path(spark, args.path, observation=seen, skipHidden=args.skip_hidden, respectGitignore=args.respect_gitignore, maxFileSize=args.max_file_size)

    def tell():
        told = seen.get
        problems = [f"{told[k]} objects {k}" for k in ("skipped", "partial") if told[k]]
        return told["objects"], told["bytes"], problems, not problems

    return events.finding_events(found, "fs"), tell


def _repository(spark, args):
    from pyspark.sql import functions as F

    from tarn.sources import events, git, storage
    from tarn.sources.state import State

    at = args.state or storage.scratch(spark, "state")
    run = git.scan_changes(spark, args.repo, State(spark, at), which=args.start_set, mode=args.mode, merge_mode=args.merge_mode)
    first = run.contexts.groupBy("oid").agg(F.min(F.struct("commit_id", "path")).alias("m")).select("oid", F.col("m.path").alias("object_id"))
    problems = [f"{run.skipped} blobs are missing or broken"] if run.skipped else []
    return events.finding_events(run.findings.join(first, "oid"), "git"), lambda: (run.objects, run.bytes, problems, run.complete)


if __name__ == "__main__":
    sys.exit(main())
