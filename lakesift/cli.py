"""Command lines: ``python -m lakesift scan ROOT [TESSERACT]`` and ``python -m lakesift organize DIRECTORY ...``."""

from __future__ import annotations

import argparse
import os
import sys
import time
from collections.abc import Iterable
from datetime import datetime
from typing import TextIO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakesift.operators import detection, organize, report
from lakesift.sources import files, ocr

# Names of the files that a scan leaves in its root.
RESULT, DEBUG, LOG, REPORT = "result.csv", "scan_debug.csv", "scan_all.log", "pdn_report_{}.md"


def session() -> SparkSession:
    return SparkSession.builder.appName("lakesift").config("spark.ui.showConsoleProgress", "false").getOrCreate()


def _say(lines: Iterable[str], log: TextIO | None = None) -> None:
    for line in lines:
        print(line)
        if log:
            print(line, file=log, flush=True)


def scan(spark: SparkSession, root: str, backend: files.OcrBackend | None = None, name: str = "-") -> str:
    """Scan a tree and leave result, debug rows, report and log in its root; returns the report's path.

    Every file is read and judged once: decisions are kept for the sinks.
    """
    began = time.time()
    found = files.texts(spark, root, ocr=backend)
    decisions = detection.with_findings(detection.detect(found)).withColumn("ord", F.array_position(F.array(*map(F.lit, files.KINDS)), F.col("top_dir"))).persist()
    media = files.media(files.scan(spark, root).drop("content")).withColumn("ord", F.lit(len(files.KINDS) + 1))
    try:
        with open(os.path.join(root, LOG), "w", encoding="utf-8") as log:
            total, clips = decisions.count(), media.count()
            _say((f"ROOT          : {root}", f"TESSERACT     : {name}", f"TOTAL FILES   : {total}", ""), log)
            _say(report.log_lines(decisions, total), log)
            rows = report.result_rows(decisions, media).orderBy(F.lower("name"), "name").persist()
            result = report.write_csv(rows, os.path.join(root, RESULT))
            debug = report.write_csv(report.debug_rows(report.scan_order(decisions)), os.path.join(root, DEBUG))
            path = os.path.join(root, REPORT.format(datetime.now().strftime("%Y%m%d_%H%M%S")))
            report.write_markdown(decisions, clips, path)
            ended = (f"result  → {result}", f"debug   → {debug}", f"report  → {path}", f"log     → {log.name}")
            _say(("", *ended, f"PDN files found : {rows.count()}", f"Total time      : {time.time() - began:.2f}s"), log)
            rows.unpersist()
    finally:
        decisions.unpersist()
    return path


def placed(spark: SparkSession, root: str, target: str, args: argparse.Namespace) -> DataFrame:
    listed = files.walk(spark, root)
    plan = organize.plan(listed, action=args.mode, keep_unknown=not args.no_unknown, preserve_names=args.preserve_names)
    # placement starts when the whole plan is known: what it moves is no longer found
    plan = spark.createDataFrame(plan.toPandas(), plan.schema) if args.mode == "move" and not args.dry_run else plan
    return organize.apply(plan, target, dry_run=args.dry_run, extract_archives=args.extract_archives).persist()


def organize_tree(spark: SparkSession, args: argparse.Namespace) -> int:
    root = os.path.realpath(args.directory)
    if args.verify:
        listed = files.walk(spark, root)
        first = F.substring_index(F.expr(f"substr(path, {len(root) + 2})"), "/", 1)
        inside = listed.withColumn("top_dir", F.when(F.length("path") - F.length("name") - 1 > len(root), first)).where("top_dir is not null")
        _say(organize.verify_lines(organize.verify(inside)))
        return 0
    target = root if args.mode == "move" else os.path.realpath(args.output)
    outcomes = placed(spark, root, target, args)
    try:
        _say(organize.statistics_lines(outcomes, args.dry_run))
        if args.report and not args.dry_run:
            organize.write_manifest(outcomes, args.report, source=root, target=target, mode=args.mode, dry_run=args.dry_run)
            print(f"Отчёт сохранён: {args.report}")
    finally:
        outcomes.unpersist()
    return 0


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="lakesift")
    commands = top.add_subparsers(dest="command", required=True)
    one = commands.add_parser("scan", help="find personal data in data/, text/ and images/ of a tree")
    one.add_argument("root")
    one.add_argument("tesseract", nargs="?", help="the OCR command; without it the texts of images are empty")
    two = commands.add_parser("organize", help="place files into one folder for each true format")
    two.add_argument("directory")
    two.add_argument("--mode", choices=("move", "copy", "symlink"), default="move")
    two.add_argument("--output", "-o", help="where to; needed by copy and symlink, while move stays inside the directory")
    two.add_argument("--dry-run", action="store_true")
    two.add_argument("--extract-archives", action="store_true", help="also unpack ZIP files beside themselves")
    two.add_argument("--no-unknown", action="store_true", help="leave files of unknown format where they are")
    two.add_argument("--preserve-names", action=argparse.BooleanOptionalAction, default=True)
    two.add_argument("--verify", action="store_true", help="only tell how many files lie in the folder of their true format")
    two.add_argument("--report", "-r", help="write the manifest to this JSON file")
    return top


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    root = args.root if args.command == "scan" else args.directory
    if not os.path.exists(root):
        print(f"ERROR: root not found: {root}", file=sys.stderr)
        return 1
    if args.command == "scan":
        scan(session(), os.path.realpath(root), ocr.backend(ocr.tesseract(args.tesseract)) if args.tesseract else None, args.tesseract or "-")
        return 0
    if args.mode != "move" and not args.verify and not args.output:
        print("ERROR: copy and symlink need --output", file=sys.stderr)
        return 1
    return organize_tree(session(), args)
