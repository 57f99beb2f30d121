"""Plan, apply and verify the placement of files into one folder for each true format."""

from __future__ import annotations

import filecmp
import io
import json
import os
import posixpath
import shutil
import zipfile
from collections.abc import Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakesift.operators.formats import HEADER_BYTES, detect_formats, extension, sniff

# What a manifest calls the things done, and the words of the statistics.
DONE = {"move": "перемещён", "copy": "скопирован", "symlink": "симлинк"}
COPIED_INSTEAD = "скопирован (fallback)"
DRY = "[DRY-RUN] "
RULE = "=" * 70
STATISTICS, PROCESSED, BY_FORMAT = "СТАТИСТИКА РЕОРГАНИЗАЦИИ", "Обработано файлов: {}", "Распределение по реальным форматам:"
FOLDER_LINE, SPOOFED, TOTAL_LINE = "  {}/: {} файлов, {:.1f} МБ{}", " (из них с подменой: {})", "Итого: {} файлов, {:.1f} МБ"
DRY_LINE = "Для применения изменений запустите без --dry-run"
SPOOF_LINE, EXTRACTED_LINE, ERROR_LINE = "    ⚠️  ПОДМЕНА: {} (реальный: {}/{}, {})", "    Извлечено {} файлов из {}", "  Ошибка при обработке {}: {}"
VERIFIED, VERIFY_LINE, WRONG, WRONG_LINE, MORE_LINE = "Результаты верификации:", "  {} {}/: {}/{} правильных ({:.1f}%), {:.1f} МБ", "       Несоответствия:", "         - {} → реальный: {} ({})", "         ... и ещё {}"
#: A folder with more right files than this, in per cent, is marked so; mismatches shown of each folder.
FINE, EXAMPLES = 95, 5


def collision_names(files: DataFrame, group: str = "detected_folder", order: str = "path") -> DataFrame:
    """Add ``target_name``: the first of equal names in a folder keeps it, the next are ``stem_1.ext``, ``stem_2.ext``, ...

    The shuffle is on folder and name; only equal names meet in one task.
    """
    ext = F.regexp_extract("name", r"(?s)[^/](\.[^./]+)$", 1)
    stem = F.expr("left(name, length(name) - length(_ext))")
    nth = F.row_number().over(Window.partitionBy(group, "name").orderBy(order)) - 1
    named = files.withColumn("_ext", ext).withColumn("_nth", nth)
    target = F.when(F.col("_nth") == 0, F.col("name")).otherwise(F.concat(stem, F.lit("_"), F.col("_nth").cast("string"), "_ext"))
    return named.withColumn("target_name", target).drop("_ext", "_nth")


def plan(files: DataFrame, action: str = "copy", keep_unknown: bool = True, preserve_names: bool = True) -> DataFrame:
    """Manifest of files with path, name, size and header."""
    found = detect_formats(files)
    if not keep_unknown:
        found = found.where("detected_folder <> 'unknown'")
    if not preserve_names:
        found = found.withColumn("name", F.concat(F.left(F.md5(F.col("path")), F.lit(16)), extension(F.col("name"))))
    return collision_names(found).select(
        F.col("path").alias("original_path"),
        F.concat_ws("/", "detected_folder", "target_name").alias("target_path"),
        F.col("size").cast("long").alias("size_bytes"),
        "detected_folder",
        "detected_format",
        "is_spoofed",
        "spoof_note",
        F.lit(action).alias("action"),
    )


def summary(manifest: DataFrame) -> DataFrame:
    """Files, bytes and mismatches of each folder, and of all (a null ``folder``)."""
    return (
        manifest.rollup(F.col("detected_folder").alias("folder"))
        .agg(
            F.count("*").alias("count"),
            F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("size_bytes"),
            F.count_if("is_spoofed").alias("spoofed_count"),
        )
        .withColumn("size_mb", F.round(F.col("size_bytes") / F.lit(1048576.0), 2))
    )


def verify(files: DataFrame) -> DataFrame:
    """Of each folder (``top_dir``; null counts as none): files, those whose true format belongs there, bytes, and up to 5 mismatches.

    Mismatches are cut to the first by name before they are shuffled; right files are only counted.
    """
    found = detect_formats(files).where(~F.col("top_dir").startswith("_"))
    right = F.col("detected_folder") == F.col("top_dir")
    counts = found.groupBy(F.col("top_dir").alias("folder")).agg(F.count("*").alias("total"), F.count_if(right).alias("correct"), F.coalesce(F.sum("size"), F.lit(0)).alias("size_bytes"))
    nth = F.row_number().over(Window.partitionBy("top_dir").orderBy("name", "detected_folder"))
    first = found.where(~right).select("top_dir", "name", "detected_folder", "detected_format").withColumn("nth", nth).where(F.col("nth") <= EXAMPLES)
    shown = first.groupBy(F.col("top_dir").alias("folder")).agg(F.sort_array(F.collect_list(F.struct("name", "detected_folder", "detected_format"))).alias("examples"))
    none = F.array().cast("array<struct<name:string,detected_folder:string,detected_format:string>>")
    return (
        counts.join(shown, "folder", "left")
        .withColumn("examples", F.coalesce("examples", none))
        .withColumn("accuracy", F.round(F.col("correct") * 100.0 / F.col("total"), 2))
    )


def verify_lines(verified: DataFrame) -> Iterator[str]:
    """A line for each folder, by name, and one for each mismatch shown."""
    yield VERIFIED
    for r in verified.orderBy("folder").toLocalIterator():
        share = 100 * r["correct"] / max(r["total"], 1)
        yield VERIFY_LINE.format("✓" if share > FINE else "⚠️", r["folder"], r["correct"], r["total"], share, r["size_bytes"] / 1048576)
        if r["examples"]:
            yield WRONG
            yield from (WRONG_LINE.format(x["name"], x["detected_folder"], x["detected_format"]) for x in r["examples"])
            if (more := r["total"] - r["correct"] - len(r["examples"])) > 0:
                yield MORE_LINE.format(more)


def _member_names(archive: zipfile.ZipFile) -> Iterator[tuple[str, zipfile.ZipInfo]]:
    """Members without their folders; equal names get ``_N``."""
    seen: set[str] = set()
    for info in archive.infolist():
        base = posixpath.basename(info.filename)
        if info.is_dir() or not base:
            continue
        name, n = base, 0
        while name in seen:
            n += 1
            name = f"_{n}".join(os.path.splitext(base))
        seen.add(name)
        yield name, info


#: What a damaged, locked or unknown archive raises.
BAD_ARCHIVE = (zipfile.BadZipFile, RuntimeError, NotImplementedError, OSError, EOFError)


def unzip(files: DataFrame) -> DataFrame:
    """One row for each member of the ZIP files among rows of path and content: path, name, size, header.

    Names lose their folders; equal names within an archive get ``_N``.  A damaged archive gives the rows before the damage.
    """

    def members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                rows = []
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as archive:
                        for name, info in _member_names(archive):
                            with archive.open(info) as member:
                                rows.append((path, name, info.file_size, member.read(HEADER_BYTES)))
                except BAD_ARCHIVE:
                    pass
                yield pd.DataFrame(rows, columns=["path", "name", "size", "header"])

    zips = files.where(F.lower("path").endswith(".zip")).select("path", "content")
    return zips.mapInPandas(members, "path string, name string, size long, header binary")


def extract(archive: str, folder: str) -> tuple[list[tuple[str, int, bytes]], str | None]:
    """Write an archive's members into ``folder``: names, sizes and headers, and what went wrong.  Members already there are written again."""
    rows = []
    try:
        os.makedirs(folder, exist_ok=True)
        with zipfile.ZipFile(archive) as opened:
            for name, info in _member_names(opened):
                with opened.open(info) as member, open(os.path.join(folder, name), "wb") as out:
                    head = member.read(HEADER_BYTES)
                    out.write(head)
                    shutil.copyfileobj(member, out)
                rows.append((name, info.file_size, head))
    except BAD_ARCHIVE as error:
        return rows, str(error)
    return rows, None


def _there(source: str, goal: str, action: str) -> bool:
    """Whether an earlier run, or a task that was lost, has placed this very file here."""
    if action == "move" and not os.path.lexists(source):
        return os.path.isfile(goal)
    if action == "symlink" and os.path.islink(goal):
        return os.path.realpath(goal) == os.path.realpath(source)
    if not os.path.isfile(goal) or os.path.islink(goal):
        return False
    return os.path.abspath(source) == os.path.abspath(goal) or (action != "move" and os.path.isfile(source) and filecmp.cmp(source, goal, shallow=False))


def place_file(source: str, goal: str, action: str) -> tuple[str, str]:
    """Move, copy or link one file to ``goal`` or, where another file lies there, to ``stem_N.ext``: where it is, and what was done.

    A name is taken by creating the file, so tasks at work side by side never take the same one; a file that lies
    there already is left, so that a task can run again.
    """
    os.makedirs(os.path.dirname(goal), exist_ok=True)
    (stem, ext), n, at = os.path.splitext(goal), 0, goal
    while True:
        if _there(source, at, action):
            return at, DONE[action]
        try:
            if action == "symlink":
                try:
                    os.symlink(os.path.relpath(source, os.path.dirname(at)), at)
                    return at, DONE[action]
                except FileExistsError:
                    raise
                except OSError:  # a file system without links
                    pass
            os.close(os.open(at, os.O_CREAT | os.O_EXCL | os.O_WRONLY))
            break
        except FileExistsError:
            n += 1
            at = f"{stem}_{n}{ext}"
    try:
        if action == "move":
            try:
                os.replace(source, at)
            except OSError:  # another file system
                shutil.copy2(source, at)
                os.unlink(source)
        else:
            shutil.copy2(source, at)
    except OSError:
        os.unlink(at)
        raise
    return at, COPIED_INSTEAD if action == "symlink" else DONE[action]


OUTCOME = "original_path string, target_path string, size_bytes long, detected_folder string, detected_format string, is_spoofed boolean, spoof_note string, action string, error string, archive_error string, members array<struct<name:string,size:long,header:binary>>"


def apply(manifest: DataFrame, target: str, dry_run: bool = False, extract_archives: bool = False) -> DataFrame:
    """Carry out a manifest on a tree that driver and executors can open, in parallel: the manifest with what was done to each file.

    ``target_path`` becomes whole, ``action`` tells what was done (null where ``error`` tells why not) and ``members`` what an
    archive held.  One file's failure stops no other.  With ``dry_run`` nothing is touched.  Evaluating the result does the work,
    so persist it; doing it twice changes nothing.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.to_dict("records"):
                source, goal = r["original_path"].removeprefix("file:"), os.path.join(target, r["target_path"])
                action, error, bad, members = r["action"], None, None, None
                if dry_run:
                    at, done = None, f"{DRY}{action} {source} -> {goal}"
                else:
                    try:
                        at, done = place_file(source, goal, action)
                    except OSError as problem:
                        at, done, error = goal, None, str(problem)
                if extract_archives and not dry_run and error is None and r["detected_folder"] == "archives" and source.lower().endswith(".zip"):
                    members, bad = extract(at, os.path.join(os.path.dirname(at), "_extracted_" + os.path.splitext(os.path.basename(at))[0]))
                    members = [{"name": n, "size": size, "header": head} for n, size, head in members]
                rows.append((source, at, int(r["size_bytes"]) if pd.notna(r["size_bytes"]) else 0, r["detected_folder"], r["detected_format"], r["is_spoofed"], r["spoof_note"], done, error, bad, members))
            yield pd.DataFrame(rows, columns=[c.split(" ")[0] for c in OUTCOME.split(", ")])

    return manifest.mapInPandas(run, OUTCOME)


def members_of(outcomes: DataFrame) -> DataFrame:
    """The extracted members of archives with their true formats: name, original_path, extracted_from, folder, format, spoof."""
    each = outcomes.where("members is not null").select("target_path", "original_path", F.explode("members").alias("m"))
    found = sniff(F.col("m.header"), extension(F.col("m.name")))
    base: Column = F.substring_index("original_path", "/", -1)
    told = each.select(F.col("m.name").alias("name"), F.col("target_path").alias("original_path"), base.alias("extracted_from"), found.alias("f"))
    return told.select("name", "original_path", "extracted_from", F.col("f.folder").alias("folder"), F.col("f.label").alias("format"), F.col("f.note").alias("spoof"))


def write_manifest(outcomes: DataFrame, path: str, *, source: str = "", target: str = "", mode: str = "copy", dry_run: bool = False) -> None:
    """The report of a run as one indented JSON file: files by where they are, totals by folder, archive members by name.

    Files that could not be placed are left out, from the totals too.  Of members with one name that of the last archive by path
    stands.  Rows stream through the driver.
    """
    say = lambda x: json.dumps(x, ensure_ascii=False, indent=2).replace("\n", "\n    ")
    placed = outcomes.where("error is null")
    with open(path, "w", encoding="utf-8") as out:
        out.write("{\n")
        for key, value in (("scan_date", datetime.now().isoformat()), ("source", source), ("target", target), ("mode", mode)):
            out.write(f"  {json.dumps(key)}: {json.dumps(value, ensure_ascii=False)},\n")
        out.write('  "files": {')
        done = 0
        for r in placed.drop("error", "archive_error", "members").toLocalIterator():
            out.write(("," if done else "") + f"\n    {json.dumps(r['target_path'] or r['original_path'], ensure_ascii=False)}: {say(r.asDict())}")
            done += 1
        out.write('\n  },\n  "summary": ')
        folders = {r["folder"]: r.asDict() for r in summary(placed).where("folder is not null").collect()}
        totals: dict = {k: {c: folders[k][c] for c in ("count", "size_bytes", "size_mb", "spoofed_count")} for k in sorted(folders)}
        totals["total"] = {"files_processed": done, "total_size_mb": round(sum(r["size_bytes"] for r in folders.values()) / 1048576, 2), "dry_run": dry_run}
        out.write(json.dumps(totals, ensure_ascii=False, indent=2).replace("\n", "\n  "))
        last = members_of(outcomes).groupBy("name").agg(F.max(F.struct("original_path", "extracted_from", "folder", "format", "spoof")).alias("m"))
        for r in last.orderBy("name").toLocalIterator():
            out.write(f",\n  {json.dumps(r['name'], ensure_ascii=False)}: " + json.dumps(r["m"].asDict(), ensure_ascii=False, indent=2).replace("\n", "\n  "))
        out.write("\n}\n")


def statistics_lines(outcomes: DataFrame, dry_run: bool = False) -> Iterator[str]:
    """The log of a run: mismatches, archives and errors, then files and bytes of each folder and in all."""
    told = outcomes.where("error is not null or is_spoofed or members is not null")
    for r in told.select("original_path", "detected_folder", "detected_format", "is_spoofed", "spoof_note", "error", F.size("members").alias("extracted")).toLocalIterator():
        name = os.path.basename(r["original_path"])
        if r["error"] is not None:
            yield ERROR_LINE.format(name, r["error"])
            continue
        if r["extracted"] is not None and r["extracted"] >= 0:
            yield EXTRACTED_LINE.format(r["extracted"], name)
        if r["is_spoofed"] and not dry_run:
            yield SPOOF_LINE.format(name, r["detected_folder"], r["detected_format"], r["spoof_note"])
    totals = summary(outcomes.where("error is null")).collect()
    every = sum(r["count"] for r in totals if r["folder"] is not None)
    size = sum(r["size_bytes"] for r in totals if r["folder"] is not None)
    yield from ("", RULE, STATISTICS, RULE, PROCESSED.format(every), "", BY_FORMAT)
    for r in sorted((r for r in totals if r["folder"] is not None), key=lambda r: r["folder"]):
        spoofed = SPOOFED.format(r["spoofed_count"]) if r["spoofed_count"] else ""
        yield FOLDER_LINE.format(r["folder"], r["count"], r["size_bytes"] / 1048576, spoofed)
    yield from ("", TOTAL_LINE.format(every, size / 1048576))
    if dry_run:
        yield from ("", DRY_LINE)
