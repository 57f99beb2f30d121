"""Result rows, totals, and the files that a scan leaves."""

from __future__ import annotations

import csv
import os
from collections.abc import Iterator
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakesift.functions import lexicon
from lakesift.functions.matching import format_examples, format_time
from lakesift.operators.detection import long_findings

# The words and layout of the report and of the log.
TITLE, DATE = "# Отчёт сканирования персональных данных (152-ФЗ)", "**Дата:** {}  "
ALL, WITH, WITHOUT = "**Всего файлов:** {}  ", "**С ПДн:** {}  ", "**Без ПДн:** {}"
LEVELS_HEAD = ("## Сводка по уровням защищённости", "", "| УЗ | Файлов | Описание |", "|----|-------|----------|")
NOT_FOUND = "| — | {} | ПДн не обнаружены |"
CATEGORIES_HEAD = ("## Категории ПДн (суммарно по всем файлам)", "", "| Категория | Находок |", "|-----------|--------:|")
FILES_HEAD = "## Файлы с обнаруженными ПДн"
FORMAT, SIZE, BYTES, NO_SIZE = "- Формат: ", " · Размер: ", " байт", "н/д"
LEVEL, FINDINGS, CATEGORY_LIST, EACH, ADVICE = "- **УЗ: ", "** · Находок: ", "- Категории:", " экз — ", "- Рекомендация: "
DEBUG_MATCHES, LOG_REASONS = 5, 5


def result_rows(decisions: DataFrame, media: DataFrame) -> DataFrame:
    """Size, time and name of files with personal data, one for each name, and of media files with other names.

    Takes rows of name, size, mtime and ``ord`` (which of equal names counts), decisions with ``is_pdn`` too.
    """
    first = F.min(F.struct("ord", "path", "size", "mtime")).alias("f")
    pick = lambda df: df.groupBy("name").agg(first).select("f.size", "f.mtime", "name")
    kept = pick(decisions.where("is_pdn"))
    other = pick(media).join(kept.select("name"), "name", "left_anti")
    out = ["size", format_time(F.col("mtime")).alias("time"), "name"]
    return kept.select(*out).unionByName(other.select(*out))


def level_counts(decisions: DataFrame) -> DataFrame:
    """Documents with personal data at each protection level, levels without any too."""
    spark = decisions.sparkSession
    levels = spark.createDataFrame([(k, v[0]) for k, v in lexicon.LEVELS.items()], "uz string, description string")
    counts = decisions.groupBy("uz").agg(F.count_if("is_pdn").alias("files"))
    return F.broadcast(levels).join(counts, "uz", "left").select("uz", F.coalesce("files", F.lit(0)).alias("files"), "description")


def category_totals(decisions: DataFrame) -> DataFrame:
    """Findings of each category over the rows with personal data (``detail``, or ``found`` where findings are only counted, is null in the others)."""
    size = lambda k: F.col("found")[k] if "found" in decisions.columns else F.size(F.col("detail")[k]).cast("long")
    sums = decisions.agg(*[F.sum(size(k)).alias(k) for k in lexicon.CATEGORIES])
    each = [F.struct(F.lit(k).alias("category"), F.col(k).alias("findings")) for k in lexicon.CATEGORIES]
    return sums.select(F.explode(F.array(*each)).alias("x")).select("x.category", "x.findings").where("findings > 0")


def _or(df: DataFrame, name: str, otherwise: str):
    """A column, or a value of its kind where there is none."""
    return F.col(name) if name in df.columns else F.expr(otherwise)


def debug_rows(decisions: DataFrame, most: int = DEBUG_MATCHES) -> DataFrame:
    """One row for each decision, as text ready for CSV.

    ``elapsed_sec`` is the time that Python took to extract a text; texts that Spark reads as part of a whole scan have none of their own (0.00).
    """
    some = F.transform_values("matches", lambda _, v: F.slice(v, 1, most))
    return decisions.select(
        "name",
        "top_dir",
        _or(decisions, "kind", "''").alias("kind"),
        F.col("is_pdn").cast("int").alias("is_pdn"),
        "uz",
        F.format_string("%.2f", "doc_score").alias("doc_score"),
        F.format_string("%.2f", _or(decisions, "elapsed_sec", "0D")).alias("elapsed_sec"),
        _or(decisions, "ocr_source", "''").alias("ocr_source"),
        F.array_join("reasons", " | ").alias("reasons"),
        F.to_json(some).alias("matches"),
    )


def log_lines(decisions: DataFrame, total: int) -> Iterator[str]:
    """Two lines for each decision, in the order of ``scan_order``; rows stream through the driver."""
    counts = F.to_json(F.transform_values("matches", lambda _, v: F.size(v)))
    about = F.concat_ws(
        " ",
        F.when(F.col("is_pdn"), "    PDN ").otherwise("    CLEAN"),
        F.concat(F.lit("kind="), _or(decisions, "kind", "''")),
        F.concat(F.lit("uz="), "uz"),
        F.format_string("score=%.2f", "doc_score"),
        F.format_string("t=%.2fs", _or(decisions, "elapsed_sec", "0D")),
        F.concat(F.lit("ocr="), F.coalesce(F.nullif(_or(decisions, "ocr_source", "''"), F.lit("")), F.lit("-"))),
        F.concat(F.lit("reasons="), F.array_join(F.slice("reasons", 1, LOG_REASONS), " | ")),
        F.concat(F.lit("matches="), counts),
    )
    rows = scan_order(decisions).select(F.concat_ws("/", "top_dir", "name").alias("file"), about.alias("about"))
    for n, r in enumerate(rows.toLocalIterator(), 1):
        yield f"[{n}/{total}] {r['file']}"
        yield r["about"]


def scan_order(decisions: DataFrame) -> DataFrame:
    """Data files, then texts, then images, each by lower-case name."""
    return decisions.orderBy(F.array_position(F.array(*map(F.lit, ("data", "text", "images"))), F.col("top_dir")), F.lower("name"), "path")


def file_blocks(decisions: DataFrame) -> DataFrame:
    """The report's paragraph on each file with personal data: path and block."""
    lines = []
    for key, label in lexicon.CATEGORIES.items():
        found = F.col("detail")[key]
        text = F.concat(F.lit(f"  - {label}: "), F.size(found).cast("string"), F.lit(EACH), format_examples(found))
        lines.append(F.when(F.size(found) > 0, text))
    advice = F.create_map(*[F.lit(x) for k, v in lexicon.LEVELS.items() for x in (k, v[1])])
    total = sum((F.size(F.col("detail")[k]) for k in lexicon.CATEGORIES), F.lit(0))
    block = F.concat_ws(
        "\n",
        F.concat(F.lit("### `"), F.col("path"), F.lit("`")),
        F.concat(F.lit(FORMAT), F.upper(F.ltrim(F.col("ext"), F.lit("."))), F.lit(SIZE), F.coalesce(F.concat(F.format_number("size", 0), F.lit(BYTES)), F.lit(NO_SIZE))),
        F.concat(F.lit(LEVEL), F.col("uz"), F.lit(FINDINGS), total.cast("string")),
        F.when(total > 0, F.lit(CATEGORY_LIST)),
        *lines,
        F.concat(F.lit(ADVICE), F.try_element_at(advice, F.col("uz"))),
    )
    return decisions.where("is_pdn").select("path", block.alias("block"))


def write_csv(rows: DataFrame, path: str) -> str:
    """Rows as one CSV file, streamed through the driver; where ``path`` cannot be written, ``…_new``."""
    try:
        out = open(path, "w", newline="", encoding="utf-8")
    except PermissionError:
        path = "_new".join(os.path.splitext(path))
        out = open(path, "w", newline="", encoding="utf-8")
    with out:
        writer = csv.writer(out)
        writer.writerow(rows.columns)
        writer.writerows(rows.toLocalIterator())
    return path


def write_markdown(decisions: DataFrame, media_count: int, path: str, when: datetime | None = None) -> None:
    """The report: totals, levels, categories, then a block for each file; blocks stream through the driver."""
    seen = decisions.agg(F.count("*").alias("total"), F.count_if("is_pdn").alias("pdn")).first()
    total, pdn = seen["total"], seen["pdn"]
    counts = {r["uz"]: r["files"] for r in level_counts(decisions).collect()}
    found = {r["category"]: r["findings"] for r in category_totals(decisions).collect()}
    with open(path, "w", encoding="utf-8") as out:
        say = lambda *lines: print(*lines, sep="\n", file=out)
        say(TITLE, "", DATE.format((when or datetime.now()).strftime("%Y-%m-%d %H:%M:%S")))
        say(ALL.format(total + media_count), WITH.format(pdn), WITHOUT.format(total - pdn), "", *LEVELS_HEAD)
        say(*[f"| {uz} | {counts[uz]} | {text} |" for uz, (text, _) in lexicon.LEVELS.items()], NOT_FOUND.format(total - pdn), "")
        if found:
            say(*CATEGORIES_HEAD, *[f"| {label} | {found[key]} |" for key, label in lexicon.CATEGORIES.items() if key in found], "")
        if pdn:
            say(FILES_HEAD, "")
            for row in file_blocks(scan_order(decisions)).toLocalIterator():
                say(row["block"], "")


__all__ = ["category_totals", "debug_rows", "file_blocks", "level_counts", "log_lines", "long_findings", "result_rows", "scan_order", "write_csv", "write_markdown"]
