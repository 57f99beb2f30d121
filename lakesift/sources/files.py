"""File trees as rows, and files as texts."""

from __future__ import annotations

import io
import os
import time
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakesift.operators.formats import HEADER_BYTES, extension

# Limits of what is taken from a file, and which files are candidates.
MAX_CHARS, MAX_LINES, MAX_ROWS = 1_500_000, 5_000, 3_000
KINDS = {"data": (".csv", ".parquet"), "text": (".txt",), "images": (".tif", ".tiff")}
PRUNED = {".git", "__pycache__", "node_modules", ".venv", "venv", "pdn_reports", "pdn_scan_results"}


def scan(spark: SparkSession, root: str) -> DataFrame:
    """Every file under ``root``: path, rel, name, top_dir, ext, size, mtime, content.

    Columns not used are not read: without ``content`` only the listing runs.  Spark's lister leaves out names that start
    with ``_`` or ``.``; ``walk`` does not.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/").rsplit("/", 1)[-1]
    rel = F.substring_index(F.col("path"), f"/{base}/", -1) if base else F.col("path")
    return files.select(
        "path",
        rel.alias("rel"),
        F.substring_index("path", "/", -1).alias("name"),
        F.when(rel.contains("/"), F.substring_index(rel, "/", 1)).otherwise("").alias("top_dir"),
        extension(F.col("path")).alias("ext"),
        F.col("length").alias("size"),
        F.col("modificationTime").alias("mtime"),
        "content",
    )


def _into(folders: list[str]) -> list[str]:
    return sorted(f for f in folders if f not in PRUNED and not f.startswith("_extracted_"))


def walk(spark: SparkSession, root: str) -> DataFrame:
    """Every file of a tree that driver and executors can open, hidden names too, with path, name, size and header.

    The driver only lists as many folders as keep the executors busy; they walk on from there and read the headers.
    Links to folders are not followed; a file that cannot be read has a null header and size.
    """

    def headers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for top, deep in zip(batch["folder"], batch["deep"]):
                for folder, folders, names in os.walk(top):
                    folders[:] = _into(folders) if deep else []
                    rows = []
                    for name in sorted(names):
                        path = os.path.join(folder, name)
                        if not os.path.isfile(path):
                            continue
                        try:
                            with open(path, "rb") as f:
                                rows.append((path, name, os.path.getsize(path), f.read(HEADER_BYTES)))
                        except OSError:
                            rows.append((path, name, None, None))
                    yield pd.DataFrame(rows, columns=["path", "name", "size", "header"]).astype({"size": "Int64"})

    enough, shallow, deep = 4 * spark.sparkContext.defaultParallelism, [], [root]
    while deep and len(deep) < enough:
        shallow += deep
        deep = [e.path for top in deep for e in _folders(top)]
    tops = spark.createDataFrame([(f, False) for f in shallow] + [(f, True) for f in deep], "folder string, deep boolean")
    return tops.repartition(max(1, min(enough, len(shallow) + len(deep)))).mapInPandas(headers, "path string, name string, size long, header binary")


def _folders(top: str) -> list[os.DirEntry]:
    try:
        with os.scandir(top) as entries:
            found = {e.name: e for e in entries if e.is_dir(follow_symlinks=False)}
    except OSError:
        return []
    return [found[n] for n in _into(list(found))]


def candidates(files: DataFrame) -> DataFrame:
    """Files of a kind that the scanner takes, by first folder and extension."""
    cond = F.lit(False)
    for top, exts in KINDS.items():
        cond |= (F.col("top_dir") == top) & F.col("ext").isin(*exts)
    return files.where(cond)


def media(files: DataFrame) -> DataFrame:
    return files.where("ext = '.mp4'")


def with_header(files: DataFrame) -> DataFrame:
    return files.withColumn("header", F.substring("content", 1, HEADER_BYTES)).drop("content")


def decoded(content: Column) -> Column:
    """UTF-8 with bad bytes replaced."""
    return F.make_valid_utf8(content.cast("string"))


def plain_text(content: Column) -> Column:
    return F.left(F.regexp_replace(decoded(content), "\r\n?", "\n"), F.lit(MAX_CHARS))


def first_lines(text: Column, most: int = MAX_LINES) -> Column:
    """The first lines as they are, the heading too; a carriage return stays."""
    lines = F.regexp_extract_all(text, F.lit(r"(?s)[^\r\n]*(?:\r\n|\n|\r)|[^\r\n]+$"), F.lit(0))
    return F.array_join(F.transform(F.slice(lines, 1, most), lambda x: F.regexp_replace(x, "\n$", "")), "\n")


def _table(content: bytes) -> str:
    rows = next(pq.ParquetFile(io.BytesIO(content)).iter_batches(MAX_ROWS), None)
    frame = pd.read_parquet(io.BytesIO(content)) if rows is None else rows.to_pandas()
    return frame.astype(str).to_csv(index=False, sep=" ")


def _read(read: Callable[[bytes], str | tuple[str, str]], source: str) -> Callable:
    """Rows with content to rows with text, seconds, and where the text is from; what cannot be read is empty, from ``failed``.

    ``read`` returns the text, or the text and its source.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for content in batch["content"]:
                began = time.perf_counter()
                try:
                    got = read(bytes(content))
                    text, whence = got if isinstance(got, tuple) else (got, source)
                except Exception:  # any damage counts as an empty file
                    text, whence = "", "failed" if source else ""
                out.append((text[:MAX_CHARS], time.perf_counter() - began, whence))
            told = pd.DataFrame(out, columns=["text", "elapsed_sec", "ocr_source"], index=batch.index)
            yield batch.drop(columns="content").join(told)

    return run


#: Maps the bytes of an image to its text, or to the text and where it is from.
OcrBackend = Callable[[bytes], str | tuple[str, str]]


def _no_ocr(_: bytes) -> tuple[str, str]:
    return "", "failed"


def texts(spark: SparkSession, root: str, ocr: OcrBackend | None = None) -> DataFrame:
    """One row for each candidate file with its ``text``, ``kind``, the seconds Python took and where an image's text is from (``ocr_source``).

    Without ``ocr`` (see ``lakesift.sources.ocr``) the texts of images are empty.
    """
    files = candidates(scan(spark, root))
    keep = ["path", "rel", "name", "top_dir", "ext", "size", "mtime"]
    schema = "path string, rel string, name string, top_dir string, ext string, size long, mtime timestamp, text string, elapsed_sec double, ocr_source string"
    native = lambda ext, text: files.where(F.col("ext") == ext).select(*keep, text.alias("text"), F.lit(0.0).alias("elapsed_sec"), F.lit("").alias("ocr_source"))
    csv, text = native(".csv", first_lines(decoded(F.col("content")))), native(".txt", plain_text(F.col("content")))
    tables = files.where("ext = '.parquet'").select(*keep, "content").mapInPandas(_read(_table, ""), schema)
    images = files.where("top_dir = 'images'").select(*keep, "content").mapInPandas(_read(ocr or _no_ocr, "original_image"), schema)
    kinds = ((csv, "csv"), (tables, "parquet"), (text, "txt"), (images, "image"))
    out = [df.withColumn("kind", F.lit(kind)) for df, kind in kinds]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])
