"""True formats from leading bytes, with a note where the extension disagrees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEADER_BYTES = 512

# Magic bytes, their offset, folder, label and usual extensions; the first that fits counts.
SIGNATURES = (
    (b"%PDF", 0, "pdf", "PDF", (".pdf",)),
    (b"PK\x03\x04", 0, "archives", "ZIP", (".zip", ".docx", ".xlsx", ".pptx", ".odt", ".ods", ".odp", ".epub", ".jar", ".apk")),
    (b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1", 0, "office", "OLE2 (DOC/XLS/PPT)", (".doc", ".xls", ".ppt")),
    (b"{\\rtf", 0, "office", "RTF", (".rtf",)),
    (b"\x89PNG\r\n\x1a\n", 0, "images", "PNG", (".png",)),
    (b"\xff\xd8\xff", 0, "images", "JPEG", (".jpg", ".jpeg")),
    (b"GIF87a", 0, "images", "GIF", (".gif",)),
    (b"GIF89a", 0, "images", "GIF", (".gif",)),
    (b"BM", 0, "images", "BMP", (".bmp",)),
    (b"II\x2a\x00", 0, "images", "TIFF", (".tif", ".tiff")),
    (b"MM\x00\x2a", 0, "images", "TIFF", (".tif", ".tiff")),
    (b"\x00\x00\x00\x18ftypmp4", 4, "video", "MP4", (".mp4",)),
    (b"\x00\x00\x00\x1cftypisom", 4, "video", "MP4", (".mp4",)),
    (b"RIFF", 0, "video", "AVI", (".avi",)),
    (b"OggS", 0, "video", "OGG", (".ogv", ".ogg")),
    (b"\x1f\x8b", 0, "archives", "GZIP", (".gz", ".tgz")),
    (b"7z\xbc\xaf'\x1c", 0, "archives", "7ZIP", (".7z",)),
    (b"Rar!\x1a\x07", 0, "archives", "RAR", (".rar",)),
    (b"SQLite format 3\x00", 0, "sqlite", "SQLite3", (".sqlite", ".db", ".sqlite3")),
    (b"\x7fELF", 0, "binary", "ELF", (".elf",)),
    (b"MZ", 0, "binary", "PE (EXE/DLL)", (".exe", ".dll")),
    (b"<?xml", 0, "data", "XML", (".xml", ".xaml", ".svg")),
    (b"<html", 0, "html", "HTML", (".html", ".htm")),
    (b"<!DOCTYPE html", 0, "html", "HTML", (".html", ".htm")),
    (b"PAR1", 0, "data", "Parquet", (".parquet",)),
)
# Notes.
UNREADABLE, PERHAPS, UNSURE = "не удалось прочитать", "возможно подмена", "неопределённый формат"
# What an extension alone tells: extensions, folder, label ({} is the extension in capitals), note.
# Extensions in one string are looked for within it, so that an empty one is found in ".pdf".
BY_EXTENSION = (
    (".pdf", "pdf", "PDF (по расширению, неподтверждённый)", PERHAPS),
    ((".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx", ".odt", ".ods"), "office", "{} (по расширению)", PERHAPS),
    ((".html", ".htm"), "html", "HTML (по расширению)", PERHAPS),
    ((".txt", ".md", ".rst", ".log"), "text", "TEXT", None),
    ((".csv", ".tsv"), "data", "{}", None),
    ((".json", ".jsonl"), "data", "JSON", None),
    (".xml", "data", "XML", None),
    (".parquet", "data", "PARQUET", None),
    ((".sqlite", ".db"), "sqlite", "SQLite", None),
    ((".jpg", ".jpeg", ".png", ".gif", ".bmp", ".tif", ".tiff"), "images", "{}", None),
    ((".mp4", ".avi", ".mov", ".mkv"), "video", "{}", None),
    ((".zip", ".7z", ".rar", ".gz"), "archives", "{}", None),
)


def extension(name: Column) -> Column:
    """Lower-case suffix with its dot; none for a name that only starts or ends with a dot."""
    return F.lower(F.regexp_extract(name, r"(?s)[^/](\.[^./]+)$", 1))


def sniff(header: Column, ext: Column) -> Column:
    """Struct of ``folder``, ``label`` and ``note`` (null: as expected) from the first 512 bytes; a null header is unreadable."""
    out = lambda folder, label, note: F.struct(
        F.lit(folder).alias("folder"), label.alias("label"), note.alias("note")
    )
    none = F.lit(None).cast("string")
    case = F.when(header.isNull(), out("unknown", F.lit("ERROR_READ"), F.lit(UNREADABLE)))
    n = F.length(header)
    for magic, at, folder, label, exts in SIGNATURES:
        hit = (n > at + len(magic)) & (F.substring(header, at + 1, len(magic)) == F.lit(bytearray(magic)))
        other = F.concat(F.lit("расширение '"), ext, F.lit(f"' не соответствует формату {label}"))
        case = case.when(hit, out(folder, F.lit(label), F.when(ext.isin("", *exts), none).otherwise(other)))
    sample = F.lower(F.replace(F.make_valid_utf8(F.substring(header, 1, 200).cast("string")), F.lit("�"), F.lit("")))
    json = sample.rlike(r"(?U)^[\s\x1c-\x1f]*[{\[]") & sample.contains('"') & sample.contains(":")
    rest = F.regexp_replace(F.decode(header, "ISO-8859-1"), r"[^\x20-\x7e\t\n\r]", "")
    case = (
        case.when(sample.contains("<html") | sample.contains("<!doctype html"), out("html", F.lit("HTML (detected)"), none))
        .when(json, out("data", F.lit("JSON"), none))
        .when(F.length(rest) / F.greatest(n, F.lit(1)) > 0.7, out("text", F.lit("TEXT"), none))
    )
    for exts, folder, label, note in BY_EXTENSION:
        hit = F.lit(exts).contains(ext) if isinstance(exts, str) else ext.isin(*exts)
        capitals = F.upper(F.substr(ext, F.lit(2)))
        text = F.lit(label) if "{}" not in label else F.concat(capitals, F.lit(label.replace("{}", "")))
        case = case.when(hit, out(folder, text, F.lit(note).cast("string")))
    return case.otherwise(out("unknown", F.lit("UNKNOWN"), F.lit(UNSURE)))


def detect_formats(files: DataFrame) -> DataFrame:
    """Add ``detected_folder``, ``detected_format``, ``spoof_note`` and ``is_spoofed`` to rows of ``name`` and ``header``."""
    found = files.withColumn("found", sniff(F.col("header"), extension(F.col("name"))))
    return found.withColumns(
        {
            "detected_folder": F.col("found.folder"),
            "detected_format": F.col("found.label"),
            "spoof_note": F.col("found.note"),
            "is_spoofed": F.col("found.note").isNotNull(),
        }
    ).drop("found")
