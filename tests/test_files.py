"""Sources, placement and reports on files in a temporary folder."""

import csv
import io
import json
import os
import zipfile

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from lakesift import cli
from lakesift.operators import detection, organize, report
from lakesift.sources import files, ocr
from lakesift.streaming.detect import detect_stream


def tree(root):
    for d in ("data", "text/deep", "images", "other"):
        (root / d).mkdir(parents=True)
    (root / "text/a.txt").write_bytes("Иванов Пётр\x0c и  Анна Смирнова\r\n".encode())
    (root / "text/deep/a.txt").write_bytes(b"\xff\xfe plain")
    (root / "data/c.csv").write_bytes(b"name,mail\r\nx,x.y@example.com\n")
    pd.DataFrame({"a": [1, 2], "b": ["x y", None]}).to_parquet(root / "data/p.parquet")
    (root / "data/broken.parquet").write_bytes(b"no table")
    (root / "images/i.tif").write_bytes(b"II\x2a\x00scan")
    (root / "other/v.mp4").write_bytes(b"0")
    (root / "other/_hidden.pdf").write_bytes(b"%PDF-1.7")
    return root


def test_texts_to_report(spark, tmp_path):
    root = tree(tmp_path / "corpus")
    texts = files.texts(spark, str(root), ocr=lambda b: "Surname Given names Nationality Date of birth")
    got = {r["rel"]: r["text"] for r in texts.collect()}
    assert got["data/c.csv"] == "name,mail\r\nx,x.y@example.com\n"[:-1]
    assert got["data/p.parquet"] == 'a b\n1 "x y"\n2 None\n' and got["data/broken.parquet"] == ""
    assert got["text/deep/a.txt"] == "�� plain"
    done = detection.with_findings(detection.detect(texts))
    assert {r["rel"] for r in done.where("is_pdn").collect()} == {"text/a.txt", "data/c.csv", "images/i.tif"}
    report.write_markdown(done, files.media(files.scan(spark, str(root))).count(), str(tmp_path / "r.md"))
    text = (tmp_path / "r.md").read_text()
    assert "**Всего файлов:** 7" in text and "**С ПДн:** 3" in text and "| ФИО | 2 |" in text and "- Рекомендация: " in text
    assert report.debug_rows(done).count() == 6
    rows = report.result_rows(done.withColumn("ord", F.lit(1)), files.media(files.scan(spark, str(root))).withColumn("ord", F.lit(2)))
    path = report.write_csv(rows.orderBy(F.lower("name")), str(tmp_path / "result.csv"))
    assert [x.rsplit(",", 1)[1] for x in open(path).read().split()[0:1]] == ["name"]
    assert {r["name"] for r in rows.collect()} == {"a.txt", "c.csv", "i.tif", "v.mp4"}
    assert report.long_findings(done).where("category = 'name'").count() == 2


def archive(*members):
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        for name, text in members:
            z.writestr(name, text)
    return raw.getvalue()


def test_organize(spark, tmp_path):
    root = tree(tmp_path / "corpus")
    plan = organize.plan(files.walk(spark, str(root)))
    out = str(tmp_path / "out")
    assert organize.apply(plan, out, dry_run=True).where("action like '[DRY-RUN] copy %' and target_path is null").count() == 8 and not os.path.exists(out)
    for _ in range(2):  # a second run, or a task that runs again, changes nothing
        done = organize.apply(plan, out).collect()
        assert {r["action"] for r in done} == {"скопирован"} and all(r["error"] is None for r in done)
        assert sorted(os.listdir(f"{out}/text")) == ["a.txt", "a_1.txt", "c.csv"] or sum(len(n) for _, _, n in os.walk(out)) == 8
    assert os.path.exists(f"{out}/pdf/_hidden.pdf") and os.path.exists(f"{out}/images/i.tif")
    placed = files.walk(spark, out).withColumn("top_dir", F.element_at(F.split("path", "/"), -2))
    assert {r["accuracy"] for r in organize.verify(placed).collect()} == {100.0}


def test_placement_goes_on(spark, tmp_path):
    source, out = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    for name in "ab":
        (source / f"{name}.txt").write_text(name)
    plan = organize.plan(files.walk(spark, str(source)), action="symlink").persist()
    assert plan.count() == 2
    (out / "text").mkdir(parents=True)
    (out / "text/a.txt").write_text("another file of that name")
    assert {r["action"] for r in organize.apply(plan, str(out)).collect()} == {"симлинк"}
    assert sorted(os.listdir(out / "text")) == ["a.txt", "a_1.txt", "b.txt"] and os.readlink(out / "text/b.txt") == "../../in/b.txt"
    os.unlink(source / "a.txt")
    done = {os.path.basename(r["original_path"]): r for r in organize.apply(plan.withColumn("action", F.lit("copy")), str(tmp_path / "more")).collect()}
    assert done["a.txt"]["error"] and done["a.txt"]["action"] is None and done["b.txt"]["error"] is None
    lines = list(organize.statistics_lines(organize.apply(plan.withColumn("action", F.lit("copy")), str(tmp_path / "more"))))
    assert any("Ошибка при обработке a.txt" in x for x in lines) and "Обработано файлов: 1" in lines


def test_organize_command(spark, tmp_path, capsys):
    root, out = tree(tmp_path / "corpus"), str(tmp_path / "out")
    (root / "other/z.zip").write_bytes(archive(("d/x.txt", "one"), ("x.txt", "%PDF-1.7 two")))
    (root / "other/bad.zip").write_bytes(b"PK\x03\x04 broken")
    assert cli.main(["organize", str(root), "--mode", "copy"]) == 1 == cli.main(["organize", str(root / "none")])
    assert cli.main(["organize", str(root), "--mode", "copy", "-o", out, "--dry-run", "-r", str(tmp_path / "dry.json")]) == 0
    assert not os.path.exists(tmp_path / "dry.json") and "Для применения" in capsys.readouterr().out
    assert cli.main(["organize", str(root), "--mode", "copy", "-o", out, "--extract-archives", "-r", str(tmp_path / "m.json")]) == 0
    m = json.load(open(tmp_path / "m.json"))
    assert len(m["files"]) == 10 == m["summary"]["total"]["files_processed"] and m["mode"] == "copy" and not m["summary"]["total"]["dry_run"]
    one = m["files"][f"{out}/archives/z.zip"]
    assert set(one) == {"original_path", "target_path", "size_bytes", "detected_folder", "detected_format", "is_spoofed", "spoof_note", "action"}
    assert m["x.txt"] == {"original_path": f"{out}/archives/z.zip", "extracted_from": "z.zip", "folder": "text", "format": "TEXT", "spoof": None}
    assert m["x_1.txt"]["folder"] == "pdf" and open(f"{out}/archives/_extracted_z/x.txt").read() == "one"
    assert sum(v["count"] for k, v in m["summary"].items() if k != "total") == 10
    # moving keeps inside the directory, and a second run finds all in place
    for _ in range(2):
        assert cli.main(["organize", str(root), "--no-unknown"]) == 0
    assert sum(len(n) for _, _, n in os.walk(root)) == 10 and os.path.exists(root / "pdf/_hidden.pdf")
    capsys.readouterr()
    assert cli.main(["organize", str(root), "--verify"]) == 0
    assert "pdf/: 1/1 правильных (100.0%)" in capsys.readouterr().out


def test_scan_command(spark, tmp_path, capsys):
    root = tree(tmp_path / "corpus")
    assert cli.main(["scan", str(root)]) == 0
    said = capsys.readouterr().out
    assert "[1/6] data/" in said and "PDN  kind=txt uz=" in said and (root / "scan_all.log").read_text() in said
    debug = list(csv.DictReader(open(root / "scan_debug.csv", encoding="utf-8")))
    assert list(debug[0]) == ["name", "top_dir", "kind", "is_pdn", "uz", "doc_score", "elapsed_sec", "ocr_source", "reasons", "matches"]
    assert {r["kind"] for r in debug} == {"csv", "parquet", "txt", "image"} and [r["ocr_source"] for r in debug if r["kind"] == "image"] == ["failed"]
    result = [r["name"] for r in csv.DictReader(open(root / "result.csv", encoding="utf-8"))]
    assert result == sorted(result, key=str.lower) == ["a.txt", "c.csv", "v.mp4"]
    report_file = next(root.glob("pdn_report_*.md")).read_text()
    assert "**Дата:** 20" in report_file and "**Всего файлов:** 7" in report_file


def test_missing_size(spark):
    rows = spark.createDataFrame([("p/a.txt", None, ".txt", True, "УЗ-4")], "path string, size long, ext string, is_pdn boolean, uz string")
    empty = F.struct(*[F.array().cast("array<string>").alias(k) for k in report.lexicon.CATEGORIES])
    assert "Размер: н/д" in report.file_blocks(rows.withColumn("detail", empty)).first()["block"]


def test_ocr():
    grey = np.zeros((40, 60), np.uint8)
    grey[10:30, 20:40] = 200
    pictures = ocr.preparations(grey)
    assert [p.shape for p in pictures] == [(80, 120)] * 4 and all(p.dtype == np.uint8 for p in pictures)
    assert set(np.unique(ocr.two_levels(grey))) == {0, 255} and (ocr.two_levels(grey) == 255).sum() == 400
    assert set(np.unique(ocr.local_threshold(grey))) <= {0, 255} and np.array_equal(ocr.equalized(np.full((3, 3), 7, np.uint8)), np.full((3, 3), 7))
    flat = np.full((9, 9), 100, np.uint8)
    assert (ocr.sharpened(flat) == 100).all() and (ocr.upscaled(flat) == 100).all() and ocr.equalized_in_tiles(flat).shape == (9, 9)
    asked = []

    def engine(picture, language, layout):
        asked.append((layout, language))
        if language == "eng+rus":
            raise RuntimeError("no such language")
        return " a  b\f" if layout == 6 else ""

    read = ocr.backend(engine, lambda b: (grey, "converted_jpg"))
    assert read(b"x") == ("\n".join(["a b"] * 4), "converted_jpg") and len(asked) == 4 * (2 + 3 + 3)

    def broken(_):
        raise OSError

    assert ocr.backend(engine, broken)(b"") == ("", "failed")


def test_unzip(spark):
    raw = archive(("a/x.txt", "one"), ("../x.txt", "two"))
    df = spark.createDataFrame([("a.zip", bytearray(raw)), ("b.zip", bytearray(b"PK")), ("c.txt", bytearray(b""))], "path string, content binary")
    assert sorted((r["name"], bytes(r["header"])) for r in organize.unzip(df).collect()) == [("x.txt", b"one"), ("x_1.txt", b"two")]


def test_stream(spark, tmp_path):
    root = tree(tmp_path / "corpus")
    query = detect_stream(spark, str(root)).writeStream.format("memory").queryName("seen").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert spark.table("seen").where("is_pdn").count() == 1
