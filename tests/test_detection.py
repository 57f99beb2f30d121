"""Detectors against small cases and a plain Python model."""

import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lakesift.functions import checksums, patterns
from lakesift.functions import matching as M
from lakesift.operators import detection


def column(spark, values, made):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], "t string").select(made(F.col("t"))).collect()]


def test_checksums(spark):
    assert column(spark, ["4111 1111 1111 1111", "4111111111111112", "0", "", None, "٤١١١١١١١١١١١١١١١"], checksums.luhn_valid) == [True] + [False] * 5
    assert column(spark, ["112-233-445 95", "112-233-445 96", "", None], checksums.snils_valid) == [True, False, False, False]
    assert column(spark, ["7707083893", "7707083894", "500100732259", "500100732258", None], checksums.inn_valid) == [True, False, True, False, False]


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet="12 .ж😀\n", max_size=30), min_size=1, max_size=20))
def test_spans_are_code_points(spark, texts):
    rx = r"\d{2}"
    got = column(spark, texts, lambda c: M.spans(c, rx))
    assert [[(x["m"], x["pos"]) for x in row] for row in got] == [[(m[0], m.start()) for m in re.finditer(rx, t)] for t in texts]


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet="аб вг", max_size=20), min_size=1, max_size=20))
def test_occurrences(spark, texts):
    words = ("аба", "ба", "вв")

    def model(t):
        seen, out = set(), []
        for w in words:
            for p in range(len(t)):
                if t.startswith(w, p) and p not in seen:
                    seen.add(p)
                    s = t[max(0, p - 2) : p + len(w) + 2].strip()
                    out.append("*" * len(s) if len(s) <= 4 else s[:2] + "*" * (len(s) - 4) + s[-2:])
        return out

    assert column(spark, texts, lambda c: M.occurrences(c, c, words)) == [model(t) for t in texts]
    assert column(spark, texts, lambda c: M.count_occurrences(c, words)) == [len(model(t)) for t in texts]


def test_overlaps_and_windows(spark):
    assert column(spark, ["ааа"], lambda c: M.count_occurrences(c, ("аа",))) == [2]
    text = "x" * 60 + "123456" + "y" * 34 + "ул"
    assert column(spark, [text, text + "ица", "ул 123456", None], lambda c: M.size(M.in_context(c, c, patterns.INDEX, ("ул",), 40))) == [0, 0, 1, 0]


def test_detect(spark):
    rows = [
        (1, "text", "a.txt", "Пишите: ivan@example.com"),
        (2, "text", "b.txt", "Иванов Пётр и Анна Смирнова"),
        (3, "text", "c.txt", "Нижний Новгород и Степана Разина"),
        (4, "images", "d.tif", "Surname Given names Nationality Date of birth"),
        (5, "text", "e.txt", None),
        (6, "text", "f.txt", " \n "),
        (7, "data", "g.csv", "диагноз"),
        (8, "data", "g.csv", "ничего " * 20_000),
    ]
    df = spark.createDataFrame(rows, "path long, top_dir string, name string, text string").withColumn("rule", F.lit(1))
    got = {r["path"]: r for r in detection.with_findings(detection.detect(df)).collect()}
    assert [got[i]["is_pdn"] for i in range(1, 9)] == [True, True, False, True, False, False, True, False]
    assert [got[i]["uz"] for i in (1, 5, 6, 7)] == ["УЗ-4", "—", "—", "УЗ-2"]
    assert got[1]["detail"]["email"] == ["iva**********com"] and got[1]["reasons"][0] == "strong"
    assert got[2]["reasons"] == ["fio_count=2"] and got[4]["reasons"][0] == "doc_score>=2"
    assert got[5]["reasons"] == ["empty"] and got[5]["detail"] is None and got[7]["detail"]["health"] == ["ди***оз"]
    assert detection.detect(df.limit(0)).count() == 0


def test_step_is_worked_out_once(spark):
    """Scores and reasons of texts of every kind at a cost that allows for millions: patterns and words are not looked for again for each use."""
    df = spark.createDataFrame([("text", "customers.csv", "Иванов Пётр")], "top_dir string, name string, text string")
    plan = detection.detect(df).select("reasons")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("lower(") <= 3 and plan.count("Contains(") < 150


def test_counts_are_those_of_findings(spark):
    texts = ["Иванов Пётр, г. Уфа 450000; диагноз диагноз вич", "e@x.ru отпечаток faceid 12.05.1990", "БИК 044525225 р/с 40817810000000000001", "ИНН 7707083893 партия", "", None]
    df = spark.createDataFrame([("text", "a.txt", t) for t in texts], "top_dir string, name string, text string")
    sizes = detection.with_findings(detection.detect(df)).select(*[F.size(F.col("detail")[k]).cast("long").alias(k) for k in detection.lexicon.CATEGORIES])
    found = detection.detect(df, count_findings=True).select(*[F.col("found")[k].alias(k) for k in detection.lexicon.CATEGORIES])
    none = lambda rows: sorted([repr([v if v != -1 else None for v in r]) for r in rows.collect()])
    assert none(found) == none(sizes)


def test_spans_and_blanks_by_offsets(spark):
    texts = ["12 34", "a12", "😀12.😀34", "", None]
    assert [[x["pos"] for x in r] for r in column(spark, texts, lambda c: M.spans(c, r"\d{2}"))] == [[0, 3], [1], [1, 5], [], []]
    texts = [f"{b}a{b}{b}b{b}" for b in map(chr, range(0x3001)) if not 0xD800 <= ord(b) < 0xE000]
    old = lambda c: F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "\f", " "), "[ \t]+", " "), r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")
    assert column(spark, texts, M.normalize) == column(spark, texts, old)


def test_words_by_first_letters(spark):
    texts = ["xул", "улица", "у", "г.", "г", "perdom", "", "дом", None]
    words = ("ул", "улица", "дом", "г.", "per")
    want = [any(w in t for w in words) if t is not None else False for t in texts]
    assert column(spark, texts, lambda c: M.contains_any(c, words)) == want
    assert column(spark, texts, lambda c: F.coalesce(c.rlike(M.grouped(words)), F.lit(False))) == want
