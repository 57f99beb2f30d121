"""Texts to detector groups, score, decision, protection level and masked findings.

Every step adds columns by built-in expressions: one narrow pass over the rows, no shuffle.
Null and empty texts get empty results: no group, score 0, level ``—`` and the reason ``empty``.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakesift.functions import checksums, lexicon, patterns
from lakesift.functions import matching as M

GROUPS = ("g_common", "g_gov", "g_pay", "g_bio", "g_special")
SIGNS = tuple(f"_{k}" for k in ("low", "digit", "cyrillic", "at", "runs", "phone", "mrz", "names"))


def person_names(c: Column) -> Column:
    """Names that hold no place or organisation word."""
    return no_places(M.extract(c, patterns.NAME))


def no_places(names: Column) -> Column:
    return F.filter(names, lambda n: ~F.lower(n).rlike(M.grouped(lexicon.TOPONYMS)))


def cards(c: Column, low: Column) -> Column:
    return M.in_context(c, low, patterns.CARD, lexicon.NEAR_CARD, 40, checksums.luhn_valid)


def signs(c: Column) -> dict[str, Column]:
    """What several detectors use, or what their patterns cannot do without: to be worked out once for a text (``with_signs``)."""
    digit = c.rlike(r"(?U)\d")
    return {
        "low": F.lower(c),
        "digit": F.coalesce(digit, F.lit(False)),
        "cyrillic": F.coalesce(c.rlike("[А-яЁё]"), F.lit(False)),
        "at": F.coalesce(c.contains("@"), F.lit(False)),
        # whole runs of digits, of nine or more
        "runs": M.only(digit, M.extract(c, r"(?U)\d{9,}"), M.none()),
        "phone": M.only(digit, M.extract(c, patterns.PHONE), M.none()),
        "mrz": M.count(c, patterns.MRZ),
        "names": M.extract(c, patterns.NAME),
    }


def with_signs(df: DataFrame, c: Column | None = None) -> DataFrame:
    """``df`` with its texts' signs as columns that begin with an underscore."""
    return worked_out(df, {f"_{k}": v for k, v in signs(F.col("text") if c is None else c).items()})


def _sign(name: str) -> Column:
    return F.col(f"_{name}")


def _emails(c: Column) -> Column:
    return M.only(_sign("at"), M.extract(c, patterns.EMAIL), M.none())


def _of_length(least: int, most: int) -> Column:
    """Runs of ``least`` to ``most`` digits, neither preceded nor followed by others."""
    return F.filter(_sign("runs"), lambda r: F.length(r).between(least, most))


def _near(c: Column, rx: str, words: tuple[str, ...], width: int, seen: Column | None = None, test: Callable[[Column], Column] | None = None) -> Column:
    seen = _sign("digit") if seen is None else seen
    found = M.in_context(c, _sign("low"), rx, words, width, test, _sign("cyrillic"))
    return M.only(seen, found, F.array().cast(M.SPAN))


def _snils(c: Column) -> Column:
    return M.only(_sign("digit") & c.contains("-"), M.extract(c, patterns.SNILS), M.none())


def _valid_inn(digits: int) -> Column:
    return F.filter(_of_length(digits, digits), checksums.inn12_valid if digits == 12 else checksums.inn10_valid)


def _after_word(c: Column, rx: str) -> Column:
    """Numbers of nine digits or more after a word."""
    return M.only(F.size(_sign("runs")) > 0, M.extract(c, rx, 1), M.none())


def parts(c: Column) -> dict[str, Column]:
    """How many there are of what the groups count, of rows ``with_signs``."""
    low, cyrillic, long = _sign("low"), _sign("cyrillic"), F.size(_sign("runs")) > 0
    near = lambda *about: M.size(_near(c, *about))
    flag = lambda cond: F.coalesce(cond, F.lit(False)).cast("long")
    return {
        "email": M.size(_emails(c)),
        "phone": M.size(_sign("phone")),
        "birth_near": near(patterns.BIRTH, lexicon.NEAR_BIRTH, 40),
        "address": near(patterns.INDEX, lexicon.NEAR_INDEX, 40),
        "snils": M.size(F.filter(_snils(c), checksums.snils_valid)),
        "inn": M.only(long, M.size(_valid_inn(12)) + M.size(_valid_inn(10))),
        "passport": near(patterns.PASSPORT, lexicon.NEAR_PASSPORT, 60),
        "licence": near(patterns.LICENCE, lexicon.NEAR_LICENCE, 30, long),
        "card": near(patterns.CARD, lexicon.NEAR_CARD, 40, None, checksums.luhn_valid),
        "account": M.size(_after_word(c, patterns.ACCOUNT)),
        "bik": M.size(_after_word(c, patterns.BIK)),
        "cvv": flag(low.contains("cv") & c.rlike(patterns.CVV)),
        "bio": flag(M.contains_any(low, lexicon.BIOMETRIC, cyrillic)),
        "special": flag(M.contains_any(low, lexicon.SPECIAL, cyrillic)),
    }


def groups(n: dict[str, Column]) -> dict[str, Column]:
    """Counts of the five groups, from ``parts`` of rows ``with_signs``."""
    return {
        "g_common": n["email"] + n["phone"] + F.least(M.size(_sign("names")), F.lit(10)) + n["birth_near"] + n["address"],
        "g_gov": n["snils"] + n["inn"] + n["passport"] + n["licence"] + (_sign("mrz") > 0).cast("long"),
        "g_pay": n["card"] + n["account"] + n["bik"] + n["cvv"],
        "g_bio": n["bio"],
        "g_special": n["special"],
    }


def level(g: dict[str, Column]) -> Column:
    """Protection level of a group vector."""
    total = sum((g[k] for k in GROUPS), F.lit(0))
    distinct = sum(((g[k] > 0).cast("int") for k in GROUPS), F.lit(0))
    heavy = (total >= 5) | (distinct >= 2)
    pick = lambda high, low: F.when(heavy, high).otherwise(low)
    return (
        F.when((g["g_special"] > 0) | (g["g_bio"] > 0), pick("УЗ-1", "УЗ-2"))
        .when((g["g_pay"] > 0) | (g["g_gov"] > 0), pick("УЗ-2", "УЗ-3"))
        .when(g["g_common"] > 0, pick("УЗ-3", "УЗ-4"))
        .otherwise(lexicon.NO_LEVEL)
    )


def score_parts(c: Column) -> dict[str, Column]:
    """What the score is made of, of rows ``with_signs``."""
    low, latin, cyrillic = _sign("low"), _sign("latin"), _sign("cyrillic")
    seen = lambda words, where: M.only(where, M.count_contained(low, words))
    script = lambda w: "latin" if re.search("[a-z]{3}", w) else "cyrillic" if re.search("[а-я]", w) else "other"
    words = {k: [w for w in lexicon.DOCUMENT_WORDS if script(w) == k] for k in ("latin", "cyrillic", "other")}
    return {
        "doc_words": seen(words["latin"], latin) + seen(words["cyrillic"], cyrillic) + seen(words["other"], F.octet_length(low) > F.length(low)),
        "doc_combo": seen(lexicon.IDENTITY_WORDS, latin) >= 3,
        "date_count": M.only(_sign("digit"), M.count(c, patterns.DATE)),
    }


def score(words: Column, zones: Column, dates: Column, combo: Column) -> tuple[Column, Column]:
    """How much a text looks like an identity document, and why."""
    value = (
        F.least(F.lit(3.0), words * F.lit(0.6))
        + F.least(F.lit(2.4), zones * F.lit(0.8))
        + F.when(dates >= 2, F.lit(0.8)).otherwise(F.lit(0.0))
        + F.when(combo, F.lit(1.0)).otherwise(F.lit(0.0))
    )
    why = F.array(
        F.when(words > 0, F.concat(F.lit("kw="), words.cast("string"))),
        F.when(zones > 0, F.lit("mrz")),
        F.when(dates >= 2, F.concat(F.lit("dates="), dates.cast("string"))),
        F.when(combo, F.lit("id_combo")),
    )
    return value, F.array_compact(why)


def with_score(df: DataFrame) -> DataFrame:
    """Rows ``with_signs`` with ``doc_score``, ``doc_reasons`` and ``date_count``; nobody who uses none of them pays for them."""
    df = df.withColumn("_latin", F.coalesce(_sign("low").rlike("[a-z]{3}"), F.lit(False)))
    df = df.withColumns({"date_count" if k == "date_count" else f"_{k}": v for k, v in score_parts(F.col("text")).items()})
    value, why = score(F.col("_doc_words"), _sign("mrz"), F.col("date_count"), F.col("_doc_combo"))
    return df.withColumns({"doc_score": value, "doc_reasons": why}).drop("_latin", "_doc_words", "_doc_combo")


def raw_values(c: Column) -> dict[str, Column]:
    """Distinct raw values of six kinds, in order of first occurrence, of rows ``with_signs``."""
    values = {
        "EMAIL": _emails(c),
        "PHONE": _sign("phone"),
        "SNILS": _snils(c),
        "INN": _of_length(12, 12),
        "PASSPORT_RU": M.only(_sign("digit"), M.extract(c, patterns.PASSPORT), M.none()),
        "FIO_RU": no_places(_sign("names")),
    }
    return {k: F.array_distinct(F.transform(v, M.strip)) for k, v in values.items()}


def matches(c: Column) -> Column:
    """``raw_values`` as a map; kinds without any are absent."""
    pairs = [x for k, v in raw_values(c).items() for x in (F.lit(k), v)]
    return F.map_filter(F.create_map(*pairs), lambda _, v: F.size(v) > 0)


def findings(c: Column) -> dict[str, Column]:
    """Masked values of each category, in report order, of rows ``with_signs``."""
    low = _sign("low")
    masked = lambda values, keep: F.transform(values, lambda v: M.mask(v, keep))
    around = lambda found: F.transform(found, lambda x: M.mask_around(c, x))
    each = lambda words: M.only(_sign("cyrillic") | low.rlike("[a-z]{3}"), M.occurrences(c, low, words), M.none())
    return {
        "name": masked(no_places(_sign("names")), 2),
        "birth": around(M.only(_sign("digit"), M.spans(c, patterns.BIRTH), F.array().cast(M.SPAN))),
        "email": masked(_emails(c), 3),
        "phone": masked(_sign("phone"), 3),
        "snils": masked(F.filter(_snils(c), checksums.snils_valid), 3),
        "address": around(_near(c, patterns.INDEX, lexicon.NEAR_INDEX, 40)),
        "card": masked(_near(c, patterns.CARD, lexicon.NEAR_CARD, 40, None, checksums.luhn_valid)["m"], 3),
        "health": each(lexicon.HEALTH),
        "inn": masked(F.concat(_valid_inn(12), _valid_inn(10)), 3),
        "biometric": each(lexicon.BIOMETRIC),
        "passport": masked(_near(c, patterns.PASSPORT, lexicon.NEAR_PASSPORT, 60)["m"], 2),
        "account": masked(_after_word(c, patterns.ACCOUNT), 3),
        "bik": masked(_after_word(c, patterns.BIK), 3),
        "politics": each(lexicon.POLITICS),
        "beliefs": each(lexicon.BELIEFS),
    }


def finding_counts(c: Column, n: dict[str, Column], names: Column) -> dict[str, Column]:
    """How many ``findings`` there are of each category, without masking any: ``parts`` that are counted already, and the others."""
    low, cyrillic = _sign("low"), _sign("cyrillic")
    words = {"health": lexicon.HEALTH, "biometric": lexicon.BIOMETRIC, "politics": lexicon.POLITICS, "beliefs": lexicon.BELIEFS}
    other = {k: M.only(M.contains_any(low, v, cyrillic), M.count_occurrences(low, v)) for k, v in words.items()}
    other |= {"name": names, "birth": M.only(_sign("digit"), M.count(c, patterns.BIRTH))}
    return {k: other[k] if k in other else n[k] for k in lexicon.CATEGORIES}


def worked_out(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``df`` with columns that are computed once for a row, whatever is filtered or selected later.

    They are elements of an exploded array of one: filters on them are not pushed below, so their expressions
    are not repeated for every use.
    """
    one = df.withColumn("_worked", F.explode(F.array(F.struct(*[v.alias(k) for k, v in columns.items()]))))
    return one.withColumns({k: F.col("_worked")[k] for k in columns}).drop("_worked")


def detect(texts: DataFrame, name_files: Iterable[str] = ("customers.csv", "logistics.csv"), count_findings: bool = False) -> DataFrame:
    """Add the group vector, score, decision, level and raw matches to rows of ``text``, ``top_dir`` and ``name``.

    ``name_files`` are data files in which ten names or more decide.  Other columns stay; result columns replace
    columns of the same names.  ``count_findings`` adds ``found``, the numbers of findings of each category of the rows with
    personal data (null for the others).
    """
    c = F.col("text")
    df = with_signs(worked_out(texts, {"text": M.normalize(c)}))
    contact = F.coalesce((F.size("_phone") > 0) | (_sign("at") & c.rlike(patterns.EMAIL)), F.lit(False))
    counted = {f"_n_{k}": v for k, v in parts(c).items()}
    df = worked_out(df, counted | {"fio_clean": M.size(no_places(_sign("names"))), "has_contact": contact})
    n = {k.removeprefix("_n_"): F.col(k) for k in counted}
    df = with_score(df.withColumns(groups(n)))
    strong = F.col("has_contact") | (F.greatest("g_gov", "g_pay", "g_bio", "g_special") > 0)
    names, dates, doc = F.col("fio_clean"), F.col("date_count"), F.col("doc_score")
    note = lambda text, n: F.concat(F.lit(text), n.cast("string"))
    rule = (
        F.when(c == "", None)
        .when(strong, "strong")
        .when((F.col("top_dir") == "data") & F.lower(F.col("name")).isin(*name_files) & (names >= 10), note("fio_count=", names))
        .when((F.col("top_dir") == "text") & (names >= 2), note("fio_count=", names))
        .when((F.col("top_dir") == "images") & (doc >= 2), "doc_score>=2")
        .when((F.col("top_dir") == "images") & (doc >= 1) & (names >= 1), "doc_score+fio")
        .when((F.col("top_dir") == "images") & (dates >= 2) & (doc >= 0.8), note("dates_score=", dates))
    )
    reasons = F.when(c == "", F.array(F.lit("empty"))).otherwise(
        F.concat(F.when(F.col("rule").isNotNull(), F.array("rule")).otherwise(F.array().cast("array<string>")), F.col("doc_reasons"))
    )
    made = {
        "is_pdn": F.col("rule").isNotNull(),
        "reasons": reasons,
        "uz": F.when(c == "", "—").otherwise(level({k: F.col(k) for k in GROUPS})),
        "matches": matches(c),
    }
    if count_findings:
        found = finding_counts(c, n, F.col("fio_clean"))
        made["found"] = F.when(F.col("rule").isNotNull(), F.struct(*[v.alias(k) for k, v in found.items()]))
    return df.withColumn("rule", rule).withColumns(made).drop("rule", *counted, *SIGNS)


def with_findings(decisions: DataFrame) -> DataFrame:
    """Add ``detail``, the masked findings of the rows with personal data (null for the others)."""
    df = with_signs(decisions, F.when(F.col("is_pdn"), F.col("text")))
    detail = F.struct(*[v.alias(k) for k, v in findings(F.col("text")).items()])
    return worked_out(df, {"detail": F.when(F.col("is_pdn"), detail)}).drop(*SIGNS)


def long_findings(decisions: DataFrame, key: str = "path") -> DataFrame:
    """One row for each finding of ``with_findings``: key, category, seq, masked."""
    each = F.array(*[F.struct(F.lit(k).alias("category"), F.col("detail")[k].alias("found")) for k in lexicon.CATEGORIES])
    rows = decisions.where("is_pdn").select(key, F.explode(each).alias("x"))
    return rows.select(key, F.col("x.category").alias("category"), F.posexplode("x.found").alias("seq", "masked"))
