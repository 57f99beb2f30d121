"""Named queries and their SQL equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakesift.functions import checksums, lexicon, patterns
from lakesift.functions import matching as M
from lakesift.operators import detection, formats, organize, report
from lakesift.plans import duck
from lakesift.plans.corpus import HEADERS, IDS, corpus, ids, read
from lakesift.sources.files import first_lines

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _add(name: str, run: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = run
    if sql:
        ORACLE_SQL[name] = sql


def _over_corpus(name: str, columns: Callable[[Column, Column], dict[str, Column]], sql: dict[str, str], spans: tuple[str, ...] = (), signs: bool = False) -> None:
    """A query of columns over each text of the corpus, with its ``signs`` if asked for."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        # where several expressions use it, the lower-case text is worked out once
        rows = corpus(spark, sf_dir).withColumn("low", F.lower("text"))
        rows = detection.with_signs(rows) if signs else rows
        return rows.select("kind", "id", *[v.alias(k) for k, v in columns(F.col("text"), F.col("low")).items()])

    picked = ", ".join(f"{v} as {k}" for k, v in sql.items())
    _add(name, run, duck.rows(f"kind, id, {picked} from x", spans))


def _decisions(spark: SparkSession, sf_dir: str, top_dir: str = "text", count_findings: bool = False) -> DataFrame:
    named = corpus(spark, sf_dir).withColumns({"top_dir": F.lit(top_dir), "name": F.lit("customers.csv")})
    return detection.detect(named, count_findings=count_findings)


# checksums
for _name, _column, _test, _sql in (
    ("q01_luhn_valid", "card", checksums.luhn_valid, duck.luhn("card")),
    ("q02_snils_valid", "snils", checksums.snils_valid, duck.snils("snils")),
    ("q03_inn10_valid", "inn10", checksums.inn10_valid, duck.inn10("inn10")),
    ("q04_inn12_valid", "inn12", checksums.inn12_valid, duck.inn12("inn12")),
):
    _add(
        _name,
        lambda spark, sf_dir, c=_column, test=_test: ids(spark, sf_dir).select("id", test(F.col(c)).alias("valid")),
        f"select id, {_sql} as valid from ({IDS.format(orders='orders')}) ids",
    )

# matches
_big = "({})::bigint".format
_over_corpus("q05_email_count", lambda c, low: {"n": M.count(c, patterns.EMAIL)}, {"n": _big(duck.count(duck.EMAIL))})
_over_corpus("q06_phone_count", lambda c, low: {"n": M.count(c, patterns.PHONE)}, {"n": _big(duck.count(duck.PHONE))})
_over_corpus(
    "q07_card_luhn",
    lambda c, low: {"n": M.size(F.filter(M.extract(c, patterns.CARD), checksums.luhn_valid))},
    {"n": _big(f"len(list_filter({duck.found(duck.CARD)}, lambda x: {duck.luhn('x')}))")},
)
_over_corpus("q08_card_context", lambda c, low: {"n": M.size(detection.cards(c, low))}, {"n": _big(f"len({duck.CARDS})")}, ("card",))
_over_corpus(
    "q09_digit_runs",
    lambda c, low: {"inn10": M.count(c, patterns.INN10), "inn12": M.count(c, patterns.INN12), "licence": M.count(c, patterns.LICENCE)},
    {"inn10": _big(f"len({duck.runs(10, 10)})"), "inn12": _big(f"len({duck.runs(12, 12)})"), "licence": _big(f"len({duck.runs(10, 12)})")},
)
for _name, _span, _rx, _words, _width in (
    ("q10_dob_context", "birth", patterns.BIRTH, lexicon.NEAR_BIRTH, 40),
    ("q11_index_address", "index", patterns.INDEX, lexicon.NEAR_INDEX, 40),
    ("q12_passport_context", "passport", patterns.PASSPORT, lexicon.NEAR_PASSPORT, 60),
):
    _over_corpus(
        _name,
        lambda c, low, rx=_rx, words=_words, width=_width: {"n": M.size(M.in_context(c, low, rx, words, width))},
        {"n": _big(f"len({duck.near(_span, _words, _width)})")},
        (_span,),
    )
_over_corpus(
    "q13_account_bik",
    lambda c, low: {"account": F.array_join(M.extract(c, patterns.ACCOUNT, 1), ","), "bik": F.array_join(M.extract(c, patterns.BIK, 1), ",")},
    {k: f"array_to_string({duck.found(rx, 1)}, ',')" for k, rx in (("account", duck.ACCOUNT), ("bik", duck.BIK))},
)
_over_corpus(
    "q14_mrz_cvv",
    lambda c, low: {"mrz": M.count(c, patterns.MRZ), "cvv": c.rlike(patterns.CVV)},
    {"mrz": _big(duck.count(duck.MRZ)), "cvv": f"regexp_matches(text, '{duck.CVV}')"},
)
_over_corpus(
    "q15_fio_clean",
    lambda c, low: {"n": M.count(c, patterns.NAME), "names": F.array_join(detection.person_names(c), "|")},
    {"n": _big(f"len({duck.found(duck.NAME, 1)})"), "names": f"array_to_string({duck.CLEAN_NAMES}, '|')"},
)
_over_corpus(
    "q16_keyword_groups",
    lambda c, low: {"bio": M.contains_any(low, lexicon.BIOMETRIC), "special": M.contains_any(low, lexicon.SPECIAL)},
    {"bio": duck.matches_any("low", lexicon.BIOMETRIC), "special": duck.matches_any("low", lexicon.SPECIAL)},
)
_WORDS = {"health": lexicon.HEALTH, "politics": lexicon.POLITICS, "beliefs": lexicon.BELIEFS, "biometric": lexicon.BIOMETRIC}


def _starts(words: tuple[str, ...]) -> str:
    """Places where a word starts: no word of these lists is the beginning of another or overlaps itself."""
    return _big(" + ".join(f"(length(low) - length(replace(low, '{w}', ''))) // {len(w)}" for w in words))


_over_corpus(
    "q17_keyword_occurrences",
    lambda c, low: {k: M.count_occurrences(low, w) for k, w in _WORDS.items()},
    {k: _starts(w) for k, w in _WORDS.items()},
)

# groups, levels, decisions
_over_corpus(
    "q18_group_vector", lambda c, low: detection.groups(detection.parts(c)), {k: _big(v) for k, v in duck.GROUPS.items()}, duck.ALL, True
)
_add(
    "q19_uz_level",
    lambda spark, sf_dir: detection.with_signs(corpus(spark, sf_dir))
    .withColumns(detection.groups(detection.parts(F.col("text"))))
    .select("kind", "id", F.when(F.col("text") == "", "—").otherwise(detection.level({k: F.col(k) for k in detection.GROUPS})).alias("uz")),
    duck.rows(f"kind, id, {duck.LEVEL} as uz from g", duck.ALL, more=duck.GROUP_CTE),
)
# texts are normalised first, as in a scan
_NORMAL = f"""select kind, id, regexp_replace(regexp_replace(regexp_replace(text, '\\f', ' ', 'g'), '[ \\t]+', ' ', 'g'),
    '^[\\s\\x0b\\x1c-\\x1f\\x{{{{85}}}}\\p{{{{Z}}}}]+|[\\s\\x0b\\x1c-\\x1f\\x{{{{85}}}}\\p{{{{Z}}}}]+$', '', 'g') as text from ({duck.CORPUS}) raw"""
_add(
    "q20_uz_summary",
    lambda spark, sf_dir: report.level_counts(_decisions(spark, sf_dir)).select("uz", "files"),
    duck.rows(
        "l.uz, count(d.id) as files from (values ('УЗ-1'), ('УЗ-2'), ('УЗ-3'), ('УЗ-4')) l(uz) left join d on d.uz = l.uz group by l.uz",
        duck.ALL,
        body=_NORMAL,
        more=duck.GROUP_CTE + f",\nd as (select id, {duck.LEVEL} as uz from g where {duck.DECIDE['text']})",
    ),
)
_add(
    "q21_doc_score",
    lambda spark, sf_dir: detection.with_score(detection.with_signs(corpus(spark, sf_dir))).select(
        "kind", "id", F.round("doc_score", 2).alias("doc_score"), F.col("date_count").alias("dates")
    ),
    duck.rows(f"kind, id, round({duck.SCORE}, 2) as doc_score, {_big(duck.DATES)} as dates from x"),
)
for _name, _top in (("q22_decide_text", "text"), ("q23_decide_data", "data"), ("q24_decide_image", "images")):
    _add(
        _name,
        lambda spark, sf_dir, top=_top: _decisions(spark, sf_dir, top).select("kind", "id", "is_pdn"),
        duck.rows(f"kind, id, {duck.DECIDE[_top]} as is_pdn from g", duck.ALL, body=_NORMAL, more=duck.GROUP_CTE),
    )

# masks, raw matches, totals
_over_corpus(
    "q25_mask_values",
    lambda c, low: {
        "email": F.array_join(F.transform(M.extract(c, patterns.EMAIL), lambda v: M.mask(v, 3)), " "),
        "name": F.array_join(F.transform(M.extract(c, patterns.NAME), lambda v: M.mask(v, 2)), "|"),
    },
    {
        "email": f"array_to_string(list_transform({duck.found(duck.EMAIL)}, lambda v: {duck.stars('v', 3)}), ' ')",
        "name": f"array_to_string(list_transform({duck.found(duck.NAME, 1)}, lambda v: {duck.stars('v', 2)}), '|')",
    },
)
_POS = "(list_sum(list_transform(s_birth[1:i], lambda s: length(s))) + coalesce(list_sum(list_transform(m_birth[1:i-1], lambda q: length(q))), 0))"
_over_corpus(
    "q26_mask_context",
    lambda c, low: {"shown": F.array_join(F.transform(M.spans(c, patterns.BIRTH), lambda x: M.mask_around(c, x)), "|")},
    {
        "shown": f"array_to_string(list_transform(range(1, len(m_birth) + 1), lambda i: trim(text[greatest({_POS} - 10, 0) + 1 : {_POS}]"
        f" || repeat('*', length(m_birth[i])) || text[{_POS} + length(m_birth[i]) + 1 : {_POS} + length(m_birth[i]) + 10], ' ' || chr(10))), '|')"
    },
    ("birth",),
)


def _distinct(values: str) -> str:
    """Distinct values in order of first occurrence."""
    return f"array_to_string(list_filter({values}, lambda v, i: list_position({values}, v) = i), '|')"


_over_corpus(
    "q27_debug_matches",
    lambda c, low: {k.lower(): F.array_join(detection.raw_values(c)[k], "|") for k in ("EMAIL", "PHONE", "SNILS", "INN")},
    {
        "email": _distinct(duck.found(duck.EMAIL)),
        "phone": _distinct(duck.found(duck.PHONE)),
        "snils": _distinct(duck.found(duck.SNILS)),
        "inn": _distinct(duck.runs(12, 12)),
    },
    signs=True,
)
_TOTALS = {
    "name": f"len({duck.CLEAN_NAMES})",
    "birth": duck.count(duck.BIRTH),
    "email": duck.count(duck.EMAIL),
    "phone": duck.count(duck.PHONE),
    "snils": f"len(list_filter({duck.found(duck.SNILS)}, lambda x: {duck.snils('x')}))",
    "address": f"len({duck.near('index', lexicon.NEAR_INDEX, 40)})",
    "card": f"len({duck.CARDS})",
    "inn": f"len({duck.runs(12, 12, duck.inn12('x'))}) + len({duck.runs(10, 10, duck.inn10('x'))})",
    "passport": f"len({duck.near('passport', lexicon.NEAR_PASSPORT, 60)})",
    "account": duck.count(duck.ACCOUNT),
    "bik": duck.count(duck.BIK),
    **{k: _starts(w) for k, w in _WORDS.items()},
}
_each = " union all ".join(f"select '{k}' as category, sum({v})::bigint as findings from p" for k, v in _TOTALS.items())
_add(
    "q28_category_totals",
    lambda spark, sf_dir: report.category_totals(_decisions(spark, sf_dir, count_findings=True)),
    duck.rows(
        f"category, findings from ({_each}) t where findings > 0",
        duck.ALL,
        body=_NORMAL,
        more=duck.GROUP_CTE + f",\np as (select x.* from x join g using (kind, id) where {duck.DECIDE['text'].replace('text', 'g.text')})",
    ),
)


# result rows and rendering
def _result_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events")["events"]
    files = events.select(
        F.concat(F.lit("f"), (F.col("user_id") % 500).cast("string")).alias("name"),
        (F.col("event_id") * 7).alias("size"),
        F.col("ts").alias("mtime"),
        F.col("event_id").alias("ord"),
        F.col("event_id").cast("string").alias("path"),
        (F.col("event_id") % 3 == 0).alias("is_pdn"),
    )
    return report.result_rows(files, files.where("ord % 11 = 0"))


_add(
    "q29_result_rows",
    _result_rows,
    """with f as (select 'f' || (user_id % 500)::varchar as name, event_id * 7 as size, ts, event_id from events),
k as (select * from f where event_id % 3 = 0 qualify row_number() over (partition by name order by event_id) = 1),
m as (select * from f where event_id % 11 = 0 and name not in (select name from k) qualify row_number() over (partition by name order by event_id) = 1)
select size, replace(lower(strftime(ts, '%b %d %H:%M')), ' 0', ' ') as time, name from (select * from k union all select * from m) u""",
)
_add(
    "q30_examples_fmt",
    lambda spark, sf_dir: read(spark, sf_dir, "orders")["orders"]
    .groupBy("o_custkey")
    .agg(F.array_sort(F.collect_list(F.col("o_orderkey"))).cast("array<string>").alias("keys"), F.sum("o_orderkey").alias("total"))
    .select("o_custkey", M.format_examples(F.col("keys")).alias("examples"), F.format_number("total", 0).alias("total")),
    """select o_custkey, array_to_string(list_transform(k[1:3], lambda x: '`' || x::varchar || '`') || case when len(k) > 3 then ['(+' || (len(k) - 3)::varchar || ')'] else [] end, ', ') as examples,
       format('{:,}', total) as total
from (select o_custkey, list(o_orderkey order by o_orderkey) as k, sum(o_orderkey)::bigint as total from orders group by o_custkey) t""",
)


# formats
def _sniff_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = read(spark, sf_dir, "pages", "documents", "events")
    c = (
        tables["pages"].selectExpr("'page' as kind", "page_id as id", "html as c")
        .unionByName(tables["documents"].selectExpr("'document' as kind", "doc_id as id", "text as c"))
        .unionByName(tables["events"].selectExpr("'event' as kind", "event_id as id", "props as c"))
    )
    header = F.substring(F.coalesce("c", F.lit("")).cast("binary"), 1, formats.HEADER_BYTES)
    return c.select("kind", "id", formats.sniff(header, F.lit("")).getField("label").alias("label"))


def _duck_sniff(hexed: str, ext: str) -> str:
    """Struct of folder, label and note from a header in hexadecimal capitals."""
    none = "null"
    out = lambda folder, label, note: f"{{'folder': '{folder}', 'label': {label}, 'note': {note}}}"
    case = "case"
    for magic, at, folder, label, exts in formats.SIGNATURES:
        n = len(magic)
        other = f"case when {ext} in ('', {', '.join(repr(e) for e in exts)}) then null else 'расширение ''' || {ext} || ''' не соответствует формату {label}' end"
        case += f"\nwhen length({hexed}) // 2 > {at + n} and substr({hexed}, {2 * at + 1}, {2 * n}) = '{magic.hex().upper()}' then {out(folder, repr(label), other)}"
    # headers of the oracle are ASCII or whole UTF-8 within 200 bytes, or have none of the looked-for text
    sample = f"lower(decode(unhex(regexp_replace({hexed}, '^((?:[0-7].)*).*$', '\\1'))))"
    # leading ASCII of the first 200 bytes
    sample = sample.replace(f"regexp_replace({hexed}", f"regexp_replace(substr({hexed}, 1, 400)")
    case += f"\nwhen contains({sample}, '<html') or contains({sample}, '<!doctype html') then {out('html', repr('HTML (detected)'), none)}"
    case += f"\nwhen regexp_matches({sample}, '^\\s*[{{\\[]') and contains({sample}, '\"') and contains({sample}, ':') then {out('data', repr('JSON'), none)}"
    rest = f"len(list_filter(range(1, length({hexed}) // 2 + 1), lambda i: regexp_matches(substr({hexed}, 2 * i - 1, 2), '^([2-6].|7[0-9A-E]|09|0A|0D)$')))"
    case += f"\nwhen {rest} * 2.0 / greatest(length({hexed}), 2) > 0.7 then {out('text', repr('TEXT'), none)}"
    for exts, folder, label, note in formats.BY_EXTENSION:
        hit = f"contains('{exts}', {ext})" if isinstance(exts, str) else f"{ext} in ({', '.join(repr(e) for e in exts)})"
        text = repr(label) if "{}" not in label else f"upper({ext}[2:]) || '{label.replace('{}', '')}'"
        case += f"\nwhen {hit} then {out(folder, text, repr(note) if note else none)}"
    return case + f"\nelse {out('unknown', repr('UNKNOWN'), repr(formats.UNSURE))} end"


_add(
    "q31_sniff_text_format",
    _sniff_texts,
    "with c as (select 'page' as kind, page_id as id, html as c from pages union all select 'document', doc_id, text from documents union all select 'event', event_id, props from events),\n"
    "h as (select kind, id, substr(hex(encode(coalesce(c, ''))), 1, 1024) as h from c)\n"
    f"select kind, id, ({_duck_sniff('h', repr(''))}).label as label from h",
)


def _headers(spark: SparkSession) -> DataFrame:
    folders = ("pdf", "office", "images", "text")
    rows = [(i, folders[i % 4], name, h) for i, (h, name) in enumerate(HEADERS)]
    files = spark.createDataFrame(rows, "id long, top_dir string, name string, h string")
    return files.withColumns({"header": F.unhex("h"), "size": F.col("id") * 100_003, "path": F.format_string("%03d", "id")})


_HEADERS_SQL = (
    "with f as (select id::bigint as id, ['pdf', 'office', 'images', 'text'][id % 4 + 1] as top_dir, name, upper(h) as h, id::bigint * 100003 as size,"
    " case when regexp_matches(name, '.\\.[^.]+$') then lower(regexp_extract(name, '\\.[^.]+$')) else '' end as ext from (values "
    + ", ".join(f"({i}, '{h}', '{name}')" for i, (h, name) in enumerate(HEADERS))
    + f") v(id, h, name)),\ns as (select *, {_duck_sniff('h', 'ext')} as o from f),\nd as (select *, o.folder as folder, o.label as label, o.note as note from s)\n"
)
_add(
    "q32_magic_table",
    lambda spark, sf_dir: formats.detect_formats(_headers(spark)).select("id", "detected_folder", "detected_format", "spoof_note"),
    _HEADERS_SQL + "select id, folder as detected_folder, label as detected_format, note as spoof_note from d",
)
_add(
    "q33_folder_summary",
    lambda spark, sf_dir: organize.summary(organize.plan(_headers(spark))),
    _HEADERS_SQL
    + "select folder, count(*) as count, sum(size)::bigint as size_bytes, count(note) as spoofed_count, round(sum(size) / 1048576.0::double, 2) as size_mb from d group by rollup(folder)",
)
_add(
    "q34_verify_accuracy",
    lambda spark, sf_dir: organize.verify(_headers(spark)).select("folder", "total", "correct", "accuracy"),
    _HEADERS_SQL
    + "select top_dir as folder, count(*) as total, count_if(folder = top_dir)::bigint as correct, round(count_if(folder = top_dir) * 100.0::double / count(*), 2) as accuracy from d group by top_dir",
)
_add(
    "q35_collision_names",
    lambda spark, sf_dir: organize.collision_names(
        read(spark, sf_dir, "part")["part"].select(
            F.col("p_brand").alias("detected_folder"), F.concat("p_type", F.lit(".txt")).alias("name"), F.col("p_partkey").alias("path")
        )
    ).select("path", "target_name"),
    """select p_partkey as path, case when n = 0 then p_type || '.txt' else p_type || '_' || n::varchar || '.txt' end as target_name
from (select *, row_number() over (partition by p_brand, p_type order by p_partkey) - 1 as n from part) t""",
)

# texts
_over_corpus("q36_normalize", lambda c, low: {"normal": F.sha2(M.normalize(c), 256)}, {})
ORACLE_SQL["q36_normalize"] = f"select kind, id, sha256(text) as normal from ({_NORMAL.format(**duck.TABLES)}) n"
_add(
    "q37_csv_head",
    lambda spark, sf_dir: read(spark, sf_dir, "documents")["documents"].select(
        "doc_id", F.sha2(first_lines(F.coalesce("text", F.lit("")), 5), 256).alias("head")
    ),
    """select doc_id, sha256(array_to_string(string_split(case when coalesce(text, '') like '%' || chr(10) then text[:-2] else coalesce(text, '') end, chr(10))[1:5], chr(10))) as head from documents""",
)

# reasons, masked values and raw matches of the other kinds
for _name, _top in (("q38_reasons_text", "text"), ("q39_reasons_data", "data"), ("q40_reasons_image", "images")):
    _add(
        _name,
        lambda spark, sf_dir, top=_top: _decisions(spark, sf_dir, top).select("kind", "id", F.array_join("reasons", " | ").alias("reasons")),
        duck.rows(f"kind, id, {duck.reasons(_top)} as reasons from g", duck.ALL, body=_NORMAL, more=duck.GROUP_CTE),
    )
_at = lambda name, where: f"list_transform({where}, lambda k: m_{name}[k])"
_MASKED = {
    "phone": (duck.found(duck.PHONE), 3),
    "snils": (f"list_filter({duck.found(duck.SNILS)}, lambda x: {duck.snils('x')})", 3),
    "card": (_at("card", duck.CARDS), 3),
    "inn": (f"list_concat({duck.runs(12, 12, duck.inn12('x'))}, {duck.runs(10, 10, duck.inn10('x'))})", 3),
    "passport": (_at("passport", duck.near("passport", lexicon.NEAR_PASSPORT, 60)), 2),
    "account": (duck.found(duck.ACCOUNT, 1), 3),
    "bik": (duck.found(duck.BIK, 1), 3),
}
_over_corpus(
    "q41_masked_findings",
    lambda c, low: {k: F.array_join(v, "|") for k, v in detection.findings(c).items() if k in _MASKED},
    {k: f"array_to_string(list_transform({v}, lambda v: {duck.stars('v', keep)}), '|')" for k, (v, keep) in _MASKED.items()},
    ("card", "passport"),
    True,
)
_over_corpus(
    "q42_debug_names_passports",
    lambda c, low: {k.lower(): F.array_join(detection.raw_values(c)[k], "|") for k in ("PASSPORT_RU", "FIO_RU")},
    {"passport_ru": _distinct(duck.found(duck.PASSPORT)), "fio_ru": _distinct(duck.CLEAN_NAMES)},
    signs=True,
)


# placement over tables: each text is a file
def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = read(spark, sf_dir, "documents", "pages", "events")
    rows = (
        tables["documents"].selectExpr("'text' as top_dir", "concat('d', doc_id, '.txt') as name", "text as c")
        .unionByName(tables["pages"].selectExpr("'data' as top_dir", "concat('p', page_id, '.html') as name", "html as c"))
        .unionByName(tables["events"].selectExpr("'data' as top_dir", "concat('e', event_id, '.json') as name", "props as c"))
    )
    content = F.coalesce("c", F.lit("")).cast("binary")
    return rows.select("top_dir", "name", F.concat_ws("/", "top_dir", "name").alias("path"), F.octet_length(content).cast("long").alias("size"), F.substring(content, 1, formats.HEADER_BYTES).alias("header"))


_FILES_SQL = f"""with c as (
    select 'text' as top_dir, 'd' || doc_id || '.txt' as name, '.txt' as ext, coalesce(text, '') as c from documents
    union all select 'data', 'p' || page_id || '.html', '.html', coalesce(html, '') from pages
    union all select 'data', 'e' || event_id || '.json', '.json', coalesce(props, '') from events
),
h as (select top_dir, name, ext, top_dir || '/' || name as path, strlen(c)::bigint as size, substr(hex(encode(c)), 1, 1024) as h from c),
s as (select *, {_duck_sniff('h', 'ext')} as o from h),
d as (select *, o.folder as folder, o.label as label, o.note as note from s)
"""
_add(
    "q43_plan_hashed_names",
    lambda spark, sf_dir: organize.plan(_files(spark, sf_dir), action="move", keep_unknown=False, preserve_names=False),
    _FILES_SQL
    + "select path as original_path, folder || '/' || md5(path)[1:16] || ext as target_path, size as size_bytes, folder as detected_folder, label as detected_format,"
    + " note is not null as is_spoofed, note as spoof_note, 'move' as action from d where folder <> 'unknown'",
)
_add(
    "q44_summary_of_files",
    lambda spark, sf_dir: organize.summary(organize.plan(_files(spark, sf_dir))),
    _FILES_SQL
    + "select folder, count(*) as count, sum(size)::bigint as size_bytes, count(note) as spoofed_count, round(sum(size) / 1048576.0::double, 2) as size_mb from d group by rollup(folder)",
)
_add(
    "q45_verify_files",
    lambda spark, sf_dir: organize.verify(_files(spark, sf_dir)).select(
        "folder", "total", "correct", "accuracy", "size_bytes", F.array_join(F.transform("examples", lambda x: F.concat_ws(" ", x["name"], x["detected_folder"], x["detected_format"])), ", ").alias("examples")
    ),
    _FILES_SQL
    + """, w as (select *, row_number() over (partition by top_dir order by name, folder) as n from d where folder <> top_dir),
x as (select top_dir, string_agg(name || ' ' || folder || ' ' || label, ', ' order by name, folder) as examples from w where n <= 5 group by top_dir)
select d.top_dir as folder, count(*) as total, count_if(folder = d.top_dir)::bigint as correct, round(count_if(folder = d.top_dir) * 100.0::double / count(*), 2) as accuracy,
       sum(size)::bigint as size_bytes, coalesce(any_value(x.examples), '') as examples
from d left join x on x.top_dir = d.top_dir group by d.top_dir""",
)
