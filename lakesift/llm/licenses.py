"""Licence scans: entire texts against known licences by the digest of a canonical form.

The canonical form lower-cases A-Z, drops copyright lines, turns punctuation and blanks into word
breaks and maps equivalent spellings; its SHA-256 joins with the digests of the known texts.  The
same steps are given as DuckDB SQL by ``canonical_sql``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakesift.llm.license_texts import LICENSES

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
COPYRIGHT_LINE = r"(?m)^[^a-z0-9\n]*(copyright|copr\.|\(c\)|©|all rights reserved)[^\n]*$"
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F\x{A0}\x{A9}\x{AB}\x{AE}\x{BB}\x{2000}-\x{206F}\x{3000}]+"
# Spellings that count as the same word.
SPELLINGS = {
    "acknowledgement": "acknowledgment",
    "acknowledgements": "acknowledgments",
    "analogue": "analog",
    "analyse": "analyze",
    "artefact": "artifact",
    "authorisation": "authorization",
    "authorised": "authorized",
    "cancelled": "canceled",
    "capitalisation": "capitalization",
    "catalogue": "catalog",
    "centre": "center",
    "colour": "color",
    "favour": "favor",
    "favourite": "favorite",
    "fulfil": "fulfill",
    "fulfilment": "fulfillment",
    "honour": "honor",
    "initialise": "initialize",
    "judgement": "judgment",
    "labelling": "labeling",
    "labour": "labor",
    "licence": "license",
    "licenced": "licensed",
    "licences": "licenses",
    "maximise": "maximize",
    "minimise": "minimize",
    "modelling": "modeling",
    "noncommercial": "non  commercial",
    "optimise": "optimize",
    "organisation": "organization",
    "organisations": "organizations",
    "practise": "practice",
    "programme": "program",
    "realise": "realize",
    "recognise": "recognize",
    "signalling": "signaling",
    "sublicence": "sublicense",
    "utilisation": "utilization",
    "whilst": "while",
    "wilful": "willful",
    "http": "https",
}
#: Known licences are broadcast; a larger dictionary is joined by shuffle.
BROADCAST_MOST = 10_000


def canonical(text: Column) -> Column:
    """Words of the canonical form, one blank between; null and empty texts give ''."""
    t = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    t = F.regexp_replace(t, COPYRIGHT_LINE, " ")
    # two blanks between words, so that each word has a blank of its own on either side
    t = F.concat(F.lit(" "), F.regexp_replace(t, BREAKS, "  "), F.lit(" "))
    for a, b in SPELLINGS.items():
        t = F.replace(t, F.lit(f" {a} "), F.lit(f" {b} "))
    return F.trim(F.regexp_replace(t, " +", " "))


def canonical_sql(text: str) -> str:
    q = lambda s: s.replace("'", "''")
    t = f"regexp_replace(translate(coalesce({text}, ''), '{UPPER}', '{LOWER}'), '{q(COPYRIGHT_LINE)}', ' ', 'g')"
    t = f"' ' || regexp_replace({t}, '{q(BREAKS)}', '  ', 'g') || ' '"
    for a, b in SPELLINGS.items():
        t = f"replace({t}, ' {a} ', ' {b} ')"
    return f"trim(regexp_replace({t}, ' +', ' ', 'g'))"


def known(spark: SparkSession, licenses: dict[str, str] | None = None) -> DataFrame:
    """``digest, license_id`` of the known texts; of ids with one digest the first by name stands."""
    rows = list((LICENSES if licenses is None else licenses).items())
    texts = spark.createDataFrame(rows, "license_id string, body string")
    found = texts.select("license_id", F.sha2(canonical(F.col("body")), 256).alias("digest")).groupBy("digest").agg(F.min("license_id").alias("license_id"))
    return F.broadcast(found) if len(rows) <= BROADCAST_MOST else found


def scan(docs: DataFrame, licenses: dict[str, str] | None = None, *, id_col="doc_id", text_col="text") -> DataFrame:
    """``<id_col>, canonical_chars, digest, license_id`` of every row; ``license_id`` is null without a match.

    Whole texts count: a licence inside a longer text is no match.  Null and empty texts have the
    digest of '' and match nothing; repeated rows stay; an empty table gives no rows; other columns are ignored.
    """
    form = docs.select(F.col(id_col), canonical(F.col(text_col)).alias("form"))
    form = form.select(id_col, F.char_length("form").cast("long").alias("canonical_chars"), F.sha2("form", 256).alias("digest"))
    return form.join(known(docs.sparkSession, licenses), "digest", "left").select(id_col, "canonical_chars", "digest", F.when(F.col("canonical_chars") > 0, F.col("license_id")).alias("license_id"))


def scan_sql(licenses: dict[str, str] | None = None) -> str:
    rows = ", ".join(f"('{k}', '{v.replace(chr(39), chr(39) * 2)}')" for k, v in (LICENSES if licenses is None else licenses).items())
    return f"""
with known as (
    select digest, min(license_id) as license_id
    from (select license_id, sha256({canonical_sql('body')}) as digest from (values {rows}) v(license_id, body)) group by digest
), forms as (select doc_id, {canonical_sql('text')} as form from documents)
select f.doc_id, cast(length(form) as bigint) as canonical_chars, sha256(form) as digest, case when length(form) > 0 then k.license_id end as license_id
from forms f left join known k on k.digest = sha256(f.form)"""
