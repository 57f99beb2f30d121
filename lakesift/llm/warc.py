"""WARC archives: write captures, read records back, assemble transactions.

Archives are written with Spark's text writer, whose line separator is WARC's record separator (two
CRLF), gzipped, so any store that Spark can write will do.  They are read with the same separator
and put together again as a byte stream by Content-Length, so payloads may hold any bytes, that
separator included; memory is bounded by one record and one Arrow batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakesift.llm.common import new_path, stash

SEP = "\r\n\r\n"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
DATE = "2000-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Parsed records are handed on in batches of about this many bytes.
FLUSH_BYTES = 4 << 20

RECORDS = "record_type string, record_id string, concurrent_to string, refers_to string, target_uri string, payload_digest string, head string, payload binary"


def base32_sha1(data: Column) -> Column:
    """Upper-case base32 of the SHA-1: 160 bits are 8 groups of 5 hex digits or 4 letters."""
    digest = F.sha1(data)
    letters = []
    for i in range(8):
        group = F.conv(F.substring(digest, 5 * i + 1, 5), 16, 10).cast("int")
        letters += [F.substring(F.lit(BASE32), (F.shiftright(group, shift).bitwiseAND(F.lit(31)) + 1), F.lit(1)) for shift in (15, 10, 5, 0)]
    return F.concat(*letters)


def _urn(role: str, key: Column) -> Column:
    h = F.md5(F.concat(F.lit(role), key))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))), F.lit(">"))


def _record(kind: str, record_id: Column, uri: Column, content_type: str, headers: list[Column], block: Column) -> Column:
    """One record without its closing separator; ``headers`` that are null are left out."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value)
    head = F.concat_ws(
        "\r\n", F.lit("WARC/1.1"), F.lit(f"WARC-Type: {kind}"), line("WARC-Record-ID", record_id), F.lit(f"WARC-Date: {DATE}"), line("WARC-Target-URI", uri),
        *headers, F.lit(f"Content-Type: {content_type}"), line("Content-Length", F.octet_length(block).cast("string")),
    )
    return F.concat(head, F.lit(SEP), block)


def write_archives(captures: DataFrame, path: str, *, id_col: str, url_col: str, payload_col: str, min_payload=0, records_per_file=0) -> None:
    """Write a request, a response or revisit, and a metadata record for each capture to ``path``.

    Among captures with equal payloads of at least ``min_payload`` bytes, that with the smallest id
    is a response, the others revisit it.  A null payload counts as empty; null ids come after all
    others; rows alike in id, url and payload are one transaction whose metadata tells their number.
    """
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = captures.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("bytes", F.octet_length("payload").cast("long")).withColumn("digest", base32_sha1(F.col("payload")))
    known = lambda c: F.when(F.col(c).isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.col(c).cast("string")))
    rows = rows.withColumn("key", F.md5(F.concat_ws("|", known("id"), F.col("bytes"), F.col("digest"), known("url"))))
    order = F.struct(F.col("id").isNull().alias("last"), F.col("id").alias("id"), F.col("key").alias("key"))

    # only payloads that occur more than once need to know their head; payloads themselves stay out of these joins
    narrow = stash(rows.groupBy("key", "id", "bytes", "digest").agg(F.count("*").alias("copies")), "warc-keys")
    heads = narrow.filter(F.col("bytes") >= min_payload).groupBy("digest", "bytes").agg(F.min(order).alias("head"), F.count("*").alias("n")).filter("n > 1")
    same_as_head = F.col("id").eqNullSafe(F.col("head.id"))
    heads = stash(heads, "warc-heads")
    revisits = stash(narrow.join(heads, ["digest", "bytes"]).filter(~same_as_head).select("key", F.col("head.key").alias("head_key")), "warc-revisits")

    whole = rows.groupBy("key").agg(F.first("id").alias("id"), F.first("url").alias("url"), F.first("bytes").alias("bytes"), F.first("digest").alias("digest"), F.first("payload").alias("payload"), F.count("*").alias("copies"))
    whole = whole.join(revisits, "key", "left")
    uri = F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20")
    main = _urn("response", F.col("key"))
    concurrent = F.concat(F.lit("WARC-Concurrent-To: "), main)
    digest = F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(SEP))
    request = _record("request", _urn("request", F.col("key")), uri, "application/http; msgtype=request", [concurrent], F.concat(F.lit("GET "), F.coalesce(uri, F.lit("/")), F.lit(" HTTP/1.1\r\nAccept: */*" + SEP)))
    response = _record("response", main, uri, "application/http; msgtype=response", [digest], F.concat(http, F.col("payload").cast("string")))
    revisit = _record("revisit", main, uri, "application/http; msgtype=response", [F.lit(f"WARC-Profile: {REVISIT_PROFILE}"), F.concat(F.lit("WARC-Refers-To: "), _urn("response", F.col("head_key"))), digest], http)
    fields = F.concat(F.concat_ws("\r\n", F.concat(F.lit("capture-id: "), F.col("id").cast("string")), F.concat(F.lit("copies: "), F.col("copies").cast("string"))), F.lit("\r\n"))
    metadata = _record("metadata", _urn("metadata", F.col("key")), uri, "application/warc-fields", [concurrent], fields)
    lines = whole.select(F.explode(F.array(request, F.when(F.col("head_key").isNull(), response).otherwise(revisit), metadata)).alias("value"))
    lines.write.option("lineSep", SEP).option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["record_type", "record_id", "concurrent_to", "refers_to", "target_uri", "payload_digest", "head", "payload"]
    types = [pa.string()] * 7 + [pa.binary()]
    sep, out, held = SEP.encode(), [], 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    def parsed(head: bytes, block: bytes) -> tuple:
        lines = head.decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"not a WARC record: {lines[0][:80]!r}")
        h = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        http = h.get("content-type", "").startswith("application/http")
        top, _, payload = block.partition(sep) if http else (block, b"", b"")
        return h.get("warc-type"), h.get("warc-record-id"), h.get("warc-concurrent-to"), h.get("warc-refers-to"), h.get("warc-target-uri"), h.get("warc-payload-digest", "").removeprefix("sha1:") or None, top.decode("utf-8", "replace"), payload

    file, parts, have, head, need = None, [], 0, None, 0
    for b in batches:
        for name, chunk in zip(b.column("file").to_pylist(), b.column("value").to_pylist(), strict=True):
            if name != file:
                if have and b"".join(parts).strip():
                    raise ValueError(f"{file} ends inside a record")
                file, parts, have, head = name, [], 0, None
            parts += (chunk, sep)
            have += len(chunk) + 4
            while have:
                if head is None:
                    data = b"".join(parts).lstrip(b"\r\n")
                    head, found, rest = data.partition(sep)
                    if not found:
                        parts, have, head = [data], len(data), None
                        break
                    parts, have = [rest], len(rest)
                    need = next((int(x.partition(b":")[2]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:")), 0)
                if have < need + 4:
                    break
                data = b"".join(parts)
                out.append(parsed(head, data[:need]))
                held += need
                parts, have, head = [data[need + 4 :]], len(data) - need - 4, None
                if held > FLUSH_BYTES or len(out) >= 2000:
                    yield batch()
                    out, held = [], 0
    if have and b"".join(parts).strip():
        raise ValueError(f"{file} ends inside a record")
    if out:
        yield batch()


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """The records of gzipped archives, one row each; a record cut short or malformed raises."""
    lines = spark.read.option("lineSep", SEP).text(path)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("value")).mapInArrow(_parse, RECORDS)


def _flat(records: DataFrame) -> DataFrame:
    """``transaction_id`` and the fields of ``assemble``'s structs, each with its struct's name before it: what is not read is not shuffled."""
    of = lambda kinds, c: F.first(F.when(F.col("record_type").isin(*kinds), F.col(c)), ignorenulls=True)
    main, made = ("response", "revisit"), {}
    for c in ("record_type", "record_id", "refers_to", "target_uri", "payload_digest", "head", "payload", "payload_bytes", "found_digest"):
        made[f"response_{c}"] = of(main, c)
    for kind in ("request", "metadata"):
        for c in ("record_id", "head"):
            made[f"{kind}_{c}"] = of((kind,), c)
    keyed = records.withColumn("transaction_id", F.coalesce("concurrent_to", "record_id")).withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("found_digest", base32_sha1(F.col("payload")))
    return keyed.groupBy("transaction_id").agg(*(v.alias(k) for k, v in made.items()))


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: ``transaction_id, request, response, metadata`` (structs, null where missing).

    Records meet under the identifier that they are concurrent to, or their own.  A response that
    nothing refers to, or a request without its response, still makes a row.
    """
    flat = _flat(records)
    nested = lambda kind: F.when(F.col(f"{kind}_record_id").isNotNull(), F.struct(*(F.col(k).alias(k.removeprefix(f"{kind}_")) for k in flat.columns if k.startswith(f"{kind}_")))).alias(kind)
    return flat.select("transaction_id", nested("request"), nested("response"), nested("metadata"))


def captures(transactions: DataFrame) -> DataFrame:
    """Each written row again: ``capture_id, payload_bytes, payload_digest, record_type, refers_to``.

    Revisits get the payload's size from the response they refer to; digests are taken from the
    payload as read, and for revisits from that of their response.  An archive without records gives no rows.
    """
    fields = [F.col("response")[c].alias(f"response_{c}") for c in ("record_id", "record_type", "refers_to", "payload_bytes", "found_digest", "payload_digest")]
    return _captures(transactions.select(*fields, F.col("metadata")["record_id"].alias("metadata_record_id"), F.col("metadata")["head"].alias("metadata_head")))


def _captures(flat: DataFrame) -> DataFrame:
    """``captures`` of flat transactions."""
    head = F.when(F.col("metadata_record_id").isNotNull(), F.col("metadata_head"))
    field = lambda name: F.regexp_extract("metadata_head", rf"(?m)^{name}: (\d+|-\d+)\r?$", 1)
    flat = flat.filter(F.col("response_record_id").isNotNull()).withColumn("metadata_head", head).select(
        F.col("response_record_id").alias("record_id"), F.col("response_record_type").alias("record_type"), F.col("response_refers_to").alias("head_id"), F.col("response_payload_bytes").alias("bytes"), F.col("response_found_digest").alias("digest"), F.col("response_payload_digest").alias("told"),
        F.expr("try_cast(nullif(" + "regexp_extract(metadata_head, '(?m)^capture-id: (-?[0-9]+)\\\\r?$', 1)" + ", '') as bigint)").alias("capture_id"), F.coalesce(F.nullif(field("copies"), F.lit("")).cast("long"), F.lit(1)).alias("copies"),
    )
    flat = stash(flat, "warc-captures")
    heads = flat.filter("record_type = 'response'").select(F.col("record_id").alias("head_id"), F.col("bytes").alias("head_bytes"), F.col("digest").alias("head_digest"), F.col("capture_id").alias("head_capture"))
    revisit = F.col("record_type") == "revisit"
    joined = flat.filter(revisit).join(heads, "head_id", "left").select("capture_id", F.col("head_bytes").alias("payload_bytes"), F.coalesce("head_digest", "told").alias("payload_digest"), "record_type", F.col("head_capture").alias("refers_to"), "copies")
    plain = flat.filter(~revisit).select("capture_id", F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to"), "copies")
    return plain.unionByName(joined).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).drop("copy", "copies")


def round_trip(pages: DataFrame, *, id_col="page_id", url_col="url", payload_col="html", min_payload=0) -> DataFrame:
    """Write archives of ``pages`` to shared storage, read them back, assemble and resolve them; payloads as read are hashed, and not shuffled."""
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write_archives(pages, path, id_col=id_col, url_col=url_col, payload_col=payload_col, min_payload=min_payload)
    return _captures(_flat(read_records(spark, path)))
