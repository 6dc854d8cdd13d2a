"""WARC archives: writing captures, and transaction assembly when reading.

A capture is three records: a request, a response (or a revisit, where another
capture holds the same payload) and metadata; the first and last name the
middle one in WARC-Concurrent-To.  Archives are written by Spark's text sink,
whose line separator is the blank line that ends a record, so they reach any
file system Spark does and survive lost executors by its commit protocol.  They
are read as a stream by the text source with the same separator, so a task
holds one record at a time, whatever the size of its file.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.common import cut

VERSION = "WARC/1.1"
_END = "\r\n\r\n"

# Digits of base 32 as ``conv`` writes them, and as base32 does.
_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

_FRAMED = "record_id string, kind string, concurrent_to string, refers_to string, target string, date string, digest string, body binary"

#: Kinds of a capture's middle record.
_MAIN = ("response", "revisit")

#: Copies of one capture that are written out by one array.
_COPIES = 10_000


def base32(sha1: Column) -> Column:
    """Upper-case base32 of a SHA-1 in hex: ten hex digits are eight characters."""
    groups = [F.lpad(F.conv(F.substring(sha1, 10 * i + 1, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*groups), _DIGITS, _BASE32)


def _field(name: str, value: Column) -> Column:
    """A header line, left out where the value is null; line breaks cannot get in."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), F.regexp_replace(value, r"[\r\n]+", " "), F.lit("\r\n")), F.lit(""))


def _record(kind: Column, record_id: Column, fields: list[Column], block: Column) -> Column:
    return F.concat(
        F.lit(f"{VERSION}\r\n"),
        _field("WARC-Type", kind),
        _field("WARC-Record-ID", record_id),
        *fields,
        F.lit("Content-Length: "),
        F.octet_length(block).cast("string"),
        F.lit(_END),
        block,
    )


def mark_revisits(pages: DataFrame, *, min_revisit_bytes: int) -> DataFrame:
    """``pages`` (id, url, body) with sha, key, refers and refers_key: of equal payloads,
    the largest id is the response and the others refer to it.

    Payloads are told apart by one SHA-1 each, and no body moves but to the join.
    Rows are combined before the exchange, so a payload of any frequency is one row
    a partition there; the table of responses has one row a repeated payload, and
    Spark sends it to all executors only below its own limit for that.
    """
    marked = pages.withColumn("sha", F.sha1("body"))
    own = F.sha1(F.concat_ws(" ", "sha", F.coalesce("url", F.lit(""))).cast("binary"))
    marked = marked.withColumn("key", F.concat(F.substring(own, 1, 16), F.lit(":"), F.coalesce(F.col("id").cast("string"), F.lit("none"))))
    tops = marked.where(F.octet_length("body") >= min_revisit_bytes).groupBy("sha").agg(F.max(F.struct("id", "key")).alias("top"), F.count("*").alias("n"))
    tops = cut(tops.where("n > 1 and top.id is not null").select("sha", F.col("top.id").alias("top_id"), F.col("top.key").alias("top_key")), "responses")
    revisit = ~F.col("top_id").eqNullSafe(F.col("id")) & F.col("top_id").isNotNull()
    return marked.join(tops, "sha", "left").withColumns({"refers": F.when(revisit, F.col("top_id")), "refers_key": F.when(revisit, F.col("top_key"))}).drop("top_id", "top_key")


def write_archives(
    pages: DataFrame,
    path: str,
    *,
    id_col: str = "page_id",
    url_col: str = "url",
    body_col: str = "html",
    date: str = "2020-01-01T00:00:00Z",
    min_revisit_bytes: int = 0,
    records_per_file: int = 2000,
) -> None:
    """Write one capture per row to gzip files below ``path``.

    Null bodies are empty; null URLs leave the field out.  A record is named by
    its row's id with a digest of URL and body, so rows that share an id, or have
    none, stay apart; rows equal in all three are written as copies of one capture.
    Of equal bodies with one largest id on several rows, all those are responses;
    where no row has an id, all are.  ``records_per_file`` bounds what one reading
    task has to read; it holds one record of it at a time.
    """
    p = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(body_col), F.lit("")).alias("body"))
    p = mark_revisits(p, min_revisit_bytes=min_revisit_bytes)
    name = lambda part, key: F.concat(F.lit(f"<urn:capture:{part}:"), key.cast("string"), F.lit(">"))
    key, target, when = F.col("key"), F.col("url"), F.lit(date)
    main = name("response", key)
    common = [_field("WARC-Date", when), _field("WARC-Target-URI", target)]
    host = F.coalesce(F.regexp_extract(target, r"^\w+://([^/?#\s]+)", 1), F.lit(""))
    asked = F.concat(F.lit("GET / HTTP/1.1\r\nHost: "), host, F.lit(_END))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("body").cast("string"), F.lit(_END))
    revisit = F.col("refers").isNotNull()
    kept = F.when(revisit, head).otherwise(F.concat(head, F.col("body")))
    about = F.concat(F.lit("payloadLength: "), F.octet_length("body").cast("string"), F.lit("\r\n"))
    concurrent = _field("WARC-Concurrent-To", main)
    records = F.concat_ws(
        _END,
        _record(F.lit("request"), name("request", key), [*common, concurrent, _field("Content-Type", F.lit("application/http; msgtype=request"))], asked),
        _record(
            F.when(revisit, "revisit").otherwise("response"),
            main,
            [
                *common,
                _field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32(F.col("sha")))),
                _field("WARC-Refers-To", name("response", F.col("refers_key"))),
                _field("WARC-Profile", F.when(revisit, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
                _field("Content-Type", F.lit("application/http; msgtype=response")),
            ],
            kept,
        ),
        _record(F.lit("metadata"), name("metadata", key), [*common, concurrent, _field("Content-Type", F.lit("application/warc-fields"))], about),
    )
    p.select(records.alias("value")).write.option("lineSep", _END).option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)


def framed(pieces: Iterable[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (lower-case names) and block of each record, framed by Content-Length alone.

    ``pieces`` are a file's bytes split at blank lines, which are put back here.
    """
    end = _END.encode()
    pieces, rest = iter(pieces), b""
    while True:
        rest = rest.lstrip(b"\r\n")
        if not rest:
            if (rest := next(pieces, None)) is None:
                return
            continue
        if not rest.startswith(b"WARC/"):
            raise ValueError(f"no WARC record: {rest[:40]!r}")
        fields: dict[str, str] = {}
        for line in rest.decode("utf-8", "replace").split("\r\n")[1:]:
            k, _, v = line.partition(":")
            fields[k.strip().lower()] = v.strip()
        wanted, block, size = int(fields["content-length"]), [], -len(end)
        while size < wanted:
            if (piece := next(pieces, None)) is None:
                if wanted:
                    raise ValueError("the last record is cut short")
                break
            block.append(piece)
            size += len(piece) + len(end)
        data = block[0] if len(block) == 1 else end.join(block)
        yield fields, data if len(data) == wanted else data[:wanted]
        rest = data[wanted:]


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of an archive's bytes."""
    return framed(data.split(_END.encode()))


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ("record_id", "kind", "concurrent_to", "refers_to", "target", "date", "digest", "body")
    schema = pa.schema([(n, pa.binary() if n == "body" else pa.string()) for n in names])
    pack = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
    lines = (x for b in batches for x in zip(b.column("path").to_pylist(), b.column("value").to_pylist(), strict=True))
    rows, size = [], 0
    for _, file in groupby(lines, key=lambda x: x[0]):
        for f, block in framed(v for _, v in file):
            if f.get("content-type", "").startswith("application/http"):
                block = block.partition(b"\r\n\r\n")[2]
            rows.append((f.get("warc-record-id"), f.get("warc-type"), f.get("warc-concurrent-to"), f.get("warc-refers-to"), f.get("warc-target-uri"), f.get("warc-date"), f.get("warc-payload-digest"), block))
            size += len(block)
            if size > 1 << 22 or len(rows) == 4096:
                yield pack(rows)
                rows, size = [], 0
    if rows:
        yield pack(rows)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """All records of the gzip archives below ``path``; ``body`` is the payload of HTTP blocks,
    ``payload_bytes`` and ``payload_sha1`` are taken from it."""
    lines = spark.read.option("lineSep", _END).option("pathGlobFilter", "*.gz").text(path)
    lines = lines.select(F.col("_metadata.file_path").alias("path"), F.col("value").cast("binary").alias("value"))
    records = lines.mapInArrow(_records, _FRAMED)
    return records.withColumns({"payload_bytes": F.octet_length("body").cast("long"), "payload_sha1": F.sha1("body")})


def without_payloads(records: DataFrame) -> DataFrame:
    """``records`` whose measured payloads stay behind, so that assembly moves headers only."""
    return records.withColumn("body", F.when(~F.col("kind").isin(*_MAIN), F.col("body")))


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: capture_id, request, main (response or revisit), metadata, copies.

    Records meet on the id they are concurrent to.  A record that is missing
    leaves its struct null; of repeated records of one kind the one with the
    smallest id counts, and ``copies`` says how many main records there are;
    records without an id stand alone and are left out.
    """
    columns = ["record_id", "kind", "refers_to", "target", "date", "digest", "payload_bytes", "payload_sha1", "body"]
    keyed = records.select(F.coalesce("concurrent_to", "record_id").alias("capture_id"), F.struct(*columns).alias("r"))
    pick = lambda *kinds: F.min(F.when(F.col("r.kind").isin(*kinds), F.col("r")))
    return (
        keyed.where("capture_id is not null")
        .groupBy("capture_id")
        .agg(pick("request").alias("request"), pick(*_MAIN).alias("main"), pick("metadata").alias("metadata"), F.count_if(F.col("r.kind").isin(*_MAIN)).alias("copies"))
    )


def payload_facts(captures: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of assembled captures,
    a row for each of their copies.

    A response's figures come from its own payload; a revisit holds none, so its
    digest is the header's and its length the metadata record's.
    """
    whole = F.col("main.kind") == "response"
    page = lambda name: F.expr(f"try_cast(regexp_extract({name}, '^<urn:capture:response:[0-9a-f]+:(-?[0-9]+)>$', 1) as long)")
    told = captures.where("main is not null").select(
        page("capture_id").alias("page_id"),
        F.when(whole, F.col("main.payload_bytes")).otherwise(F.expr("try_cast(regexp_extract(cast(metadata.body as string), 'payloadLength: ([0-9]+)', 1) as long)")).alias("payload_bytes"),
        base32(F.col("main.payload_sha1")).alias("own"),
        F.regexp_replace("main.digest", "^sha1:", "").alias("named"),
        F.col("main.kind").alias("record_type"),
        F.when(~whole, page("main.refers_to")).alias("refers_to"),
        F.explode(F.expr(f"sequence(0L, copies - 1, {_COPIES}L)")).alias("from"),
        F.col("copies"),
    )
    told = told.withColumn("payload_digest", F.when(F.col("record_type") == "response", F.col("own")).otherwise(F.col("named")))
    each = F.explode(F.sequence(F.lit(1), F.least(F.lit(_COPIES), F.col("copies") - F.col("from")).cast("int")))
    return told.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", each.alias("copy")).drop("copy")


def digest_of(payload: bytes) -> str:
    """The digest a reader can check a payload against."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()
