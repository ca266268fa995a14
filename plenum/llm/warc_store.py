"""A content-addressed WARC archive: payloads once by digest, record headers apart, records by join.

`store` has one row for each different payload, under its SHA-256 and length; `headers` has the exact header
block of every record. A record is its header block, the payload if it is a response, and two line ends;
`reconstruct` joins the two tables to give its bytes, `export` writes them as WARC 1.1 files with one gzip
member a record, and `parse` reads such files, plain or of any number of members, with records of any type.

Digests are taken where pages are read, and finding the owner of a payload moves digests only. Payloads that
occur once go to the store from where they are read; only repeated ones are merged, first where they were
read, unless there are too many to tell the executors which they are. Payloads then move once, to their headers.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plenum.llm.common import shared_dir, written

LEAST, CLOSE = 1000, "\r\n\r\n"
#: Digests of repeated payloads that are broadcast, some 100 bytes each; with more all payloads are merged by shuffle.
BROADCAST = 200_000
#: Bytes of a WARC file, about, and of the records that leave Python at a time.
FILE, BATCH = 16 << 20, 4 << 20
#: Of the WARC standard.
IDENTICAL, EPOCH = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "1970-01-01T00:00:00Z"
KEY = ["sha256", "length"]


def _payloads(pages: DataFrame, *more) -> DataFrame:
    body = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    return pages.select(*more, body.alias("payload")).select(*more, "payload", F.sha2("payload", 256).alias("sha256"), F.octet_length("payload").cast("long").alias("length"))


def digested(pages: DataFrame) -> DataFrame:
    """(page_id, url, sha1, sha256, length) of every row of pages; null html is empty."""
    return _payloads(pages, "page_id", "url").select("page_id", "url", F.sha1("payload").alias("sha1"), *KEY)


def records(digests: DataFrame, least: int = LEAST) -> DataFrame:
    """digested() rows with record_type and refers_to.

    Of rows with equal payloads of at least `least` bytes the one with the largest page_id is the response
    and the others revisit it; of rows that repeat that page_id each is a response. Rows without a page_id
    revisit a row that has one and their payload, or else are responses.
    """
    owner = digests.where(F.col("length") >= least).groupBy(*KEY).agg(F.max("page_id").alias("owner"), F.count("*").alias("n")).where("n > 1").drop("n")
    again = F.col("owner").isNotNull() & ~F.col("owner").eqNullSafe(F.col("page_id"))
    both = digests.join(owner, KEY, "left")
    return both.select(*digests.columns, F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("owner")).alias("refers_to"))


def _line(name: str, value):
    return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))


def _urn(column: str):
    """A record's id: that of its page, percent-encoded, or one that says that there is none."""
    return F.coalesce(F.concat(F.lit("<urn:page:"), F.url_encode(F.col(column).cast("string")), F.lit(">")), F.lit("<urn:page-without-id>"))


def header(date: str = EPOCH):
    """The header block of a row of records(), with its blank line.

    A url with control characters stands percent-encoded there, and as it is in a field of its own, in base 64;
    a null url has no field. date says when the pages were fetched, as the table does not. A revisit names the
    length of the payload that it leaves out.
    """
    revisit = F.col("record_type") == "revisit"
    odd = F.col("url").rlike(r"[\x00-\x1F\x7F]")
    plain = F.regexp_replace(F.url_encode("url"), r"\+", "%20")
    return F.concat(
        F.lit("WARC/1.1\r\n"), _line("WARC-Type", F.col("record_type")), _line("WARC-Record-ID", _urn("page_id")), _line("WARC-Date", F.lit(date)),
        F.when(F.col("url").isNull(), "").otherwise(_line("WARC-Target-URI", F.when(odd, plain).otherwise(F.col("url")))),
        F.when(odd, _line("X-Target-URI-Base64", F.translate(F.base64(F.col("url").cast("binary")), "\r\n", ""))).otherwise(""),
        _line("Content-Type", F.lit("text/html; charset=utf-8")), _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        F.when(revisit, F.concat(_line("WARC-Profile", F.lit(IDENTICAL)), _line("WARC-Refers-To", _urn("refers_to")), _line("X-Payload-Length", F.col("length").cast("string")))).otherwise(""),
        _line("Content-Length", F.when(revisit, "0").otherwise(F.col("length").cast("string"))), F.lit("\r\n"),
    )


def write(pages: DataFrame, out: str, least: int = LEAST, date: str = EPOCH, broadcast: int = BROADCAST) -> None:
    """Write the archive's tables, headers and store, below out."""
    digests = written(digested(pages), "digests")
    rows = records(digests, least)
    rows.select("page_id", F.col("record_type"), header(date).alias("header"), *KEY).write.option("compression", "zstd").parquet(f"{out}/headers")
    repeated = written(digests.groupBy(*KEY).agg(F.count("*").alias("n")).where("n > 1").select(*KEY), "repeated", compact=True)
    payloads = _payloads(pages)
    if repeated.count() <= broadcast:
        small = F.broadcast(repeated)
        once = payloads.join(small, KEY, "left_anti")
        payloads = once.unionByName(payloads.join(small, KEY, "left_semi").dropDuplicates(KEY))
    else:
        payloads = payloads.dropDuplicates(KEY)
    payloads.write.option("compression", "zstd").parquet(f"{out}/store")


def store(spark: SparkSession, out: str) -> DataFrame:
    """The store, each payload checked against its digest and length; a payload that fails ends the query."""
    rows = spark.read.parquet(f"{out}/store")
    good = (F.sha2("payload", 256) == F.col("sha256")) & (F.octet_length("payload") == F.col("length"))
    return rows.withColumn("payload", F.when(good, F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("a stored payload is not that of digest "), F.col("sha256"))).cast("binary")))


def reconstruct(spark: SparkSession, out: str) -> DataFrame:
    """(page_id, record): the exact bytes of every record, closing line ends included; revisits need no payload."""
    headers, close = spark.read.parquet(f"{out}/headers"), F.lit(CLOSE.encode())
    whole = headers.where("record_type = 'response'").join(store(spark, out), KEY)
    bare = headers.where("record_type = 'revisit'").select("page_id", F.concat(F.col("header").cast("binary"), close).alias("record"))
    return whole.select("page_id", F.concat(F.col("header").cast("binary"), F.col("payload"), close).alias("record")).union(bare)


def export(spark: SparkSession, out: str, warc: str, size: int = FILE, level: int = 6) -> None:
    """Write all records as WARC files below warc, each record a gzip member, some `size` bytes a file.

    Spark's text writer writes them, one value a file, so that they are committed like any other output; the
    zero byte that it adds is padding, which readers of gzip skip.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for record in batch.column("record"):
                packer = zlib.compressobj(level, zlib.DEFLATED, 31)
                held.append(packer.compress(record.as_buffer()) + packer.flush())
                n += len(held[-1])
                if n >= size:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["value"])
                    held, n = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["value"])

    files = reconstruct(spark, out).select("record").mapInArrow(run, "value binary")
    files.select(F.col("value").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).option("lineSep", "\0").text(warc)


def members(content: bytes) -> Iterator[bytes]:
    """What the members of a gzip file hold, or the whole of a plain one; zero bytes between members are padding."""
    if content[:2] != b"\x1f\x8b":
        yield content
        return
    at, view = 0, memoryview(content)
    while at < len(content):
        if content[at] == 0:
            at += 1
            continue
        opener = zlib.decompressobj(31)
        yield opener.decompress(view[at:])
        if not opener.eof:
            raise ValueError("a gzip member breaks off")
        at = len(content) - len(opener.unused_data)


def split(data: bytes) -> Iterator[tuple[dict[bytes, bytes], bytes, bytes]]:
    """(fields by lower-case name, header block, content block) of the records that stand one after another."""
    at = 0
    while at < len(data):
        if data[at : at + 5] != b"WARC/":
            raise ValueError(f"no record begins at byte {at}")
        end = data.index(b"\r\n\r\n", at) + 4
        fields = {}
        for line in data[at : end - 4].split(b"\r\n")[1:]:
            name, _, value = line.partition(b":")
            fields[name.strip().lower()] = value.strip()
        n = int(fields[b"content-length"])
        if end + n > len(data):
            raise ValueError("a record breaks off")
        yield fields, data[at:end], data[end : end + n]
        at = end + n
        while data[at : at + 2] == b"\r\n":
            at += 2


def parse(spark: SparkSession, warc: str) -> DataFrame:
    """(fields, header, payload) of every record of the WARC files below warc, plain or gzip.

    fields has the header's values by lower-case name. A damaged file ends the query.
    """
    kind = pa.map_(pa.string(), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def out():
            fields = pa.array([[(k.decode("utf-8", "replace"), v.decode("utf-8", "replace")) for k, v in r[0].items()] for r in held], kind)
            return pa.RecordBatch.from_arrays([fields, *(pa.array([r[k] for r in held], pa.binary()) for k in (1, 2))], ["fields", "header", "payload"])

        for batch in batches:
            for content in batch.column("content"):
                for data in members(content.as_py()):
                    for record in split(data):
                        held.append(record)
                        n += len(record[1]) + len(record[2])
                        if n >= BATCH:
                            yield out()
                            held, n = [], 0
        if held:
            yield out()

    files = spark.read.format("binaryFile").load(warc).select("content")
    return files.mapInArrow(run, "fields map<string, string>, header binary, payload binary")


def _page(urn, kind):
    """The page's id in a record's id, or null."""
    return F.url_decode(F.nullif(F.regexp_extract(urn, "^<urn:page:(.*)>$", 1), F.lit(""))).cast(kind)


def read(spark: SparkSession, warc: str, kind: str = "bigint") -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to) of every record of the files below warc.

    Length and SHA-1 of a response are taken of its payload, and must be those that its header names; of a
    revisit they are what the header says.
    """
    field = lambda name: F.try_element_at("fields", F.lit(name))
    rows = parse(spark, warc).select(
        field("warc-record-id").alias("id"), field("warc-target-uri").alias("uri"), field("x-target-uri-base64").alias("exact"), field("warc-type").alias("record_type"), field("warc-refers-to").alias("to"),
        F.regexp_replace(field("warc-payload-digest"), "^sha1:", "").alias("named"), field("x-payload-length").cast("long").alias("left_out"), F.sha1("payload").alias("sha1"), F.octet_length("payload").cast("long").alias("n"),
    )
    response = F.col("record_type") == "response"
    good = ~response | (F.col("sha1") == F.col("named"))
    digest = F.when(good, F.col("named")).otherwise(F.raise_error(F.concat(F.lit("the payload is not what its header says: "), F.col("id"))))
    return rows.select(
        _page(F.col("id"), kind).alias("page_id"), F.coalesce(F.unbase64("exact").cast("string"), "uri").alias("url"), F.when(response, F.col("n")).otherwise(F.col("left_out")).alias("payload_bytes"),
        digest.alias("payload_digest"), "record_type", _page(F.col("to"), kind).alias("refers_to"),
    )


def op7_warc_store(spark, sf_dir: str) -> DataFrame:
    """Every page's record as read back from WARC files of all pages."""
    base, pages = shared_dir(spark, lasting=True), spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    write(pages, f"{base}/archive")
    export(spark, f"{base}/archive", f"{base}/warc")
    return read(spark, f"{base}/warc", pages.schema["page_id"].dataType.simpleString()).drop("url")


ORACLE = {
    "op7_warc_store": f"""
with p as (select page_id, coalesce(html, '') as body from pages),
o as (select body, max(page_id) as owner from p where strlen(body) >= {LEAST} group by body having count(*) > 1)
select page_id, strlen(p.body) as payload_bytes, sha1(p.body) as payload_digest,
       case when owner is not null and owner is distinct from page_id then 'revisit' else 'response' end as record_type,
       case when owner is distinct from page_id then owner end as refers_to
from p left join o on p.body = o.body"""
}
