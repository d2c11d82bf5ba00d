"""WARC archives as chunked record tables.

An archive is a table of byte chunks: archive, seq, record, chunk, last, bytes. The bytes of
one archive in order of seq are a WARC/1.1 file; a record's first chunk starts with its
header. Payloads are cut into chunks before anything else touches them: a first pass carries
SHA-1 digests from chunk to chunk and keeps only lengths and digests, the second shuffles
the chunks to their headers, the reader carries digests again. None holds a whole record.

Of records with equal payloads the one with the smallest page_id is a response, the others
are revisits that name it. Payload digests meet in a partially aggregated group; digests
that very many pages share are joined by broadcast, so they are no hot spot. Both passes
name a row by page_id, length and a 64-bit hash of its payload; each row is a record of its
own, under a number given in the second pass.

The reader runs over the archive files as they lie. A record whose chunks lie in two read
tasks is noticed and read again by a shuffle of its own chunks only.

Defined results: null html is an empty payload; a page_id may stand in several rows, each
is judged by its own payload: those that hold the payload's smallest page_id are all
responses; a null page_id is kept, is never a revisit and never referred to; payloads below
``least_bytes`` are always responses; an empty table gives no rows; columns beside page_id,
url and html are ignored.
"""

from __future__ import annotations

import base64
import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratafold.operators.skew import heavy_join
from stratafold.scratch import discard, materialize

CHUNK = 256 << 10
DATE = "2000-01-01T00:00:00Z"
KEY = ["page_id", "n", "tie"]


def parse_header(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "surrogateescape").split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("no WARC record starts here")
    return dict(x.split(": ", 1) for x in lines[1:] if x)


def chunked(pages: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """record, page_id, url, n, tie, chunk, chunks, part: payloads cut up where they are read; the chunks of a row follow each other."""
    rows = pages.select(
        F.monotonically_increasing_id().alias("record"), F.col("page_id").cast("long").alias("page_id"), "url",
        F.encode(F.coalesce("html", F.lit("")), "utf-8").alias("payload"), F.xxhash64(F.coalesce("html", F.lit(""))).alias("tie"),
    )
    rows = rows.withColumn("n", F.octet_length("payload").cast("long"))
    rows = rows.withColumn("chunks", F.greatest(F.ceil(F.col("n") / F.lit(chunk)), F.lit(1)).cast("int"))
    rows = rows.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    return rows.select("record", "page_id", "url", "n", "tie", "chunk", "chunks", F.substr("payload", F.col("chunk") * chunk + 1, F.lit(chunk)).alias("part"))


def payload_digests(chunks: DataFrame) -> DataFrame:
    """page_id, n, tie and digest (base 32) of every different row."""
    names, types = ["page_id", "n", "tie", "digest"], [pa.int64(), pa.int64(), pa.int64(), pa.string()]

    def carry(batches):
        digest = None
        for batch in batches:
            out = []
            for page, n, tie, k, of, part in zip(*batch.columns):
                digest = hashlib.sha1() if k.as_py() == 0 else digest
                digest.update(part.as_buffer())
                if k.as_py() == of.as_py() - 1:
                    out.append((page.as_py(), n.as_py(), tie.as_py(), base64.b32encode(digest.digest()).decode()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    rows = chunks.select(*KEY, "chunk", "chunks", "part").mapInArrow(carry, "page_id long, n long, tie long, digest string")
    return rows.dropDuplicates(KEY)


def plan_records(digests: DataFrame, least_bytes: int = 0) -> DataFrame:
    """The digests with refers_to, the page that holds the payload first, where that is another one."""
    digests = materialize(digests, "digests")
    first = digests.filter(F.col("n") >= least_bytes).groupBy("digest", "n").agg(F.min("page_id").alias("first"), F.count("*").alias("held"))
    first = materialize(first.filter("held > 1"), "firsts")
    later = heavy_join(digests, first, ["digest", "n"], "held", digests.count()).filter("page_id > first")
    refers = later.select(*KEY, F.col("first").alias("refers_to"))
    planned = digests.join(refers.hint("merge"), KEY, "left")
    return planned.select(*KEY, "digest", "refers_to")


def header(kind, page, record, url, length, digest, refers_to):
    """The header of a record, with the empty line after it, as a string column; empty fields are left out."""
    field = lambda name, value: F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n"))
    page_of = lambda x: F.concat(F.lit("<urn:page:"), x.cast("string"), F.lit(">"))
    uri = F.regexp_replace(F.regexp_replace(url, "\r", "%0D"), "\n", "%0A")
    profile = F.when(refers_to.isNotNull(), F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
    name = F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("")), F.lit(":"), record.cast("string"), F.lit(">"))
    return F.concat_ws(
        "", F.lit("WARC/1.1\r\n"), field("WARC-Type", kind), field("WARC-Record-ID", name), field("WARC-Date", F.lit(DATE)),
        field("WARC-Target-URI", uri), field("WARC-Refers-To", page_of(refers_to)), field("WARC-Profile", profile),
        field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), digest)), field("Content-Type", F.lit("text/html; charset=utf-8")),
        field("Content-Length", length), F.lit("\r\n"),
    )


def write_chunks(chunks: DataFrame, plan: DataFrame) -> DataFrame:
    """The archive table: one archive per partition. The chunks of a record stay together and in order."""
    same = chunks["page_id"].eqNullSafe(plan["page_id"]) & (chunks["n"] == plan["n"]) & (chunks["tie"] == plan["tie"])
    rows = chunks.join(plan.hint("merge"), same).select(chunks["*"], "digest", "refers_to")
    rows = rows.filter("refers_to is null or chunk = 0").sortWithinPartitions("record", "chunk")
    whole = F.col("refers_to").isNull()
    kind = F.when(whole, F.lit("response")).otherwise(F.lit("revisit"))
    last = ~whole | (F.col("chunk") == F.col("chunks") - 1)
    length = F.when(whole, F.col("n")).otherwise(F.lit(0))
    head = F.when(F.col("chunk") == 0, F.encode(header(kind, F.col("page_id"), F.col("record"), F.col("url"), length, F.col("digest"), F.col("refers_to")), "utf-8"))
    part = F.when(whole, F.col("part")).otherwise(F.lit(b""))
    end = F.when(last, F.lit(b"\r\n\r\n")).otherwise(F.lit(b""))
    return rows.select(
        F.spark_partition_id().alias("archive"), F.monotonically_increasing_id().alias("seq"), "record", "chunk", last.alias("last"),
        F.concat(F.coalesce(head, F.lit(b"")), part, end).alias("bytes"),
    )


READ = "record long, page_id long, kind string, payload_bytes long, payload_digest string, refers_to long, whole boolean"


def _read(batches):
    """Rows of READ from chunks in order; ``whole`` is false for records of which chunks are missing here."""
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]
    names = [x.split()[0] for x in READ.split(", ")]
    table = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
    torn = lambda record: (record, None, None, None, None, None, False)
    record, after, head, digest, size, want, broken = None, 0, {}, None, 0, 0, False
    for batch in batches:
        out = []
        for rec, chunk, last, data in zip(*[batch.column(n).to_pylist() for n in ("record", "chunk", "last", "bytes")]):
            if record is not None and (chunk == 0 or rec != record or chunk != after):
                out.append(torn(record))
                record, broken = None, False
            if chunk == 0:
                end = data.index(b"\r\n\r\n") + 4
                head, data, digest, size = parse_header(data[:end]), data[end:], hashlib.sha1(), 0
                want, record = int(head["Content-Length"]), rec
            elif record is None:
                record, broken = rec, True
            after = chunk + 1
            if not broken:
                part = data[: want - size]
                digest.update(part)
                size += len(part)
            if last:
                if broken:
                    out.append(torn(rec))
                else:
                    named = head["WARC-Payload-Digest"].removeprefix("sha1:")
                    found = base64.b32encode(digest.digest()).decode()
                    if size != want or head["WARC-Type"] == "response" and found != named:
                        raise ValueError(f"record {rec} is damaged")
                    page, refers = head["WARC-Record-ID"][10:].split(":")[0], head.get("WARC-Refers-To")
                    out.append((rec, int(page) if page else None, head["WARC-Type"], size, named, int(refers[10:-1]) if refers else None, True))
                record, broken = None, False
        if out:
            yield table(out)
    if record is not None:
        yield table([torn(record)])


def read_records(archives: DataFrame) -> DataFrame:
    """record, page_id, kind, payload_bytes, payload_digest, refers_to of every record of a stored archive table."""
    found = materialize(archives.select("record", "chunk", "last", "bytes").mapInArrow(_read, READ), "warc-read")
    torn = found.filter("not whole").select("record").distinct()
    good = found.filter("whole").drop("whole")
    if torn.isEmpty():
        return good
    again = archives.select("archive", "seq", "record", "chunk", "last", "bytes").join(torn.hint("merge"), "record", "left_semi")
    again = again.repartition("record").sortWithinPartitions("record", "archive", "seq")
    good = good.join(torn, "record", "left_anti")
    return good.union(again.select("record", "chunk", "last", "bytes").mapInArrow(_read, READ).drop("whole"))


def archive(pages: DataFrame, least_bytes: int = 0, chunk: int = CHUNK) -> DataFrame:
    """The stored archive table of the pages."""
    chunks = chunked(pages, chunk)
    plan = materialize(plan_records(payload_digests(chunks), least_bytes), "plan")
    stored = materialize(write_chunks(chunks, plan), "warc")
    discard(plan)
    return stored


def archive_and_read(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to per page, as read back."""
    records = read_records(archive(pages, least_bytes))
    # A revisit's length is that of the response it names: payloads of one digest are one payload.
    lengths = records.filter("kind = 'response'").groupBy("payload_digest").agg(F.max("payload_bytes").alias("n"))
    held = records.filter("kind = 'revisit'").groupBy("payload_digest").agg(F.count("*").alias("held"))
    named = materialize(lengths.join(held.hint("merge"), "payload_digest"), "named")
    revisits = records.filter("kind = 'revisit'")
    revisits = heavy_join(revisits, named, ["payload_digest"], "held", named.agg(F.sum("held")).first()[0] or 0)
    columns = ["page_id", "payload_bytes", "payload_digest", F.col("kind").alias("record_type"), "refers_to"]
    return records.filter("kind = 'response'").select(*columns).union(revisits.withColumn("payload_bytes", F.col("n")).select(*columns))


def oracle() -> str:
    """The same rows in DuckDB; base 32 is spelled out five bits at a time."""
    return f"""
with p as (select page_id, coalesce(html, '') as h from pages),
d as (select page_id, strlen(h) as n, sha1(h) as sha from p),
f as (select *, min(page_id) over (partition by sha) as first from d),
s as (select distinct sha from d),
nib as (select sha, string_agg(lpad(bin(strpos('0123456789abcdef', substr(sha, k, 1)) - 1), 4, '0'), '' order by k) as bits
  from (select sha, unnest(range(1, 41)) as k from s) group by sha),
b32 as (select sha, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + 16 * cast(substr(bits, 5*i+1, 1) as int) + 8 * cast(substr(bits, 5*i+2, 1) as int)
  + 4 * cast(substr(bits, 5*i+3, 1) as int) + 2 * cast(substr(bits, 5*i+4, 1) as int) + cast(substr(bits, 5*i+5, 1) as int), 1), '' order by i) as digest
  from (select sha, bits, unnest(range(32)) as i from nib) group by sha)
select page_id, n as payload_bytes, digest as payload_digest,
  case when page_id = first then 'response' else 'revisit' end as record_type,
  case when page_id <> first then first end as refers_to
from f join b32 using (sha)"""
