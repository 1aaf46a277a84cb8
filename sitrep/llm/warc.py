"""WARC archives of web pages: written once per page, read back one gzip member at a time.

``write_archives`` deals pages to tasks; each task appends records to archives of its own in the
shared folder, one gzip member per record, and reports them in a manifest. Only archives in the
manifest are read, so what a lost executor or a repeated task leaves behind is ignored. Files are
opened through ``pyarrow.fs``, which reaches local, HDFS and object-store folders alike.

A page whose payload (its html in UTF-8) equals that of a page with a smaller ``page_id`` becomes a
``revisit`` record without the payload, if the payload has ``MIN_REVISIT`` bytes or more. Its block
is the HTTP header alone, whose Content-Length states the length of the payload.

``read_archives`` is a sequential reader: blocks of ``BLOCK`` bytes go through one incremental zlib
object per member, records are framed by their Content-Length, and the block digest, and for
responses the payload digest, are computed again and compared. A record is held in memory, an
archive never is.

Awkward input: null html is an empty payload. Of equal payloads the first row by ``page_id`` (nulls
last), then ``url`` (nulls last) is the response; rows equal in all three are one response and
revisits of it, written from one stored payload. Null ids and urls stay null. Empty tables give no
archives and an empty result. Other columns, whatever their names, are not read. A record that
breaks off, has no usable Content-Length or disagrees with a digest raises ``ValueError``.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitrep.llm.common import shared_dir, small_batches, stored

#: Payloads below this length are always stored as responses.
MIN_REVISIT = 100
#: Bytes read from an archive at once.
BLOCK = 1 << 20
#: An archive is closed when it has grown to this size.
ARCHIVE_BYTES = 256 << 20
#: Copies of one row that one row of the plan stands for.
COPIES = 10_000
#: Fixed values of the format.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"

RECORD = (
    "record_id string, record_type string, target_uri string, refers_to_id string, "
    "payload_bytes long, payload_digest string, payload binary"
)
MANIFEST = "archive string, records long, bytes long"


# --- one record ------------------------------------------------------------------------------
def record(
    record_id: str,
    payload: bytes | None,
    length: int,
    digest: str,
    uri: str | None = None,
    refers_to: str | None = None,
) -> bytes:
    """One uncompressed record: a response with its payload, or a revisit of ``refers_to``."""
    block = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        f"Content-Length: {length}\r\n\r\n"
    ).encode()
    if refers_to is None:
        block += payload or b""
    head = [
        "WARC/1.1",
        "WARC-Type: " + ("response" if refers_to is None else "revisit"),
        f"WARC-Record-ID: <{record_id}>",
        f"WARC-Date: {DATE}",
    ]
    if uri is not None:
        head.append("WARC-Target-URI: " + uri.translate(_ONE_LINE))
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head += [
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


#: A header value ends with its line.
_ONE_LINE = {ord("\r"): "%0D", ord("\n"): "%0A"}


def member(data: bytes, level: int = 6) -> bytes:
    """``data`` as one gzip member."""
    squeeze = zlib.compressobj(level, zlib.DEFLATED, 31)
    return squeeze.compress(data) + squeeze.flush()


def members(source) -> Iterator[bytes]:
    """The uncompressed members of a gzip stream, read in blocks."""
    inflate, parts, rest, within = zlib.decompressobj(31), [], b"", False
    while block := rest or source.read(BLOCK):
        parts.append(inflate.decompress(block))
        rest, within = b"", True
        if inflate.eof:
            yield b"".join(parts)
            rest, inflate, parts, within = inflate.unused_data, zlib.decompressobj(31), [], False
    if within:
        raise ValueError("the archive breaks off within a gzip member")


def parse(data: bytes) -> dict[str, object]:
    """The named fields and the block of one record, framed by Content-Length, digests verified."""
    top, found, body = data.partition(b"\r\n\r\n")
    lines = top.decode("utf-8").split("\r\n")
    if not found or not lines[0].startswith("WARC/1."):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    length = fields.get("content-length", "")
    if not length.isdigit() or len(body) != int(length) + 4 or body[-4:] != b"\r\n\r\n":
        raise ValueError(f"{fields.get('warc-record-id')}: the block does not have its Content-Length")
    block = body[:-4]
    if "sha256:" + hashlib.sha256(block).hexdigest() != fields.get("warc-block-digest"):
        raise ValueError(f"{fields.get('warc-record-id')}: the block digest differs")
    return fields | {"block": block}


def page_of(fields: dict[str, object]) -> tuple:
    """A ``RECORD`` row: lengths and digests of the full payload, from the payload where it is."""
    http, _, payload = fields["block"].partition(b"\r\n\r\n")
    stated = next(
        int(x.partition(b":")[2]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")
    )
    digest = fields["warc-payload-digest"].removeprefix("sha256:")
    kind = fields["warc-type"]
    if kind == "response" and (
        len(payload) != stated or hashlib.sha256(payload).hexdigest() != digest
    ):
        raise ValueError(f"{fields['warc-record-id']}: the payload digest differs")
    refers = fields.get("warc-refers-to")
    return (
        fields["warc-record-id"].strip("<>"),
        kind,
        fields.get("warc-target-uri"),
        refers.strip("<>") if refers else None,
        stated,
        digest,
        payload if kind == "response" else None,
    )


# --- writing ---------------------------------------------------------------------------------
def planned(pages: DataFrame) -> DataFrame:
    """``id, url, digest, payload, bytes, start, copies, first_id, first_url, repeat``: records to write.

    Equal rows meet before the shuffle (partial aggregates) and are one row with a number of
    copies; copies beyond ``COPIES`` are rows of their own, dealt anew, without the payload if it
    needs no second record. What decides which page is the response is a table of digests without
    payloads, so a payload that a third of all pages have makes one small row in each task; the
    payloads are shuffled once, by page.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    page_id, url = F.col("page_id").cast("long"), F.col("url").cast("string")
    # no key is null, so that the join below finds the rows already dealt by these keys
    rows = pages.select(
        page_id.isNull().alias("no_id"),
        F.coalesce(page_id, F.lit(0)).alias("id"),
        url.isNull().alias("no_url"),
        F.coalesce(url, F.lit("")).alias("url"),
        F.sha2(html.cast("binary"), 256).alias("digest"),
        html.alias("payload"),
        F.octet_length(html).cast("long").alias("bytes"),
    )
    keys = ["no_id", "id", "no_url", "url", "digest"]
    copies = F.count(F.lit(1)).alias("copies")
    once = rows.groupBy(*keys).agg(F.first("payload").alias("payload"), F.first("bytes").alias("bytes"), copies)
    small = F.when(F.col("bytes") < MIN_REVISIT, F.col("payload"))
    thin = rows.groupBy(*keys).agg(F.first(small).alias("payload"), F.first("bytes").alias("bytes"), copies)

    order = F.struct("no_id", "id", "no_url", "url")
    long = thin.where(F.col("bytes") >= MIN_REVISIT)
    least = long.groupBy("digest").agg(F.min(order).alias("least"), F.count(F.lit(1)).alias("pages"))
    later = (
        long.join(least.where("pages > 1"), "digest")
        .where(order != F.col("least"))
        .select(*keys, F.col("least").alias("first"))
    )

    def known(of: str, no: str) -> Column:
        return F.when(~F.col(no), F.col(of))

    def as_records(of: DataFrame, start: Column, copies: Column) -> DataFrame:
        return of.join(later, keys, "left").select(
            known("id", "no_id").alias("id"),
            known("url", "no_url").alias("url"),
            "digest",
            "payload",
            "bytes",
            start.cast("long").alias("start"),
            copies.cast("long").alias("copies"),
            known("first.id", "first.no_id").alias("first_id"),
            known("first.url", "first.no_url").alias("first_url"),
            F.col("first").isNotNull().alias("repeat"),
        )

    main = as_records(once, F.lit(0), F.least("copies", F.lit(COPIES)))
    many = thin.where(F.col("copies") > COPIES).withColumn(
        "from", F.explode(F.sequence(F.lit(COPIES), F.col("copies") - 1, F.lit(COPIES)))
    )
    more = as_records(many, F.col("from"), F.least(F.col("copies") - F.col("from"), F.lit(COPIES)))
    return main.unionByName(more.repartition("id", "url", "digest", "start"))


def record_id(page_id: int | None, digest: str, url: str | None, copy: int) -> str:
    """The name of a page's record: unique, and the same whenever the page is written again."""
    about = hashlib.sha256(f"{digest}|{'' if url is None else ':' + url}|{copy}".encode()).hexdigest()[:32]
    return f"urn:page:{'' if page_id is None else page_id}:{about}"


def write_archives(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write ``pages(page_id, url, html)`` to archives; the manifest of finished archives."""
    spark = pages.sparkSession
    small_batches(spark)
    folder = folder or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pa.fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else "file://" + folder)
        fs.create_dir(root, recursive=True)
        done, out, name, n = [], None, "", 0
        for b in batches:
            for row in b.to_pylist():
                if out is None:
                    name, n = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = fs.open_output_stream(f"{root}/{name}", compression=None)
                about = row["digest"], row["url"]
                payload = (row["payload"] or "").encode()
                first = record_id(row["id"], *about, 0)
                for copy in range(row["start"], row["start"] + row["copies"]):
                    refers = None
                    if row["repeat"]:
                        refers = record_id(row["first_id"], row["digest"], row["first_url"], 0)
                    elif copy and row["bytes"] >= MIN_REVISIT:
                        refers = first
                    out.write(
                        member(
                            record(
                                record_id(row["id"], *about, copy),
                                payload,
                                row["bytes"],
                                row["digest"],
                                row["url"],
                                refers,
                            )
                        )
                    )
                n += row["copies"]
                if out.tell() >= ARCHIVE_BYTES:
                    done.append((name, n, out.tell()))
                    out.close()
                    out = None
        if out is not None:
            done.append((name, n, out.tell()))
            out.close()
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([f"{folder}/{x[0]}" for x in done], pa.string()),
                pa.array([x[1] for x in done], pa.int64()),
                pa.array([x[2] for x in done], pa.int64()),
            ],
            ["archive", "records", "bytes"],
        )

    return stored(planned(pages).mapInArrow(run, MANIFEST), "warc-manifest")


# --- reading ---------------------------------------------------------------------------------
def read_archives(manifest: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records (``RECORD``) of all archives named in ``manifest(archive)``, digests verified."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [(n, pa.string()) for n in ("record_id", "record_type", "target_uri", "refers_to_id")]
            + [("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())]
        )
        for b in batches:
            for uri in b["archive"].to_pylist():
                fs, path = pa.fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else "file://" + uri)
                rows, held = [], 0
                with fs.open_input_stream(path, compression=None) as source:
                    for data in members(source):
                        row = page_of(parse(data))
                        rows.append(row if with_payload else (*row[:-1], None))
                        held += len(data) if with_payload else 200
                        if held >= BLOCK:
                            yield _batch(rows, schema)
                            rows, held = [], 0
                if rows:
                    yield _batch(rows, schema)

    spark: SparkSession = manifest.sparkSession
    tasks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return manifest.select("archive").repartition(tasks).mapInArrow(run, RECORD)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)]
    return pa.RecordBatch.from_arrays(columns, schema=schema)


def round_trip(pages: DataFrame) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to, url`` as read back."""

    def page(column: str):
        return F.regexp_extract(column, r"^urn:page:(-?\d+):", 1).try_cast("long")

    return read_archives(write_archives(pages), with_payload=False).select(
        page("record_id").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        page("refers_to_id").alias("refers_to"),
        F.col("target_uri").alias("url"),
    )
