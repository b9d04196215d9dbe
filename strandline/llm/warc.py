"""Web archives: gzip members written by tasks, read back by tasks that own byte ranges."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.common import open_folder, small_batches, stored
from strandline.session import scratch_path

MAGIC, VERSION = b"\x1f\x8b\x08", b"WARC/1."
#: Bytes of a range that one task scans, and of one read beyond it.
SPLIT, READ = 8 << 20, 1 << 20
#: Ranges that one reading task takes.
RANGES = 4
#: Bytes that are unpacked at once.
CHUNK = 64 << 10
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Pages have no time of their own.
DATE = "2000-01-01T00:00:00Z"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _field(value: str) -> str:
    """A header value on one line, in ASCII."""
    return quote(value, safe="%/:=&?~#+!$,;'@()*[]")


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One record as a gzip member of its own. A revisit has the HTTP head of its payload, not the payload."""
    sum_ = digest(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{page_id}/{sum_}')}>", f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{sum_}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}",
    ]
    head += [f"WARC-Target-URI: {_field(url)}"] if url is not None else []
    head += [f"Page-ID: {page_id}"] if page_id is not None else []
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{refers_to}/{sum_}')}>", f"Refers-To-Page-ID: {refers_to}"]
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + pack.flush()


def write_archives(pages: DataFrame, folder: str, split: int = SPLIT) -> DataFrame:
    """Writes ``pages`` (page_id, url, payload, refers_to, revisit), one archive per partition; gives (path, size, records, starts).

    ``starts`` has the number of records that begin in each range of ``split``
    bytes; ``records`` is their sum. Every attempt of a task writes a file of its own name. Only the files that the
    returned table names are part of the result, so lost or doubled tasks leave no
    record twice. The table must be stored before it is used.
    """

    def written(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, base = open_folder(folder)
        system.create_dir(base, recursive=True)
        name, size, n, out = f"{uuid.uuid4().hex}.warc.gz", 0, 0, None
        starts: list[int] = []
        for batch in batches:
            for row in batch.itertuples(index=False):
                out = out or system.open_output_stream(f"{base}/{name}", compression=None)
                none = lambda x: None if x is None or x != x else x
                page, to = none(row.page_id), none(row.refers_to)
                member = record(None if page is None else int(page), none(row.url), row.payload, None if to is None else int(to), bool(row.revisit))
                out.write(member)
                starts += [0] * (size // split + 1 - len(starts))
                starts[size // split] += 1
                size, n = size + len(member), n + 1
        if out:
            out.close()
            # A range in which only a long last member goes on has no record.
            starts += [0] * (-(-size // split) - len(starts))
            yield pd.DataFrame({"path": [f"{folder.rstrip('/')}/{name}"], "size": [size], "records": [n], "starts": [starts]})

    # Ids travel as text: a column of whole numbers with nulls would pass through floating point.
    rows = pages.select(F.col("page_id").cast("string").alias("page_id"), "url", "payload", F.col("refers_to").cast("string").alias("refers_to"), "revisit")
    return rows.mapInPandas(written, "path string, size long, records long, starts array<long>")


def _head(data: bytes) -> dict[str, str]:
    lines = data.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])} | {"version": lines[0]}


def _member(parts: Iterator[bytes]) -> tuple[dict[str, str], bytes, int] | None:
    """Head, block and compressed size of the member that ``parts`` begin with; None if it isn't one of a record."""
    unpack = zlib.decompressobj(31)
    out: list[bytes] = []
    fed, first = 0, b""
    try:
        for part in parts:
            fed += len(part)
            out.append(unpack.decompress(part))
            # The first parts may be too short to unpack to anything.
            first = first if len(first) >= len(VERSION) else first + out[-1]
            if not VERSION.startswith(first[: len(VERSION)]):
                return None
            if unpack.eof:
                break
    except zlib.error:
        return None
    whole = b"".join(out)
    end = whole.find(b"\r\n\r\n")
    head = _head(whole[:end]) if unpack.eof and end >= 0 else {}
    length = head.get("content-length", "")
    if "warc-type" not in head or not length.isdigit() or len(whole) != end + 4 + int(length) + 4:
        return None
    return head, whole[end + 4 : end + 4 + int(length)], fed - len(unpack.unused_data)


def records_of_range(system: fs.FileSystem, path: str, start: int, end: int) -> Iterator[tuple[dict[str, str], bytes]]:
    """Records whose member starts in ``[start, end)``.

    The range is scanned for gzip's magic; a place counts if the member there
    unpacks with its checksum and is one whole record. The next member begins
    where one ends, or else the scan goes on.
    """
    with system.open_input_file(path) as file:
        size = file.size()
        file.seek(start)
        data = file.read(min(end, size) - start + len(MAGIC) - 1)
        view = memoryview(data)

        def parts(at: int) -> Iterator[bytes]:
            for i in range(at, len(data), CHUNK):
                yield view[i : i + CHUNK]
            for place in range(start + len(data), size, READ):
                file.seek(place)
                yield file.read(READ)

        at = 0
        while 0 <= (at := data.find(MAGIC, at)) < end - start:
            found = _member(parts(at))
            if found is None:
                at += 1
            else:
                yield found[0], found[1]
                at += found[2]


def read_archives(files: DataFrame, split: int = SPLIT) -> DataFrame:
    """Records of the archives ``(path, size)``: page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload.

    ``payload`` is null for revisits. A record whose payload doesn't have the
    digest of its head raises. Where ``files`` has ``starts`` for the same ``split``,
    a range with another number of records raises too, so none is left out unseen.
    """
    starts = F.col("starts") if "starts" in files.columns else F.lit(None).cast("array<long>")
    ranges = files.select("path", "size", starts.alias("starts"), F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("size") - 1, F.lit(0)), F.lit(split).cast("long"))).alias("start"))
    # As text, since numbers with nulls would pass through floating point.
    written = F.get("starts", (F.col("start") / split).cast("int")).cast("string").alias("written")
    ranges = ranges.select("path", "start", F.least(F.col("start") + split, "size").alias("end"), written)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                system, path = open_folder(r.path)
                rows, held, n = [], 0, 0
                for head, block in records_of_range(system, path, int(r.start), int(r.end)):
                    http, _, payload = block.partition(b"\r\n\r\n")
                    kind, sum_ = head["warc-type"], head.get("warc-payload-digest", "").removeprefix("sha1:")
                    if kind == "response" and digest(payload) != sum_:
                        raise ValueError(f"payload of {head.get('warc-record-id')} in {path} has another digest")
                    rows.append((head.get("page-id"), head.get("warc-target-uri"), kind, head.get("refers-to-page-id"), int(_head(http)["content-length"]), sum_, payload if kind == "response" else None))
                    held, n = held + len(payload), n + 1
                    if held > SPLIT:
                        yield pd.DataFrame(rows, columns=COLUMNS)
                        rows, held = [], 0
                if r.written is not None and n != int(r.written):
                    raise ValueError(f"{n} records of {r.written} in bytes {r.start} to {r.end} of {path}")
                yield pd.DataFrame(rows, columns=COLUMNS)

    # An explicit number: the rows are small, the bytes they stand for aren't, so they must not be merged by size.
    tasks = ranges.count()
    out = ranges.repartitionByRange(max(1, -(-tasks // RANGES)), "path", "start").mapInPandas(read, "page_id string, url string, record_type string, refers_to string, payload_bytes long, payload_digest string, payload binary")
    return out.withColumns({"page_id": F.col("page_id").cast("long"), "refers_to": F.col("refers_to").cast("long")})


COLUMNS = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"]


def to_records(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """``pages`` with the decision which records are responses: page_id, url, payload, refers_to, revisit.

    Of equal payloads of at least ``least_bytes`` bytes, rows with the largest
    page_id are responses (more than one if a row is repeated), the others refer
    to it; rows without id are revisits unless no row of the group has one.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("_sum", F.sha2("payload", 256))
    groups = rows.groupBy("_sum").agg(F.max("page_id").alias("_first"))
    revisit = (F.octet_length("payload") >= least_bytes) & ~F.col("page_id").eqNullSafe(F.col("_first"))
    return rows.join(groups, "_sum").select("page_id", "url", "payload", F.when(revisit, F.col("_first")).alias("refers_to"), revisit.alias("revisit"))


def archive(spark: SparkSession, pages: DataFrame, least_bytes: int = 0, split: int = SPLIT) -> DataFrame:
    """Writes all ``pages`` to archives in the shared folder and gives what is read back from them.

    Null html is an empty payload, null urls and ids have no field in the record;
    an empty table gives no archive and no row. Other columns are not read. Raises
    if another number of records is read than was written.
    """
    small_batches(spark)
    files = stored(write_archives(to_records(pages, least_bytes), scratch_path(spark, "warc"), split), "warc-files")
    return read_archives(files, split)


SQL = r"""
with p as (select page_id, encode(coalesce(html, '')) as payload from pages),
r as (select *, max(page_id) over (partition by payload) as first_id, sha1(payload) as hex from p),
b as (select *, array_to_string(list_transform(range(1, 41), lambda i: substr('0000000100100011010001010110011110001001101010111100110111101111', 1 + 4 * (strpos('0123456789abcdef', substr(hex, i, 1)) - 1), 4)), '') as bits from r)
select page_id, octet_length(payload) as payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + list_sum(list_transform(range(1, 6), lambda k: cast(substr(bits, 5 * j + k, 1) as int) * (2 ** (5 - k))::int))::int, 1)), '') as payload_digest,
       case when page_id = first_id then 'response' else 'revisit' end as record_type,
       case when page_id = first_id then null else first_id end as refers_to
from b
"""
