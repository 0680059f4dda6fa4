"""WARC archives: one gzip member a record, and a splittable reader over byte ranges."""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wrenchlake.llm.common import shared_dir, small, stored

#: Fixed values of RFC 1952 and of the WARC 1.1 format.
MAGIC = b"\x1f\x8b\x08"
VERSION = re.compile(rb"WARC/\d\.\d\r\n")
END = b"\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

CHUNK = 1 << 20
#: Records with shorter payloads are never revisits.
MIN_REVISIT_BYTES = 100

MANIFEST = "path string, bytes long, records long"
RECORDS = (
    "path string, offset long, warc_type string, record_id string, refers_to string, target_uri string, "
    "page_id long, refers_to_page long, content_type string, payload_digest string, payload_bytes long, payload binary, intact boolean"
)


def _filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    uri = re.sub(r"^s3[an]:", "s3:", uri)  # Spark's names of that scheme
    return pafs.FileSystem.from_uri(uri) if re.match(r"[a-z0-9+]+:", uri) else (pafs.LocalFileSystem(), uri)


def _urn(page_id: int | None, nth: int = 1) -> str:
    """The record id of the nth row of a page id; the first has none but the page's in it."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}' + (f'#{nth}' if nth > 1 else ''))}>"


def build_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, nth: int = 1) -> bytes:
    """One record: a response holding the payload, or a revisit that names the record that holds it. ``nth`` numbers
    rows of one page id. A page without id has no X-Page-Id."""
    uri = re.sub(r"[\x00-\x20\x7f]", "%20", url or "")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {_urn(page_id, nth)}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha256:{digest}",
        *([] if page_id is None else [f"X-Page-Id: {page_id}"]),
    ]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: {_urn(refers_to)}", f"X-Refers-To-Page-Id: {refers_to}", f"WARC-Profile: {REVISIT_PROFILE}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("utf-8") + END + block + END


def gzip_member(data: bytes, level: int = 6) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write ``pages(page_id, url, html, refers_to, nth)`` as archives; the manifest ``(path, bytes, records)``.

    A task streams its rows into one file of a name of its own attempt and returns it in the manifest, so a
    lost or repeated task leaves at most a file that no manifest lists. The manifest is stored before anything
    is read, hence each file is written once. ``html`` null is an empty payload; ``page_id`` and ``url`` may be null.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, out, n, size = f"{folder}/part-{uuid.uuid4().hex}.warc.gz", None, 0, 0
        for batch in batches:
            for page_id, url, html, refers_to, nth in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to", "nth"))):
                if out is None:
                    fs, at = _filesystem(path)
                    fs.create_dir(at.rpartition("/")[0], recursive=True)
                    out = fs.open_output_stream(at, compression=None)
                payload = (html or "").encode("utf-8")
                member = gzip_member(build_record(page_id, url, payload, hashlib.sha256(payload).hexdigest(), refers_to, nth))
                out.write(member)
                n, size = n + 1, size + len(member)
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "bytes": [size], "records": [n]})

    return stored(pages.select("page_id", "url", "html", "refers_to", "nth").mapInArrow(write, MANIFEST), "warc-manifest")


class _Window:
    """Bytes of a file around a moving offset, read a chunk at a time."""

    def __init__(self, file, size: int):
        self.file, self.size, self.at, self.data = file, size, 0, b""

    def read(self, at: int, n: int = CHUNK) -> bytes:
        """Up to ``n`` bytes from ``at``; fewer only at the end of the file."""
        n = min(n, self.size - at)
        if not (self.at <= at and at + n <= self.at + len(self.data)):
            self.file.seek(at)
            self.at, self.data = at, self.file.read(max(n, min(CHUNK, self.size - at)))
        return self.data[at - self.at : at - self.at + n]


def _member(window: _Window, at: int) -> tuple[bytes, int] | None:
    """The content and end of the gzip member at ``at``; None if a WARC header can't be decoded there."""
    inflate, parts, got, pos, sure = zlib.decompressobj(31), [], 0, at, False
    while not inflate.eof:
        raw = window.read(pos, min(CHUNK, 1 << 12) if not sure else CHUNK)
        if not raw:
            return None
        try:
            part = inflate.decompress(raw)
        except zlib.error:
            return None
        pos += len(raw) - len(inflate.unused_data)
        parts.append(part)
        got += len(part)
        if not sure and got >= 10:
            if not VERSION.match(b"".join(parts)[:16]):
                return None
            sure = True
    return (b"".join(parts), pos) if sure else None


def _fields(head: bytes) -> dict[str, str]:
    """Header fields by lower-case name; continued lines are joined, the first of a repeated name counts."""
    out: dict[str, str] = {}
    text = re.sub(rb"\r\n[ \t]+", b" ", head).decode("utf-8", "replace")
    for line in text.split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if colon:
            out.setdefault(name.strip().lower(), value.strip())
    return out


def parse_records(data: bytes) -> list[dict]:
    """The records of a member: one by the standard's advice, but a member may hold several, one after the other."""
    out, at = [], 0
    while VERSION.match(data, at):
        head = data.find(END, at)
        if head < 0:
            break
        said = _fields(data[at:head]).get("content-length", "")
        end = head + len(END) + int(said) + len(END) if said.isdigit() else len(data)
        out.append(parse_record(data[at:] if not VERSION.match(data, end) else data[at:end]))
        at = end
    return [r for r in out if r]


def parse_record(data: bytes) -> dict | None:
    """A record's fields; None if the header isn't complete. ``intact`` says if lengths and digest hold."""
    head, found, rest = data.partition(END)
    if not found:
        return None
    f = _fields(head)
    length = int(f["content-length"]) if f.get("content-length", "").isdigit() else len(rest)
    block, kind = rest[:length], f.get("warc-type")
    payload, http = block, {}
    if f.get("content-type", "").startswith("application/http"):
        top, _, payload = block.partition(END)
        http = _fields(top)
    said = f.get("warc-payload-digest", "").removeprefix("sha256:") or None
    size, intact = len(payload), len(block) == length and rest[length:] == END
    if kind == "revisit":
        payload, size = None, int(http["content-length"]) if http.get("content-length", "").isdigit() else None
    elif said is not None and re.fullmatch("[0-9a-f]{64}", said):
        intact = intact and hashlib.sha256(payload).hexdigest() == said
    number = lambda name: int(f[name]) if re.fullmatch(r"-?\d{1,18}", f.get(name, "")) else None
    return {
        "warc_type": kind, "record_id": f.get("warc-record-id"), "refers_to": f.get("warc-refers-to"), "target_uri": f.get("warc-target-uri"),
        "page_id": number("x-page-id"), "refers_to_page": number("x-refers-to-page-id"), "content_type": f.get("content-type"), "payload_digest": said or (hashlib.sha256(payload).hexdigest() if payload is not None else None),
        "payload_bytes": size, "payload": payload, "intact": intact,
    }


def records_between(uri: str, size: int, start: int, end: int) -> Iterator[dict]:
    """Records whose gzip member starts in ``[start, end)``, read on past ``end`` where a record does.

    Every occurrence of the magic bytes is a candidate; it counts if inflating there gives a WARC header, which
    chance bytes inside compressed data do not. After a record the scan goes on at the member's end.
    """
    fs, path = _filesystem(uri)
    with fs.open_input_file(path) as file:
        window, at = _Window(file, size), start
        while at < end:
            raw = window.read(at, min(CHUNK, end - at + len(MAGIC) - 1))
            hit = raw.find(MAGIC)
            if hit < 0:
                at += max(1, len(raw) - len(MAGIC) + 1)
                continue
            at += hit
            if at >= end:
                return
            found = _member(window, at)
            records = parse_records(found[0]) if found else []
            if not records:
                at += 1
                continue
            for record in records:
                yield {"path": uri, "offset": at} | record
            at = found[1]


def read_archives(spark: SparkSession, manifest: DataFrame, split_bytes: int = 8 << 20, payloads: bool = True) -> DataFrame:
    """Records of the files in ``manifest(path, bytes)``, in splits of ``split_bytes``.

    A record belongs to the split its member starts in, so splits need not know of each other: a reader that starts
    inside a member finds no valid candidate until the next record. One payload could mislead it: an archive that deflate kept
    as it is, inside a member that reaches over a border of splits. ``write_archives`` compresses, so its members hold none; for
    foreign archives of such payloads take splits as long as the files.
    Without ``payloads`` they are checked against their digest but not returned.
    """
    splits = manifest.where("bytes > 0").select(
        "path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split_bytes).cast("long"))).alias("start")
    )
    names = [x.split()[0] for x in RECORDS.split(", ")]
    schema = pa.schema([("path", pa.string()), ("offset", pa.int64()), *[(n, pa.string()) for n in names[2:6]], ("page_id", pa.int64()), ("refers_to_page", pa.int64()), ("content_type", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary()), ("intact", pa.bool_())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, size, start in zip(*(batch.column(c).to_pylist() for c in ("path", "bytes", "start"))):
                rows, held = [], 0
                for r in records_between(path, size, start, min(size, start + split_bytes)):
                    held += len(r["payload"] or b"") if payloads else 256
                    rows.append(r if payloads else r | {"payload": None})
                    if held >= 4 * CHUNK:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return splits.repartition(max(1, spark.sparkContext.defaultParallelism * 2)).mapInArrow(read, RECORDS)


def with_revisits(pages: DataFrame) -> DataFrame:
    """``pages(page_id, url, html)``, every row, with ``refers_to`` and ``nth``.

    ``refers_to``: for each page whose payload, of at least ``MIN_REVISIT_BYTES`` bytes, a page of smaller id has too, the smallest such
    id, else null. Rows without page_id, and of rows of one page_id that one of least payload digest which refers to none, are
    responses; rows that repeat a page_id and payload of their response refer to their own id. ``nth`` numbers the rows of
    one page_id. Digests, not pages, are grouped and joined; a hot payload is one row after map-side aggregation. Pages are
    shuffled only if there are too many revisits or repeated ids to broadcast.
    """
    payload = F.coalesce(F.col("html"), F.lit(""))
    pages = pages.select("page_id", "url", "html")
    marks = stored(pages.where("page_id is not null").select("page_id", F.sha2(payload.cast("binary"), 256).alias("digest"), F.octet_length(payload).cast("long").alias("n")), "warc-digests")
    by_payload = marks.groupBy("digest", "page_id").agg(F.max("n").alias("n"), F.count("*").alias("rows"))
    first = by_payload.where(F.col("n") >= MIN_REVISIT_BYTES).groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.sum("rows").alias("all")).where("all > 1").drop("all")
    refers = marks.select("page_id", "digest").distinct().join(first, "digest").where("page_id > refers_to").select(F.col("page_id").alias("__id"), F.col("digest").alias("__digest"), "refers_to")
    refers = small(stored(refers, "warc-refers"))
    repeated = small(stored(marks.groupBy("page_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("page_id").alias("__id")), "warc-repeated"))
    digest = F.sha2(payload.cast("binary"), 256)
    rows = pages.withColumn("digest", digest)
    once = rows.join(repeated, F.col("page_id") == F.col("__id"), "left_anti").withColumn("nth", F.lit(1)).withColumn("same", F.lit(1))
    again = rows.join(repeated, F.col("page_id") == F.col("__id"), "left_semi")
    again = again.withColumn("nth", F.row_number().over(Window.partitionBy("page_id").orderBy("digest", "url"))).withColumn("same", F.row_number().over(Window.partitionBy("page_id", "digest").orderBy("nth")))
    rows = once.unionByName(again)
    joined = rows.join(refers, (F.col("page_id") == F.col("__id")) & (F.col("digest") == F.col("__digest")), "left")
    long = F.octet_length(payload) >= MIN_REVISIT_BYTES
    return joined.select("page_id", "url", "html", F.coalesce("refers_to", F.when((F.col("same") > 1) & long, F.col("page_id"))).alias("refers_to"), "nth")


def round_trip(spark: SparkSession, pages: DataFrame, split_bytes: int = 8 << 20) -> DataFrame:
    """Write the pages as archives in the shared folder and read the archives back, without payloads."""
    folder = f"{shared_dir(spark)}/wrenchlake/warc-{uuid.uuid4().hex}"
    return read_archives(spark, write_archives(with_revisits(pages), folder), split_bytes, payloads=False)
