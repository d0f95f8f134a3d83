"""WARC archives: writing, normalising whole-file gzip, indexed reading.

* ``write_monolithic`` writes the pages of each partition as one WARC file that
  is a single gzip stream, as many crawlers' exports are.
* ``normalise`` inflates each such stream once, front to back, writes every
  record again as a gzip member of its own and a sidecar index beside it with
  the offset and length of each member. Memory holds one record at a time.
* ``read_records`` reads records through the index: each one is inflated alone.

Equal payloads of at least ``min_revisit`` bytes are stored once: the record
with the largest page id is the response, the others are ``revisit`` records
that name it. Payload digests are aggregated before the shuffle, so one payload
on a third of all pages is one row per task; the decision joins the pages by
page id, not by payload.

Files are put in place by renaming, under names that depend on the partition
alone, so retried tasks replace their own output.

Defined cases: NULL html is an empty payload; NULL urls leave the target URI
out and control characters or blanks in urls are percent-encoded; pages with a
NULL id are written and come back with a NULL id, always as responses; of
repeated rows with the largest page id each is a response; an empty table gives
an empty archive. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.llm import files
from tabloom.llm.common import register, scratch_path, stored, table

MIN_REVISIT = 1000
CHUNK = 1 << 18
#: Fixed values of the WARC 1.1 format.
VERSION_LINE = b"WARC/1.1"
REVISIT_PROFILE = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
WARC_DATE = b"2024-01-01T00:00:00Z"
#: One sidecar entry: offset and length of a member, little-endian.
ENTRY = "<QQ"


def _attempt() -> tuple[int, str]:
    from pyspark import TaskContext
    c = TaskContext.get()
    return c.partitionId(), f"{c.stageId()}-{c.taskAttemptId()}"


def _uri(url: str) -> bytes:
    return b"".join(b"%%%02X" % b if b <= 0x20 or b == 0x7F else bytes([b]) for b in url.encode("utf-8"))


def record_bytes(page_id, url, payload: bytes, refers_to) -> bytes:
    """One WARC record; revisits carry no payload but its digest and length."""
    digest = hashlib.sha1(payload).hexdigest().encode()
    name = b"none" if page_id is None else b"%d" % page_id
    head = [VERSION_LINE, b"WARC-Type: " + (b"response" if refers_to is None else b"revisit"),
            b"WARC-Record-ID: <urn:page:" + name + b">", b"WARC-Date: " + WARC_DATE,
            b"WARC-Payload-Digest: sha1:" + digest, b"X-Payload-Length: %d" % len(payload)]
    if url is not None:
        head.append(b"WARC-Target-URI: " + _uri(url))
    body = payload
    if refers_to is not None:
        head += [b"WARC-Profile: " + REVISIT_PROFILE, b"WARC-Refers-To: <urn:page:%d>" % refers_to]
        body = b""
    head += [b"Content-Type: text/html; charset=utf-8", b"Content-Length: %d" % len(body)]
    return b"\r\n".join(head) + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse_header(head: bytes) -> dict[bytes, bytes]:
    lines = head.split(b"\r\n")
    if not lines[0].startswith(b"WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in lines[1:] if x)}


def _page_number(urn: bytes | None) -> int | None:
    number = (urn or b"").strip(b"<>").rpartition(b":")[2]
    return int(number) if number.lstrip(b"-").isdigit() else None


def inflated(stream, chunk: int = CHUNK):
    """Inflate a gzip file piece by piece, over all its members."""
    d = zlib.decompressobj(31)
    while data := stream.read(chunk):
        while data:
            if d.eof:
                d = zlib.decompressobj(31)
            out = d.decompress(data, chunk)
            if out:
                yield out
            data = d.unconsumed_tail or (d.unused_data if d.eof else b"")
    if out := d.flush():
        yield out
    if not d.eof:
        raise ValueError("gzip stream ends early")


def split_records(parts):
    """Whole records of a WARC byte stream, one at a time."""
    held, need, header_end = bytearray(), None, 0
    for part in parts:
        held += part
        while True:
            if need is None:
                header_end = held.find(b"\r\n\r\n")
                if header_end < 0:
                    break
                need = header_end + 4 + int(parse_header(bytes(held[:header_end]))[b"content-length"]) + 4
            if len(held) < need:
                break
            yield bytes(held[:need])
            del held[:need]
            need = None
    if held:
        raise ValueError("WARC stream ends inside a record")


def decisions(pages: DataFrame, id_col: str, payload: str, min_revisit: int) -> DataFrame:
    """(page, digest, refers_to) of the pages that revisit another one."""
    b = _payload(payload)
    keyed = (pages.select(F.col(id_col).cast("long").alias("page"), b.alias("b"))
             .filter(F.octet_length("b") >= min_revisit).select("page", F.sha2("b", 256).alias("digest")))
    last = keyed.groupBy("digest").agg(F.max("page").alias("refers_to"), F.count("*").alias("n")).filter("n > 1")
    return (keyed.join(last, "digest").filter(F.col("page") != F.col("refers_to"))
            .select("page", "digest", "refers_to").distinct())


def _payload(column: str):
    return F.encode(F.coalesce(F.col(column), F.lit("")), "utf-8")


def write_monolithic(pages: DataFrame, path: str, id_col: str = "page_id", url: str = "url",
                     payload: str = "html", min_revisit: int = MIN_REVISIT) -> DataFrame:
    """Write one whole-file gzip stream per partition; returns (file, n_records)."""
    revisit = stored(decisions(pages, id_col, payload, min_revisit), "revisits")
    rows = (pages.select(F.col(id_col).cast("long").alias("id"), F.col(url).cast("string").alias("url"),
                         _payload(payload).alias("body"))
            .join(revisit, (F.col("id") == F.col("page")) & (F.sha2("body", 256) == F.col("digest")), "left")
            .select("id", "url", "body", "refers_to"))

    def write(batches):
        part, attempt = _attempt()
        name, n = f"{path}/part-{part:06d}.warc.gz", 0
        z = zlib.compressobj(6, zlib.DEFLATED, 31)
        with files.Replacing(name, attempt) as out:
            for batch in batches:
                for i, u, body, ref in zip(*(batch.column(k) for k in range(4))):
                    out.write(z.compress(record_bytes(i.as_py(), u.as_py(), body.as_py(), ref.as_py())))
                    n += 1
            out.write(z.flush())
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64())], names=["file", "n_records"])
        else:
            files.delete(name)

    return stored(rows.mapInArrow(write, "file string, n_records long"), "warc-parts")


def normalise(archives: DataFrame, path: str, drop_input: bool = False) -> DataFrame:
    """Rewrite each file of ``archives`` (column ``file``) with a gzip member per
    record and a sidecar ``.idx``; returns (file, index, n_records)."""
    def rewrite(batches):
        for batch in batches:
            for source in batch.column(0).to_pylist():
                name = f"{path}/{source.rpartition('/')[2]}"
                attempt = _attempt()[1]
                offset, n = 0, 0
                with open_both(name, attempt) as (out, idx), files.open_input(source) as stream:
                    for record in split_records(inflated(stream)):
                        z = zlib.compressobj(6, zlib.DEFLATED, 31)
                        member = z.compress(record) + z.flush()
                        out.write(member)
                        idx.write(struct.pack(ENTRY, offset, len(member)))
                        offset, n = offset + len(member), n + 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array([source]), pa.array([name]), pa.array([f"{name}.idx"]), pa.array([n], pa.int64())],
                    names=["source", "file", "index", "n_records"])

    out = stored(_one_per_task(archives.select("file"), "file").mapInArrow(
        rewrite, "source string, file string, index string, n_records long"), "warc-files")
    if drop_input:
        out.select("source").foreachPartition(lambda rows: [files.delete(r.source) for r in rows])
    return out.drop("source")


class open_both:  # noqa: N801 - a context manager used like open()
    """The archive and its index, put in place together."""

    def __init__(self, name: str, attempt: str):
        self.archive, self.index = files.Replacing(name, attempt), files.Replacing(f"{name}.idx", attempt)

    def __enter__(self):
        return self.archive.__enter__(), self.index.__enter__()

    def __exit__(self, *error):
        self.index.__exit__(*error)
        self.archive.__exit__(*error)


def _one_per_task(df: DataFrame, column: str) -> DataFrame:
    """Deal out a list of files evenly, whatever their names hash to."""
    n = max(1, df.count())
    return df.repartitionByRange(min(n, 4096), column)


RECORD_SCHEMA = "page_id long, record_type string, url string, payload_bytes long, payload_digest string, refers_to long"


def read_records(archives: DataFrame, with_payload: bool = False) -> DataFrame:
    """Records of normalised archives (columns ``file, index``), read member by
    member at the offsets of the index. Payload digest and length of responses
    are computed from the payload itself, those of revisits are the recorded ones."""
    def read(batches):
        for batch in batches:
            for name, index in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with files.open_input(index) as f:
                    entries = f.read()
                with files.open_input(name) as f:
                    at = 0
                    rows = []
                    for offset, length in struct.iter_unpack(ENTRY, entries):
                        if offset != at:
                            f.seek(offset)
                        record = zlib.decompress(f.read(length), 31)
                        at = offset + length
                        rows.append(_parsed(record, with_payload))
                        if len(rows) == 500:
                            yield _batch(rows, with_payload)
                            rows = []
                    if rows:
                        yield _batch(rows, with_payload)

    schema = RECORD_SCHEMA + (", payload binary" if with_payload else "")
    return _one_per_task(archives.select("file", "index"), "file").mapInArrow(read, schema)


def _parsed(record: bytes, with_payload: bool) -> tuple:
    end = record.index(b"\r\n\r\n")
    h = parse_header(record[:end])
    kind = h[b"warc-type"].decode()
    body = record[end + 4:end + 4 + int(h[b"content-length"])]
    if kind == "response":
        size, digest = len(body), hashlib.sha1(body).hexdigest()
        if h[b"warc-payload-digest"] != b"sha1:" + digest.encode():
            raise ValueError(f"payload of {h[b'warc-record-id'].decode()} does not match its digest")
    else:
        size, digest = int(h[b"x-payload-length"]), h[b"warc-payload-digest"].partition(b":")[2].decode()
    url = h[b"warc-target-uri"].decode("utf-8") if b"warc-target-uri" in h else None
    row = (_page_number(h[b"warc-record-id"]), kind, url, size, digest, _page_number(h.get(b"warc-refers-to")))
    return (*row, body) if with_payload else row


def _batch(rows: list[tuple], with_payload: bool) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
    names = ["page_id", "record_type", "url", "payload_bytes", "payload_digest", "refers_to", "payload"]
    n = 7 if with_payload else 6
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds[:n])], names=names[:n])


def archive(pages: DataFrame, path: str, **options) -> DataFrame:
    """Write ``pages`` to normalised archives below ``path``; (file, index, n_records)."""
    raw = write_monolithic(pages, f"{path}/raw", **options)
    return normalise(raw, f"{path}/warc", drop_input=True)


SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha1(b) AS payload_digest, sha256(b) AS k FROM p),
m AS (SELECT k, max(page_id) AS last FROM d WHERE payload_bytes >= 1000 GROUP BY k)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN last IS NULL OR last = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN last = page_id THEN NULL ELSE last END AS refers_to
FROM d LEFT JOIN m USING (k)
"""


@register("op3_warc", SQL)
def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    files_written = archive(table(spark, sf_dir, "pages"), scratch_path(spark, "warc"))
    return read_records(files_written).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
