import gzip
import hashlib
import io

import pytest

from tabloom.llm.common import scratch_path
from tabloom.llm.warc import archive, inflated, normalise, read_records, split_records, write_monolithic

BIG = "<p>é" + "x" * 1200


def brute(rows):
    last = {}
    for i, _, h in rows:
        b = (h or "").encode()
        if i is not None and len(b) >= 1000:
            last[b] = max(last.get(b, i), i)
    out = []
    for i, u, h in rows:
        b = (h or "").encode()
        ref = last.get(b) if i is not None and last.get(b) != i else None
        out.append((i, "response" if ref is None else "revisit", len(b), hashlib.sha1(b).hexdigest(), ref))
    return sorted(out, key=str)


ROWS = [(k, f"http://h/{k}", BIG) for k in range(40)] + [
    (100, None, "short"), (101, "http://a b/\r\nX: y", "short"), (102, "ü", None), (103, "u", ""), (None, "n", BIG),
    (104, "u", "z" * 999), (105, "u", "z" * 999), (106, "u", "y" * 1000), (106, "u", "y" * 1000), (107, "u", "y" * 1000),
    (107, "u", BIG + "other"), (108, "u", "WARC/1.1\r\n\r\n" * 200), (109, "u", "q" * 3_000_000), (110, "u", "q" * 3_000_000)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as digest", "2 as page", "3 as k")


def test_round_trip(spark):
    files = archive(frame(spark, ROWS).repartition(3), scratch_path(spark, "w"))
    got = read_records(files, with_payload=True).collect()
    assert sorted([(r.page_id, r.record_type, r.payload_bytes, r.payload_digest, r.refers_to) for r in got], key=str) == brute(ROWS)
    for r in got:
        if r.record_type == "response":
            assert hashlib.sha1(bytes(r.payload)).hexdigest() == r.payload_digest
        else:
            assert bytes(r.payload) == b""
    urls = {r.page_id: r.url for r in got}
    assert urls[100] is None and urls[101] == "http://a%20b/%0D%0AX:%20y" and urls[102] == "ü"


def test_normaliser_keeps_records_and_writes_one_member_each(spark):
    path = scratch_path(spark, "w")
    raw = write_monolithic(frame(spark, ROWS).repartition(2), f"{path}/raw").collect()
    done = normalise(spark.createDataFrame(raw), f"{path}/out").collect()
    assert sum(r.n_records for r in raw) == sum(r.n_records for r in done) == len(ROWS)
    strip = lambda u: u.removeprefix("file:")
    for r in raw:
        with open(strip(r.file), "rb") as f:
            stream = f.read()
        assert len(_members(stream)) == 1
    whole = sorted(gzip.decompress(open(strip(r.file), "rb").read()) for r in raw)
    again = sorted(gzip.decompress(open(strip(r.file), "rb").read()) for r in done)
    assert whole == again
    for r in done:
        assert len(_members(open(strip(r.file), "rb").read())) == r.n_records


def _members(data):
    import zlib
    out = []
    while data:
        d = zlib.decompressobj(31)
        out.append(d.decompress(data))
        data = d.unused_data
    return out


def test_stream_split_at_any_byte():
    rec = b"WARC/1.1\r\nContent-Length: 5\r\n\r\nab\r\nc\r\n\r\n"
    data = rec * 3
    for size in (1, 2, 3, 7, 1000):
        assert list(split_records(data[k:k + size] for k in range(0, len(data), size))) == [rec] * 3
    with pytest.raises(ValueError):
        list(split_records([data[:-1]]))
    z = gzip.compress(data) + gzip.compress(rec)
    assert b"".join(inflated(io.BytesIO(z), 5)) == data + rec
    with pytest.raises(ValueError):
        list(inflated(io.BytesIO(z[:-9]), 5))


def test_empty_table(spark):
    files = archive(frame(spark, []), scratch_path(spark, "w"))
    assert read_records(files).count() == 0
