"""Archives: records read back, rebuilt byte for byte, kinds as a plain pass over the rows gives them."""

import hashlib

import pytest

from faintline.llm import warc

SCHEMA = "page_id long, url string, html string, id string, digest string"
LONG = "<p>é" + "x" * 200
ROWS = [(5, "http://a/5", LONG, "i", "d"), (2, "http://a/2", LONG, None, None), (9, None, None, "", ""), (7, "http://a/\r\nX: y", "short", "", ""), (8, "u", "short", "", ""), (2, "http://a/2", LONG, "z", "z"), (11, "u", "y" * 100_000, "", ""), (12, "u", "y" * 100_000, "", "")]


def expected(rows):
    first = {}
    for i, _, h, *_ in rows:
        raw = (h or "").encode()
        if len(raw) >= 100:
            first[raw] = min(i, first.get(raw, i))
    return sorted((str(i), len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if first.get(raw, i) != i else "response", str(first[raw]) if first.get(raw, i) != i else None) for i, _, h, *_ in rows for raw in [(h or "").encode()])


def test_round_trip(spark, tmp_path):
    path = str(tmp_path / "a")
    warc.write(spark.createDataFrame(ROWS, SCHEMA), path)
    got = sorted((r.id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read(spark, path).collect())
    assert got == expected(ROWS)
    assert spark.read.parquet(path + "/payloads").count() == 4
    for r in warc.records(spark, path).collect():
        record = bytes(r.record)
        head, _, rest = record.partition(b"\r\n\r\n")
        fields = dict(x.split(b": ", 1) for x in head.split(b"\r\n")[1:])
        assert head.startswith(b"WARC/1.1\r\n") and rest.endswith(b"\r\n\r\n")
        block = rest[: int(fields[b"Content-Length"])]
        assert rest == block + b"\r\n\r\n"
        payload = block.partition(b"\r\n\r\n")[2]
        if fields[b"WARC-Type"] == b"response":
            assert hashlib.sha256(payload).hexdigest().encode() == fields[b"WARC-Payload-Digest"][7:]
        else:
            assert payload == b""


def test_addresses_that_look_like_headers(spark, tmp_path):
    odd = ["u\u2028X-Source-ID: 999", "u\u0085X-Source-ID: 998\u2029WARC-Type: revisit", "u\r\nX-Source-ID: 997", "u\x0bContent-Length: 1", "Content-Length: 2"]
    rows = [(i, u, f"Content-Length: 5\r\n\r\nX-Source-ID: {i}" + "z" * 50 * i, "", "") for i, u in enumerate(odd)]
    warc.write(spark.createDataFrame(rows, SCHEMA), str(tmp_path / "o"))
    got = {r.id: r for r in warc.read(spark, str(tmp_path / "o")).collect()}
    assert {i: (r.payload_bytes, r.record_type, r.url) for i, r in got.items()} == {str(i): (len(h), "response", u.replace("\r", "%0D").replace("\n", "%0A")) for i, u, h, *_ in rows}


def test_damage_is_found(spark, tmp_path):
    path = str(tmp_path / "a")
    warc.write(spark.createDataFrame(ROWS, SCHEMA), path)
    stored = spark.read.parquet(path + "/payloads").collect()
    spark.createDataFrame([(r.digest, bytes(r.payload) + b"!") for r in stored], "digest string, payload binary").write.mode("overwrite").parquet(path + "/payloads")
    with pytest.raises(Exception, match="differs"):
        warc.read(spark, path).collect()


def test_empty_and_null_ids(spark, tmp_path):
    warc.write(spark.createDataFrame([], SCHEMA), str(tmp_path / "e"))
    assert warc.read(spark, str(tmp_path / "e")).collect() == []
    warc.write(spark.createDataFrame([(None, "u", LONG, "", ""), (3, "u", LONG, "", "")], SCHEMA), str(tmp_path / "n"))
    assert {(r.id, r.record_type, r.refers_to) for r in warc.read(spark, str(tmp_path / "n")).collect()} == {(None, "revisit", "3"), ("3", "response", None)}
