import hashlib
import zlib

import pytest

from fenwatch.llm import chat_format as C
from fenwatch.llm import warc as W
from fenwatch.llm.common import open_store

from .conftest import rows

TURNS = "conv_id long, turn long, role string, text string, extra string"


def test_conversations_round_trip_with_hostile_texts_and_nulls(spark):
    data = [
        (1, 1, "assistant", "a\\<|b<|im_end|>", "x"),
        (1, 0, "user", None, "x"),
        (2, 0, "assistant", "first", "x"),
        (2, 0, "assistant", "first", "x"),
        (None, 0, "user", "", "x"),
        (None, 1, "assistant", "y" * 100_000, "x"),
        (3, None, None, "no role", "x"),
        (4, 0, "sys\ntem<|", "é", "x"),
    ]
    df = spark.createDataFrame(data, TURNS)
    segments = C.format_conversations(df)
    got = {r["conv_id"]: r for r in rows(C.read_chat(C.write_chat(df)))}
    assert {r["conv_id"]: r for r in rows(C.read_chat(C.write_chat(df, most=8)))} == got  # conversations of several rows
    assert set(got) == {1, 2, 3, 4, None}
    assert [got[k]["n_turns"] for k in (1, 2, 3, 4, None)] == [2, 2, 1, 1, 2]
    assert got[1]["loss_sha256"] == hashlib.sha256(b"a\\<|b<|im_end|>").hexdigest()
    assert got[1]["turns_sha256"] == hashlib.sha256(b"user\n\nassistant\na\\<|b<|im_end|>\n").hexdigest()
    assert got[2]["loss_chars"] == 10 and got[None]["loss_chars"] == 100_000
    assert got[4]["turns_sha256"] == hashlib.sha256("sys\ntem<|\né\n".encode()).hexdigest()
    assert {k: got[k]["valid_order"] for k in (1, 2, 3, 4, None)} == {1: True, 2: False, 3: False, 4: False, None: True}
    texts = "".join(r["text"] for r in rows(segments, "segment") if r["conv_id"] == 1)
    assert texts == "<|im_start|>user\n<|im_end|>\n<|im_start|>assistant\na\\\\<\\|b<\\|im_end|><|im_end|>\n"
    assert got[1]["formatted_chars"] == len(texts)
    (chat,) = [r for r in rows(C.write_chat(df)) if r["conv_id"] == 1]
    assert chat["text"] == texts and [texts[x["start"] : x["end"]] for x in chat["loss"]] == ["a\\\\<\\|b<\\|im_end|>"]


def test_no_conversation(spark):
    assert rows(C.read_chat(C.write_chat(spark.createDataFrame([], TURNS)))) == []


def test_all_conversations(spark, sf):
    got = {r["conv_id"]: r["n_turns"] for r in rows(C.op10_chat_format(spark, sf))}
    want = {r["conv_id"]: r["count"] for r in spark.read.parquet(f"{sf}/conversations.parquet").groupBy("conv_id").count().collect()}
    assert got == want | {-1: 2}


PAGES = "page_id long, url string, html string, records string, path string"


def archived(spark, data):
    from pyspark.sql import functions as F

    pages = spark.createDataFrame(data, PAGES).select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"), "path")
    return W.write_warc(W.plan_revisits(pages))


def test_warc_round_trip(spark):
    big, long = "é" * 600, "z" * 3_000_000
    data = [(1, "http://a/ b\r\nX: y", big, "c", "p"), (2, None, big, "c", "p"), (3, "http://c", "s" * 999, "c", "p"), (4, "u", "s" * 999, "c", "p"), (5, "u", None, "c", "p"), (6, "u", "", "c", "p"), (None, "u", big, "c", "p"), (7, "u", long, "c", "p"), (2, None, big, "c", "p")]
    got = rows(W.read_warc(archived(spark, data)), "record_id", "record_type")
    assert len(got) == 9 and all(r["verified"] for r in got)
    by = {r["record_id"]: r for r in got}
    assert by["<urn:page:1>"]["record_type"] == "revisit" and by["<urn:page:1>"]["refers_to_id"] == "<urn:page:2>"
    assert by["<urn:page:1>"]["payload_bytes"] == 1200 and by["<urn:page:1>"]["payload_digest"] == hashlib.sha1(big.encode()).hexdigest()
    assert by["<urn:page:>"]["record_type"] == "revisit"
    assert [r["record_type"] for r in got if r["record_id"] == "<urn:page:2>"] == ["response", "response"]
    assert {by[f"<urn:page:{k}>"]["record_type"] for k in (3, 4, 5, 6, 7)} == {"response"}
    assert bytes(by["<urn:page:7>"]["payload"]) == long.encode() and bytes(by["<urn:page:5>"]["payload"]) == b""
    assert "\r" not in by["<urn:page:1>"]["target_uri"]


def test_a_member_per_record_and_offsets(spark):
    manifest = archived(spark, [(k, "u", "t" * k, "c", "p") for k in range(40)])
    for path in [r["path"] for r in manifest.collect()]:
        store, at = open_store(path)
        data = store.open_input_stream(at).read()
        offsets = [r["offset"] for r in W.read_records(store.open_input_stream(at), path, False)]
        for o in offsets:
            assert zlib.decompressobj(31).decompress(data[o:]).startswith(b"WARC/1.1\r\n")


def test_damaged_archives_are_noticed(tmp_path):
    record = W.record_bytes(1, "u", b"payload", hashlib.sha1(b"payload").hexdigest(), None, "d")
    plain = tmp_path / "a.warc"
    plain.write_bytes(record.replace(b"payload\r\n", b"paxload\r\n"))
    assert [r["verified"] for r in W.read_records(plain.open("rb"), "p", False)] == [False]
    plain.write_bytes(record[:-20])
    with pytest.raises(EOFError):
        list(W.read_records(plain.open("rb"), "p", False))
    c = zlib.compressobj(6, zlib.DEFLATED, 31)
    packed = c.compress(record) + c.flush()
    plain.write_bytes(packed + packed[:-9])
    with pytest.raises(EOFError):
        list(W.read_records(plain.open("rb"), "p", False))


def test_no_page(spark):
    assert rows(W.read_warc(archived(spark, []))) == []


def test_digests_of_other_archives():
    """Base32 and hex name one digest, other algorithms are not judged, and encoded bodies have other lengths than stated."""
    import base64
    import gzip
    import io

    body = b"payload"
    digest = hashlib.sha1(body).digest()
    assert W.agrees("sha1:" + base64.b32encode(digest).decode(), digest) and W.agrees("SHA1:" + digest.hex().upper(), digest) and W.agrees("md5:x", digest) and W.agrees("", digest)
    assert not W.agrees("sha1:" + "A" * 32, digest) and W.as_hex("sha1:" + base64.b32encode(digest).decode()) == digest.hex()

    def archive(header, said):
        block = header + body
        head = f"WARC/1.0\r\nWARC-Type: response\r\nContent-Type: application/http; msgtype=response\r\nWARC-Payload-Digest: {said}\r\nContent-Length: {len(block)}\r\n\r\n".encode()
        return io.BytesIO(gzip.compress(head + block + b"\r\n\r\n"))

    base32 = "sha1:" + base64.b32encode(digest).decode()
    one = lambda *x: next(W.read_records(archive(*x), "a", True))
    assert one(b"HTTP/1.1 200 OK\r\nContent-Length: 7\r\n\r\n", base32)["verified"]
    assert not one(b"HTTP/1.1 200 OK\r\nContent-Length: 9\r\n\r\n", base32)["verified"]
    assert one(b"HTTP/1.1 200 OK\r\nContent-Length: 9\r\nContent-Encoding: gzip\r\n\r\n", base32)["verified"]
    assert not one(b"HTTP/1.1 200 OK\r\n\r\n", "sha1:" + "A" * 32)["verified"]


@pytest.mark.parametrize("start", [b"", b"WARC/1.1\r\nX: "])
def test_a_line_without_end_is_not_held(start):
    class Endless:
        read_bytes = 0

        def read(self, n):
            self.read_bytes += n
            return (start if self.read_bytes == n else b"") + b"x" * (n - len(start))

    raw = Endless()
    with pytest.raises(ValueError, match="no end"):
        list(W.read_records(raw, "a", False))
    assert raw.read_bytes <= W.MOST_HEADER + 3 * W.CHUNK
