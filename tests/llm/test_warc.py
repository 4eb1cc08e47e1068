import base64
import hashlib
import struct

import pytest
import zstandard

from priceloom.llm import warc as W
from tests.llm.docs import LONG

ROWS = [(5, "http://a/5", "<p>same</p>"), (3, "http://a/3", "<p>same</p>"), (9, None, "<p>same</p>"), (1, "http://a/1\r\nX: y", None), (2, "u", ""), (4, "u", "é ß 日本\r\n\r\nWARC/1.1"), (7, "u", LONG), (7, "u", LONG), (8, "u", "only")]


def pages(spark, rows=ROWS):
    return spark.createDataFrame([(*r, "clash") for r in rows], "page_id bigint, url string, html string, payload string").repartition(3)


def want(rows):
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    out = []
    for i, _, h in rows:
        p = (h or "").encode()
        f = first.get(h or "")
        back = f is not None and f != i
        out.append((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "revisit" if back else "response", f if back else None))
    return sorted(out, key=str)


def got(df):
    num = lambda s: int(s.removeprefix(W.URN)) if s and s != W.URN else None
    return sorted(((num(r.record_id), r.payload_bytes, r.payload_digest, r.record_type, num(r.refers_to)) for r in df.collect()), key=str)


@pytest.mark.parametrize("size", [W.ARCHIVE_BYTES, 10])
def test_round_trip(spark, size):
    rows = [*ROWS, (None, "u", "<p>same</p>"), (None, "u", "nobody else")]
    assert got(W.round_trip(pages(spark, rows), archive_bytes=size)) == want(rows)


def test_payloads_come_back(spark, tmp_path):
    W.write_archives(pages(spark), f"file://{tmp_path}/w").count()
    back = W.read_archives(spark, f"file://{tmp_path}/w/*.zst").where("record_type = 'response'").collect()
    assert {r.record_id: bytes(r.payload) for r in back} == {f"{W.URN}{i}": (h or "").encode() for i, _, h in ROWS if i not in (5, 9, 2)}
    assert not any("\n" in (r.target_uri or "") for r in back)


def test_faults_are_found(spark, tmp_path):
    good = W.record(1, "u", b"body", None, False)
    faults = {"Content-Length does": good + b"x", "no WARC": b"GARC" + good[4:], "digest": good.replace(b"body", b"bodx"), "missing warc-date": good.replace(b"WARC-Date", b"WARC-Dote"), "HTTP Content": good.replace(b"Length: 4", b"Length: 5")}
    z = zstandard.ZstdCompressor()
    (tmp_path / "bad.warc.zst").write_bytes(struct.pack("<II", 0x184D2A51, 3) + b"abc" + b"".join(z.compress(x) for x in [good, *faults.values()]) + b"\x28\xb5\x2f\xfd\x00\x58")
    rows = sorted(W.read_archives(spark, f"file://{tmp_path}/bad.warc.zst", strict=False).collect(), key=lambda r: r.offset)
    assert rows[0].error is None and bytes(rows[0].payload) == b"body" and "cut short" in rows[-1].error
    assert all(k in r.error for k, r in zip(faults, rows[1:]))
    with pytest.raises(Exception, match="Content-Length does"):
        W.read_archives(spark, f"file://{tmp_path}/bad.warc.zst").collect()


def test_compressed_dictionary_and_empty_table(spark, tmp_path):
    d = W.dictionary([b"some sample text of a page " * 3 + str(i).encode() for i in range(400)])
    held = zstandard.ZstdCompressor().compress(d)
    frame = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d)).compress(W.record(1, "u", b"some sample text of a page", None, False))
    (tmp_path / "d.warc.zst").write_bytes(struct.pack("<II", W.DICTIONARY_MAGIC, len(held)) + held + frame)
    assert bytes(W.read_archives(spark, f"file://{tmp_path}/d.warc.zst").first().payload) == b"some sample text of a page"
    assert W.round_trip(pages(spark).limit(0)).count() == 0
