import base64
import gzip
import hashlib
import io

import pytest

from ledgerline.llm import warc

SCHEMA = "page_id long, url string, html string, body string, refers_to int, sha1 string"


def pages(spark, rows):
    return spark.createDataFrame([(*row, "b", 1, "s") for row in rows], SCHEMA).repartition(3)


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


ROWS = [
    (5, "http://a/", "same"), (3, "http://b/", "same"), (9, None, "same"), (1, "http://c/\r\nX: y", "é漢" * 400_000), (2, "http://d/", None), (4, "http://e/", ""),
    (7, "http://f/", "\r\n\r\nWARC/1.1\r\n"), (8, "http://g/", "single"), (8, "http://g/", "single"), (None, "http://h/", "same"), (None, "http://i/", "alone"), (6, "http://j/", "HTTP/1.1 200 OK\r\nContent-Length: 1\r\n\r\n"),
]


def expected(rows, least=0):
    out = []
    for page, _, html in rows:
        payload = (html or "").encode()
        first = min((p for p, _, h in rows if p is not None and (h or "").encode() == payload), default=None)
        revisit = first is not None and page != first and len(payload) >= least
        out.append((page, len(payload), digest(html), "revisit" if revisit else "response", first if revisit else None, True))
    return sorted(out, key=repr)


@pytest.mark.parametrize("least", [0, 5])
def test_pages_come_back(spark, least):
    found = warc.through_archives(pages(spark, ROWS), least_bytes=least, with_payload=True).collect()
    columns = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "verified")
    assert sorted((tuple(r[c] for c in columns) for r in found), key=repr) == expected(ROWS, least)
    payloads = {(r["page_id"], bytes(r["payload"])) for r in found if r["record_type"] == "response"}
    assert (1, ("é漢" * 400_000).encode()) in payloads
    assert {r["url"] for r in found if r["page_id"] == 1} == {"http://c/%0D%0AX: y"}


def test_no_pages(spark):
    assert warc.through_archives(spark.createDataFrame([], SCHEMA)).count() == 0


def archive():
    return warc.info_record("2024-01-01T00:00:00Z") + b"".join(warc.page_record(i, None, b"payload" * i * 9000, None, "2024-01-01T00:00:00Z") for i in range(4))


def test_each_record_is_a_gzip_member():
    assert gzip.decompress(archive()).count(b"WARC/1.1\r\n") == 5
    read = list(warc.read_records(io.BytesIO(archive()).read, keep_payload=True))
    assert [r["payload_bytes"] for r in read[1:]] == [63000 * i for i in range(4)] and all(r["verified"] for r in read)


@pytest.mark.parametrize("step", [1, 7, 1000])
def test_any_size_of_reads_will_do(step):
    stream = io.BytesIO(archive())
    assert len(list(warc.read_records(lambda n: stream.read(min(n, step))))) == 5


def test_damage_is_noticed():
    with pytest.raises(ValueError):
        list(warc.read_records(io.BytesIO(archive()[:-20]).read))
    whole = gzip.decompress(warc.page_record(1, None, b"payload", None, "d"))
    changed = gzip.compress(whole.replace(b"payload\r\n", b"paYload\r\n"))
    assert [r["verified"] for r in warc.read_records(io.BytesIO(changed).read)] == [False]
    for longer in (whole[:-4] + b"x\r\n\r\n", whole[:-5]):
        with pytest.raises(ValueError):
            list(warc.read_records(io.BytesIO(gzip.compress(longer)).read))
    with pytest.raises(ValueError):
        list(warc.read_records(io.BytesIO(gzip.compress(b"no record\r\n\r\n")).read))


def test_files_are_rolled(spark, tmp_path):
    marked = warc.mark_revisits(pages(spark, [(i, None, f"{i}" * 3000) for i in range(40)]))
    files = warc.write_archives(marked.coalesce(1), f"file://{tmp_path}/out", file_bytes=500)
    assert files.count() > 5 and files.agg({"n_records": "sum"}).first()[0] == 40
    assert warc.read_archives(files).count() == 40
