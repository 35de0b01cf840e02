import gzip
import hashlib
import re
from pathlib import Path

import pytest

from quarry.llm import warc

PAGES = "page_id long, url string, html string, digest string, __sha string"


def pages():
    long = lambda c, n=1000: c * n
    out = [(k, f"http://a/{k}", long("x")) for k in range(60)] + [(100 + k, f"http://b/{k}", f"page {k} " + long("é", 700)) for k in range(20)]
    out += [(200, "u", long("y", 999)), (201, "u", long("y", 999)), (202, None, None), (203, "u\r\nX: y", ""), (204, "é", "tail\r\n\r\n")]
    out += [(300, "same", long("z")), (300, "same", long("z")), (300, "same", long("z")), (299, "same", long("z")), (None, "n", long("w")), (None, "n", long("w")), (None, None, long("v")), (301, "o", long("v"))]
    inner = "WARC/1.1\r\nWARC-Warcinfo-ID: <urn:uuid:1>\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    return [*out, (400, "w", inner * 20 + "WARC/1.1\r\n"), (401, "w", inner * 20 + "WARC/1.1\r\n"), (402, "w", "\r\n\r\n" + inner), (403, "w", "a\n" * 700_000 + "\r\n")]


def brute(rows):
    out, by = [], {}
    for i, url, html in rows:
        data = (html or "").encode()
        by.setdefault(data, []).append((-1 if i is None else i, url or ""))
    for data, ids in by.items():
        digest, top = hashlib.sha1(data).hexdigest(), max(ids)
        ids = sorted(ids, reverse=True)
        for k, (i, _) in enumerate(ids):
            again = len(data) >= 1000 and k > 0
            out.append((None if i < 0 else i, len(data), digest, "revisit" if again else "response", (None if top[0] < 0 else top[0]) if again else None))
    return out


def key(r):
    return tuple((x is None, x or 0) if not isinstance(x, str) else x for x in (r[0], r[1], r[2], r[3], r[4]))


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(*r, "d", "x") for r in pages()], PAGES).repartition(5)


@pytest.mark.parametrize("few", [warc.FEW_GROUPS, 0])
def test_written_and_read_back(spark, rows, tmp_path, monkeypatch, few):
    monkeypatch.setattr(warc, "FEW_GROUPS", few)
    monkeypatch.setattr(warc, "FILE_RECORDS", 7)
    folder = f"file://{tmp_path}/archive"
    warc.write_archives(rows, folder)
    records = warc.read_archives(spark, folder)
    got = warc.resolve(records).select("page_id", "payload_bytes", "payload_digest", "type", "refers_to").collect()
    assert sorted(map(tuple, got), key=key) == sorted(brute(pages()), key=key)
    held = {(r["page_id"], r["payload"].decode()) for r in records.filter("type = 'response'").collect()}
    assert held <= {(i, t or "") for i, _, t in pages()} and len({r["id"] for r in records.collect()}) == len(pages())


def test_files_are_archives(spark, rows, tmp_path):
    """Every file, read by lengths alone, is a run of whole records; revisits hold no payload."""
    warc.write_archives(rows, f"file://{tmp_path}/archive")
    kinds, bodies = {}, 0
    for path in Path(f"{tmp_path}/archive").glob("part-*"):
        data = gzip.open(path).read()
        while data:
            head, _, rest = data.partition(b"\r\n\r\n")
            fields = dict(re.findall(r"(?m)^([\w-]+): (.*?)\r?$", head.decode()))
            assert head.startswith(b"WARC/1.1\r\n") and rest[int(fields["Content-Length"]) :][:4] == b"\r\n\r\n"
            block, data = rest[: int(fields["Content-Length"])], rest[int(fields["Content-Length"]) + 4 :]
            kinds[fields["WARC-Type"]] = kinds.get(fields["WARC-Type"], 0) + 1
            if fields["WARC-Type"] == "revisit":
                assert block.endswith(b"\r\n\r\n") and fields["WARC-Profile"] == warc.PROFILE
            elif fields["WARC-Type"] == "response":
                body = block.partition(b"\r\n\r\n")[2]
                assert fields["WARC-Payload-Digest"] == "sha1:" + hashlib.sha1(body).hexdigest()
                bodies += len(body)
    want = brute(pages())
    assert kinds == {"warcinfo": 1, "response": sum(r[3] == "response" for r in want), "revisit": sum(r[3] == "revisit" for r in want)}
    assert bodies == sum(r[1] for r in want if r[3] == "response")


def test_lost_originals_and_empty_tables(spark, rows, tmp_path):
    records = spark.createDataFrame([("a", "response", 1, "u", None, hashlib.sha1(b"x").hexdigest(), 1, b"x"), ("b", "revisit", 2, "u", "gone", "d", 1, None), ("c", "revisit", 3, "u", "a", hashlib.sha1(b"x").hexdigest(), 1, None), ("e", "revisit", 4, "u", None, "d", 1, None)], "id string, type string, page_id long, url string, original string, stated_digest string, stated_bytes long, payload binary")
    got = {r["page_id"]: tuple(r)[2:] for r in warc.resolve(records).collect()}
    assert got == {1: (1, hashlib.sha1(b"x").hexdigest(), None), 2: (None, None, None), 3: (1, hashlib.sha1(b"x").hexdigest(), 1), 4: (None, None, None)}
    none = rows.limit(0)
    warc.write_archives(none, f"file://{tmp_path}/none")
    assert warc.resolve(warc.read_archives(spark, f"file://{tmp_path}/none")).count() == 0
