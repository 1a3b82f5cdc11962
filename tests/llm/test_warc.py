import base64
import glob
import gzip
import hashlib
import random

from pyspark.sql import functions as F

from ostinato.llm import warc
from ostinato.session import fresh_path

SCHEMA = "page_id long, url string, html string"


def brute(rows, least=0):
    """Result rows by a plain pass over the pages of each payload."""
    groups, out = {}, []
    for i, url, html in rows:
        data = (html or "").encode()
        groups.setdefault(data, []).append((i is not None, i or 0, url or f"urn:page:{'' if i is None else i}"))
    for data, pages in groups.items():
        pages.sort(reverse=True)
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        for k, (known, i, _) in enumerate(pages):
            again = k > 0 and len(data) >= least
            top = pages[0][1] if pages[0][0] else None
            out.append((i if known else None, len(data), digest, "revisit" if again else "response", top if again else None))
    return sorted(map(repr, out))


def written(spark, rows, **kw):
    path = fresh_path(spark, "warc")
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for name in ("page", "uri", "payload", "digest", "bytes", "same", "o_page", "value"):
        df = df.withColumn(name, F.lit("other"))
    warc.write(df, path, **kw)
    return path


def check(spark, rows, **kw):
    path = written(spark, rows, **kw)
    records = warc.read(spark, path)
    assert sorted(repr(tuple(r)) for r in warc.resolved(records).collect()) == brute(rows, kw.get("least", 0))
    return path, records.collect()


def test_copies_and_odd_rows(spark):
    rnd = random.Random(4)
    pool = ["", None, "a", "ü\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nabc", "\r\n", "\r\n\r\n", "x\r\n\r", "\n\r\n\r\n\r", "y" * 200_000 + "\r\n\r\n" + "z" * 70_000]
    rows = [(rnd.choice([None, *range(30)]), rnd.choice([None, "http://a/", "http://b/\r\nX: y"]), rnd.choice(pool)) for _ in range(120)]
    _, records = check(spark, rows)
    originals = {r.record_id: r for r in records if r.record_type == "response"}
    assert len(originals) == len({h or "" for _, _, h in rows}) and all(r.refers_to_id in originals for r in records if r.record_type == "revisit")
    assert {bytes(r.payload) for r in originals.values()} == {(h or "").encode() for _, _, h in rows}
    assert len({r.record_id for r in records}) == len(rows)


def test_repeated_rows_and_threshold(spark):
    rows = [(1, "u", "same")] * 40 + [(1, "t", "same"), (0, "u", "same")] + [(2, "u", "ab")] * 3
    check(spark, rows)
    check(spark, rows, least=3)
    check(spark, rows, least=100)


def test_many_copies_of_one_row(spark, monkeypatch):
    monkeypatch.setattr(warc, "SPREAD", 8)
    check(spark, [(7, None, "hot")] * 300 + [(3, None, "hot"), (8, None, "cold")])


def test_archives_are_plain_warc(spark):
    path = written(spark, [(i, f"http://a/{i}", f"text {i % 3}\r\n\r\n") for i in range(20)], records_per_file=4, date="2020-01-01T00:00:00Z")
    found = []
    for name in glob.glob(f"{path}/*.gz"):
        data = gzip.open(name).read()
        while data:
            head, _, rest = data.partition(b"\r\n\r\n")
            fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
            n = int(fields["Content-Length"])
            assert head.startswith(b"WARC/1.1\r\n") and rest[n:n + 4] == b"\r\n\r\n" and fields["WARC-Date"] == "2020-01-01T00:00:00Z"
            found.append((fields["WARC-Type"], rest[:n].partition(b"\r\n\r\n")[2], fields.get("WARC-Refers-To-Target-URI")))
            data = rest[n + 4:]
    assert sum(kind == "response" for kind, _, _ in found) == 3 and len(found) == 20
    assert {(b, u) for kind, b, u in found if kind == "revisit"} == {(b"", "http://a/17"), (b"", "http://a/18"), (b"", "http://a/19")}


def test_foreign_archive(spark, tmp_path):
    """Records of other writers, other kinds and lone revisits are read by their length."""
    block = b"software: x\r\n\r\n\r\n"
    data = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Type: application/warc-fields\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(block), block)
    data += b"WARC/1.0\r\nwarc-type: revisit\r\nWARC-Refers-To: <urn:gone>\r\nWARC-Payload-Digest: sha1:ABC\r\nContent-Length: 0\r\n\r\n\r\n\r\n"
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(data[:50]) + gzip.compress(data[50:]))
    rows = warc.read(spark, str(tmp_path)).collect()
    assert [(r.record_type, r.payload and bytes(r.payload)) for r in rows] == [("warcinfo", block), ("revisit", None)]
    assert [tuple(r) for r in warc.resolved(warc.read(spark, str(tmp_path))).collect()] == [(None, None, "ABC", "revisit", None)]


def test_empty(spark):
    path, records = check(spark, [])
    assert records == []
