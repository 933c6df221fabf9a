import base64
import gzip
import hashlib
import random

from codeloom.llm import warc
from codeloom.llm.common import shared_dir


def want(rows, least=0):
    first = {}
    for p, _, h in rows:
        b = (h or "").encode()
        if p is not None and len(b) >= least:
            first[b] = min(p, first.get(b, p))
    out = []
    for p, _, h in rows:
        b = (h or "").encode()
        again = b in first and first[b] != p
        out.append((p, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if again else "response", first[b] if again else None))
    return sorted(out, key=str)


def pages(rng):
    bodies = ["", None, "x", "é" * 999, "<html>\r\n\r\n</html>", "\r\n\r\n", "WARC/1.1\r\n\r\n"] + ["".join(rng.choice("abcé \r\n") for _ in range(rng.randrange(5000))) for _ in range(12)]
    rows = [(rng.randrange(10**6) * 2, f"http://h/{i}\n", rng.choice(bodies)) for i in range(150)]
    return rows + [(None, None, "only here"), (None, None, bodies[3]), (1, "u", "twice"), (1, "u", "twice"), (3, "u", "y" * 300_000)]


def test_round_trip(spark):
    rows = pages(random.Random(6))
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, sha1 int").repartition(3)
    for least in (0, 10):
        got = warc.archive_pages(df, least).collect()
        assert sorted((tuple(r)[:5] for r in got), key=str) == want(rows, least)
    folder = shared_dir(spark, "warc")
    manifest = warc.write_archives(df, folder, chunk_bytes=1000, file_bytes=3_000)
    rows_ = manifest.collect()
    assert len(rows_) > 4 and sum(r.records for r in rows_) == len(rows)
    assert gzip.open(rows_[0].path).read().startswith(b"WARC/1.1\r\n")
    chunks = warc.read_archives(spark.createDataFrame(rows_), folder, 777).collect()
    assert max(r.chunk_bytes for r in chunks) == 777
    own = sorted((r for r in chunks if r.page_id == 3), key=lambda r: r.chunk_no)
    assert b"".join(r.chunk for r in own) == b"y" * 300_000 and [r.is_last for r in own].count(True) == 1
    so_far = hashlib.sha1(b"y" * 777 * 5).digest()
    assert own[4].payload_digest == base64.b32encode(so_far).decode() and own[4].payload_bytes == 777 * 5
    assert warc.archive_pages(df.limit(0)).collect() == []


def test_records_refer_to_records(spark):
    """Files begin with a warcinfo record; record ids are UUIDs, and every revisit names a response's."""
    rows = pages(random.Random(7))
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    paths = [r.path for r in warc.write_archives(df, shared_dir(spark, "warc"), file_bytes=3_000).collect()]
    ids, refers = {}, []
    for path in paths:
        data = gzip.open(path).read().decode()
        assert data.startswith("WARC/1.1\r\nWARC-Type: warcinfo\r\n")
        for line in data.split("\r\n"):
            key, _, value = line.partition(": ")
            if key == "WARC-Type":
                kind = value
            if key == "WARC-Record-ID":
                assert value.startswith("<urn:uuid:")
                ids.setdefault(value, []).append(kind)
            if key == "WARC-Refers-To":
                refers.append(value)
    assert refers and all(ids[x][0] == "response" for x in refers)
    assert sorted(len(v) for v in ids.values())[-2:] == [1, 2]  # the two equal rows of page 1
