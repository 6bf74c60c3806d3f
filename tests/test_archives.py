"""Archives read in parts, records by offset, resources of captures."""

import gzip
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import captures as ops
from tidemark.sources import archives, resources, store


def warc(kind, uri, body, date="2014-01-06T03:04:05Z", more=(), content="application/http; msgtype=response"):
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: <{kind}-{uri}-{date}>", f"WARC-Target-URI: {uri}", f"WARC-Date: {date}", f"Content-Type: {content}", *more, f"Content-Length: {len(body)}"]
    return ("WARC/1.0\r\n" + "\r\n".join(head) + "\r\n\r\n").encode() + body + b"\r\n\r\n"


def http(body, status="200 OK", headers=""):
    return f"HTTP/1.1 {status}\r\nContent-Type: text/html\r\n{headers}\r\n".encode() + body


@pytest.fixture(scope="module")
def parts():
    r = random.Random(2)
    out = [warc("warcinfo", "", b"software: x", content="application/warc-fields")]
    for k in range(120):
        body = r.randbytes(r.choice([0, 10, 500, 4000])) + r.choice([b"", b"\x1f\x8b\x08\x00" * 3, b"\r\n\r\nWARC/1.0\r\n not one", b"\n\nWARC/1.0\nContent-Length: 7\n\nabc"])
        out.append(warc("response", f"http://e.com/{k}", http(body)))
    return out


def shown(rows):
    return sorted((r["filename"], r["offset"], r["length"], r["record_type"], r["target_uri"], bytes(r["payload"])) for r in rows)


def files(folder, parts):
    arc = b"filedesc://x 0.0.0.0 20140101000000 text/plain 3\n1 0\n" + b"".join(f"http://e.com/{k} 1.2.3.4 20140216050221 text/html {len(p)}\n".encode() + p + b"\n" for k, p in enumerate(http(b"%d" % k * 50) for k in range(60)))
    for name, data in {
        "plain.warc": b"".join(parts), "packed.warc.gz": b"".join(map(gzip.compress, parts)), "whole.warc.gz": gzip.compress(b"".join(parts)), "pairs.warc.gz": b"".join(gzip.compress(b"".join(parts[k : k + 2])) for k in range(0, len(parts), 2)),
        "old.arc": arc, "cut.warc.gz": b"".join(map(gzip.compress, parts))[:-40], "empty.warc": b"", "noise.warc": b"\x00\x01 nothing here",
    }.items():
        (folder / name).write_bytes(data)


def test_parts_give_the_records_of_the_whole(spark, tmp_path, parts):
    files(tmp_path, parts)
    whole = archives.read_records(spark, str(tmp_path), split_bytes=0).collect()
    n = {}
    for r in whole:
        n[r["filename"]] = n.get(r["filename"], 0) + 1
    assert n == {"plain.warc": 121, "packed.warc.gz": 121, "whole.warc.gz": 121, "pairs.warc.gz": 121, "old.arc": 61, "cut.warc.gz": 120}
    place = {p: sum(map(len, map(gzip.compress, parts[:k]))) for k, p in enumerate(parts)}
    assert [r["offset"] for r in sorted((r for r in whole if r["filename"] == "packed.warc.gz"), key=lambda r: r["offset"])] == sorted(place.values())
    for split in (700, 5_000, 100_000):
        df = archives.read_records(spark, str(tmp_path), split_bytes=split)
        assert shown(df.collect()) == shown(whole)


def test_a_start_is_confirmed(parts):
    data = b"".join(parts)
    starts = [0]
    for p in parts:
        starts.append(starts[-1] + len(p))
    packed, zipped = b"".join(map(gzip.compress, parts)), [0]
    for p in parts:
        zipped.append(zipped[-1] + len(gzip.compress(p)))
    for held, places in ((store.Held(data), starts), (store.Held(packed), zipped)):
        for low in range(0, held.size, 997):
            want = next((s for s in places[:-1] if s >= low), None)
            assert archives.record_start(held, low, held.size, window=3000) == want
            assert archives.record_start(held, low, low + 50) == (want if want is not None and want < low + 50 else None)


def test_an_archive_in_a_record_is_told(spark, tmp_path):
    inner = b"".join(warc("resource", f"http://in/{k}", b"y" * 300, content="text/plain") for k in range(40))
    data = warc("response", "http://e.com/a", http(b"x" * 400)) + warc("resource", "http://e.com/inner.warc", inner, content="application/warc") + warc("response", "http://e.com/z", http(b"z" * 400))
    (tmp_path / "n.warc").write_bytes(data)
    assert archives.read_records(spark, str(tmp_path), split_bytes=0).count() == 3
    with pytest.raises(Exception, match="split_bytes=0"):
        archives.read_records(spark, str(tmp_path), split_bytes=2_000).collect()


def test_a_large_file_is_many_tasks_and_no_row_holds_it(spark, tmp_path):
    import resource

    r = random.Random(1)
    one = r.randbytes(200_000)
    with open(tmp_path / "big.warc.gz", "wb") as f:
        for k in range(500):
            f.write(gzip.compress(warc("response", f"http://e.com/{k}", http(one[: 150_000 + 100 * k])), 1))
    size = (tmp_path / "big.warc.gz").stat().st_size
    assert size > 80_000_000
    df = archives.read_records(spark, str(tmp_path), split_bytes=8 << 20)
    assert df.rdd.getNumPartitions() == -(-size // (8 << 20)) or df.rdd.getNumPartitions() == size // (8 << 20) + 1
    got = df.select("offset", F.length("payload").alias("n")).collect()
    assert sorted(r["n"] for r in got) == [150_000 + 100 * k for k in range(500)]
    with store.Opened(str(tmp_path / "big.warc.gz")) as f:
        before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
        assert sum(1 for _ in archives.stream_records(f)) == 500
        assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 60_000  # KB
    # a thousand captures read about their own bytes
    wanted = sorted((r["offset"] for r in got), key=lambda o: o * 2654435761 % 2**32)[:20]
    with store.Opened(str(tmp_path / "big.warc.gz")) as f:
        taken = 0
        for o in wanted:
            row = resources._read_run(f, [(o, 200_000)])[0]
            assert row["offset"] == o
        taken = f.taken
    assert taken < 20 * 200_000 + 100


REQUESTS = "filename string, offset string, length string"


def test_records_by_offset(spark, tmp_path, parts):
    files(tmp_path, parts)
    names = ("plain.warc", "packed.warc.gz", "old.arc", "whole.warc.gz")
    every = [r for r in archives.read_records(spark, str(tmp_path), split_bytes=0).collect() if r["filename"] in names]
    paths = spark.createDataFrame([(n, k, p) for n in (*names, "gone.warc") for k, p in enumerate((f"{tmp_path}/away/{n}", f"{tmp_path}/{n}"))], "name string, rank int, path string")
    asked = [(r["filename"], str(r["offset"]), str(r["length"])) for r in every if r["filename"] != "whole.warc.gz"]
    got = resources.read_at(spark.createDataFrame(asked + asked[:5], REQUESTS), paths)
    assert shown(got.collect()) == shown([r for r in every if r["filename"] != "whole.warc.gz"]) and got.where("error is not null").count() == 0
    for length in ("-", None, "5", "x", "99999999"):
        one = resources.read_at(spark.createDataFrame([("packed.warc.gz", asked[200][1], length) for _ in (1,) if asked[200][0] == "packed.warc.gz"] or [(asked[3][0], asked[3][1], length)], REQUESTS), paths).collect()
        assert len(one) == 1 and one[0]["error"] is None and one[0]["payload"] is not None
    odd = [("gone.warc", "0", "10"), ("never.warc", "0", "10"), ("plain.warc", "7", "50"), ("plain.warc", "x", "50"), ("plain.warc", "999999999", "50"), (None, "1", "1"), ("plain.warc", "-1", "1"), ("plain.warc", None, None)]
    told = resources.read_at(spark.createDataFrame(odd, REQUESTS), paths).collect()
    assert all(r["error"] and r["payload"] is None for r in told) and len(told) == 7  # two name no offset
    assert resources.read_at(spark.createDataFrame([], REQUESTS), paths).count() == 0


def test_resources_of_captures(spark, tmp_path):
    empty = "sha1:3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ"
    rows = [
        ("response", "http://e.com/a", http(b"one"), "2014-01-01T00:00:00Z", ["WARC-Payload-Digest: sha1:AAA"]),
        ("revisit", "http://e.com/a", http(b"", headers="X-Own: 1\r\n"), "2014-01-02T00:00:00Z", ["WARC-Payload-Digest: sha1:AAA"]),
        ("revisit", "http://other.com/", http(b"", headers="X-Own: 2\r\n"), "2014-01-03T00:00:00Z", ["WARC-Payload-Digest: sha1:CCC", "WARC-Refers-To-Target-URI: http://e.com/c", "WARC-Refers-To-Date: 2014-01-04T00:00:00Z"]),
        ("response", "http://e.com/c", http(b"three"), "2014-01-04T00:00:00Z", ["WARC-Payload-Digest: sha1:CCC"]),
        ("revisit", "http://e.com/lost", http(b""), "2014-01-05T00:00:00Z", ["WARC-Payload-Digest: sha1:DDD", "WARC-Refers-To-Target-URI: http://nowhere.com/"]),
        ("revisit", "http://e.com/moved", http(b"", "302 Found", "Location: http://e.com/x\r\n"), "2014-01-05T00:00:00Z", ["WARC-Payload-Digest: sha1:EEE"]),
        ("revisit", "http://e.com/empty", http(b""), "2014-01-05T00:00:00Z", [f"WARC-Payload-Digest: {empty}"]),
        ("response", "http://www.e.com/self", http(b"loop", "301 Moved", "Location: https://e.com/self\r\n"), "2014-01-06T00:00:00Z", ["WARC-Payload-Digest: sha1:FFF"]),
    ]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(gzip.compress(warc(k, u, b, d, m)) for k, u, b, d, m in rows))
    index = archives.captures_of(archives.read_records(spark, str(tmp_path))).cache()
    paths = spark.createDataFrame([("a.warc.gz", 0, f"{tmp_path}/a.warc.gz")], "name string, rank int, path string")
    blocked = index.withColumn("access", F.when(F.col("url").endswith("/c"), "block").otherwise("allow"))

    def answers(df):
        return {(r["url"].split("//")[1], r["timestamp"][6:8]): (r["answer"], None if r["payload"] is None else bytes(r["payload"]), [h["value"] for h in r["headers"] or [] if h["name"] == "X-Own"]) for r in df.collect()}

    got = answers(resources.fetch(ops.resolve_revisits(index), paths, index, "url"))
    assert got == {
        ("e.com/a", "01"): (200, b"one", []), ("e.com/a", "02"): (200, b"one", ["1"]), ("other.com/", "03"): (200, b"three", ["2"]), ("e.com/c", "04"): (200, b"three", []), ("e.com/lost", "05"): (404, None, []),
        ("e.com/moved", "05"): (200, b"", []), ("e.com/empty", "05"): (200, b"", []), ("www.e.com/self", "06"): (508, None, []),
    }
    plain = answers(resources.fetch(index, paths))
    assert plain["e.com/a", "02"][0] == plain["other.com/", "03"][0] == 404 and plain["www.e.com/self", "06"][:2] == (200, b"loop")
    assert answers(resources.fetch(blocked, paths))["e.com/c", "04"] == (451, None, [])
    none = resources.fetch(index, paths.limit(0), index)
    assert {r["answer"] for r in none.collect()} == {404}
