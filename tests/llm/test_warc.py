import numpy as np
import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from spendscope.llm import warc
from spendscope.llm.common import shared_folder

BIG = "<p>" + "text " * 400
ROWS = [
    (1, "http://a.example/1", BIG), (2, "http://a.example/2", BIG), (3, "http://a.example/é x\r\n", BIG), (4, None, "small"), (5, "http://b.example/", "small"),
    (6, "http://b.example/6", None), (7, "http://b.example/7", ""), (3, "http://a.example/3b", BIG), (8, "u", "ü😀" * 600), (None, "u", BIG), (9, "u", "z" * 3_000_000),
    (10, "u", "WARC/1.1\r\n\r\n" * 200), (11, "u", "x" * 999), (12, "u", "x" * 999), (13, "u", "x" * 1000), (14, "u", "x" * 1000),
]


def pages(spark, rows=ROWS):
    return spark.createDataFrame([(*r, "clash", b"y", 1) for r in rows], "page_id long, url string, html string, digest string, payload binary, n long")


def written(spark, df):
    folder = shared_folder(spark, "warc")
    warc.write(warc.deduplicated(df, F.concat(F.lit("urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("none")))), folder)
    return folder


def test_round_trip(spark):
    got = warc.read(spark, written(spark, pages(spark).repartition(3))).collect()
    assert len(got) == len(ROWS)
    responses = sorted(bytes(r.payload) for r in got if r.record_type == "response")
    revisits = sorted((r.record_id, r.refers_to) for r in got if r.record_type == "revisit")
    assert revisits == sorted([("<urn:page:1>", "<urn:page:3>"), ("<urn:page:13>", "<urn:page:14>"), ("<urn:page:2>", "<urn:page:3>"), ("<urn:page:none>", "<urn:page:3>")])
    again = {1, 2, None, 13}
    assert responses == sorted((h or "").encode() for i, _, h in ROWS if i not in again)
    for r in got:
        if r.record_type == "response":
            assert r.payload_digest == "sha1:" + hashlib.sha1(r.payload).hexdigest() and int(r.http_headers["content-length"]) == len(r.payload)
        else:
            assert bytes(r.payload) == b"" and r.headers["warc-profile"] == warc.PROFILE and int(r.http_headers["content-length"]) >= 1000
    assert {r.target_uri for r in got if r.record_id == "<urn:page:3>"} == {"http://a.example/%C3%A9%20x%0D%0A", "http://a.example/3b"}


@pytest.mark.parametrize("split", [50, 1000, 1 << 26])
def test_every_split_reads_each_record_once(spark, split):
    folder = written(spark, pages(spark))
    spark.dataSource.register(warc.WarcSource)
    df = spark.read.format("warc").option("splitBytes", str(split)).load(folder)
    assert sorted(r.record_id for r in df.select("record_id").collect()) == sorted(f"<urn:page:{'none' if i is None else i}>" for i, _, _ in ROWS)


def test_filters_reach_the_source(spark):
    folder = written(spark, pages(spark))
    df = warc.read(spark, folder).filter("record_type = 'revisit' and target_uri in ('http://a.example/1', 'u') and length(record_id) > 3")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert {r.record_id for r in df.collect()} == {"<urn:page:1>", "<urn:page:13>", "<urn:page:none>"}
    filters = [x for x in plan.split("\n") if "Filter" in x and "record_type" in x and "BatchScan" not in x]
    assert not any("record_type" in x.split("BatchScan")[0] and "= revisit" in x for x in filters)


def test_reader_skips_payloads_of_other_records(tmp_path, monkeypatch):
    path = tmp_path / "a.warc.gz"
    one = warc.record("response", "urn:1", "u", b"x" * 5_000_000, "0", 5_000_000, None)
    two = warc.record("response", "urn:2", "v", b"y" * 10, "0", 10, None)
    path.write_bytes(warc.member(one) + warc.member(two))
    seen = []
    ask = warc._Inflated.ask
    monkeypatch.setattr(warc._Inflated, "ask", lambda self, n: seen.append(n) or ask(self, n))
    reader = warc.WarcReader({"path": str(tmp_path)})
    assert list(reader.pushFilters([warc.EqualTo(("target_uri",), "v"), other := warc.EqualTo(("payload",), b"")])) == [other]
    rows = [b for p in reader.partitions() for b in reader.read(p)]
    assert rows[0].column("payload").to_pylist() == [b"y" * 10] and max(seen) < 10_000


def test_archives_of_others(spark, tmp_path):
    parts = [warc.record("response", f"urn:{i}", "u", b"p" * (i * 40_000), "0", i * 40_000, None) for i in range(4)]
    (tmp_path / "a.warc").write_bytes(b"".join(parts))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(map(gzip.compress, parts)))
    (tmp_path / "notes.txt").write_text("no archive")
    got = warc.read(spark, str(tmp_path)).collect()
    assert sorted((r.record_id, len(r.payload)) for r in got) == sorted([(f"<urn:{i}>", i * 40_000) for i in range(4)] * 2)


def test_empty_table(spark):
    assert warc.read(spark, written(spark, pages(spark, []))).count() == 0


def test_payload_of_256_megabytes_is_read_in_seconds(tmp_path):
    import time
    import zlib as z

    import pyarrow.fs

    payload = np.random.default_rng(1).integers(0, 256, 256 << 20, dtype=np.uint8).tobytes()
    packer = z.compressobj(1, z.DEFLATED, 31)
    path = tmp_path / "long.gz"
    with path.open("wb") as f:
        for i in range(0, len(payload), 1 << 22):
            f.write(packer.compress(payload[i : i + (1 << 22)]))
        f.write(packer.flush())
    file = pyarrow.fs.LocalFileSystem().open_input_file(str(path))
    start = time.perf_counter()
    assert z.crc32(warc._Inflated(file, 0).ask(len(payload))) == z.crc32(payload)
    assert time.perf_counter() - start < 30
