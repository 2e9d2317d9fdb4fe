import hashlib

import pytest
from pyspark.sql import functions as F

from jobweave.llm import warc

FAKE = "WARC/1.0\r\nWARC-Type: response\r\nX-Page-ID: 999\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"


def test_round_trip_rejects_records_in_payloads(spark, tmp_path):
    big = "<p>" + "é" * 600 + "</p>"
    html = [FAKE, FAKE * 40, big, "x" + FAKE, None, "", big, "small", "small", "WARC/1.0\r\n" * 50, "a\r\n\r\nb", big + " "]
    pages = spark.createDataFrame([(i, f"http://h/{i}\r\nX: y" if i else None, h) for i, h in enumerate(html)], "page_id long, url string, html string").repartition(2)
    for block in (61, 4096):
        rows = {r.page_id: r for r in warc.round_trip(pages, str(tmp_path / f"w{block}"), block).collect()}
        assert sorted(rows) == list(range(len(html))) and all(r.intact for r in rows.values())
        for i, h in enumerate(html):
            data = (h or "").encode()
            assert (rows[i].payload_bytes, rows[i].payload_digest) == (len(data), hashlib.sha1(data).hexdigest())
            assert (rows[i].record_type, rows[i].refers_to) == (("revisit", 6) if i == 2 else ("response", None))


def test_many_records_in_one_chain(spark, tmp_path):
    pages = spark.range(700).select(F.col("id").alias("page_id"), F.lit("http://h/").alias("url"), F.concat(F.lit("<p>"), F.col("id").cast("string"), F.lit(FAKE)).alias("html")).coalesce(1)
    warc.write_archive(pages, str(tmp_path / "w"))
    assert warc.candidates(spark, str(tmp_path / "w"), 1000).count() == 1400
    assert warc.read_records(spark, str(tmp_path / "w"), 1000).count() == 700


def test_damage_is_an_error(spark, tmp_path):
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "a.warc").write_bytes(FAKE.encode() + b"WARC/1.0\r\nContent-Length: 99\r\n\r\nshort")
    with pytest.raises(ValueError, match="breaks off"):
        warc.read_records(spark, str(tmp_path / "w"))
