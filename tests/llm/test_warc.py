import base64
import hashlib
from collections import defaultdict

import edge
import pytest
from pyspark.sql import functions as F

from guardframe.llm import warc


def plain(rows, least=0):
    first = defaultdict(list)
    for key, _, html in rows:
        if key is not None:
            first[html or ""].append(key)
    out = []
    for key, url, html in rows:
        data = (html or "").encode()
        low = min(first[html or ""], default=None)
        response = key == low or len(data) < least
        out.append((str(key), url or "", "response" if response else "revisit", None if response else low, len(data),
                    base64.b32encode(hashlib.sha1(data).digest()).decode()))
    return sorted(out, key=str)


def result(spark, archive):
    return sorted(((str(r["page_id"]), r["url"], r["record_type"], r["refers_to"], r["payload_bytes"], r["payload_digest"])
                   for r in warc.read(spark, archive).collect()), key=str)


def test_whole_table(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    rows = [tuple(r) for r in pages.select("page_id", "url", "html").collect()]
    assert result(spark, warc.write(pages)) == plain(rows)


ROWS = [(5, "http://a", "same"), (3, "http://b", "same"), (9, None, "same"), (1, "http://c", None), (2, "http://d", ""),
        (7, "http://e\r\nX: y", "é☃"), (3, "http://b", "same"), (None, "http://f", "same"), (None, "http://g", "alone"),
        (None, "http://h", "alone"), (8, "http://i", "x" * 300_000), (3, "http://j", "other")]


def test_edges(spark):
    pages = edge.clashing(spark.createDataFrame(ROWS, "page_id long, url string, html string"))
    wanted = [(k, "http://e X: y" if u and "\r" in u else u, h) for k, u, h in ROWS]
    for least in (0, 5):
        archive = warc.write(pages, least_bytes=least)
        assert result(spark, archive) == plain(wanted, least)
        stored = spark.read.parquet(archive.payloads)
        assert stored.count() == len({h or "" for _, _, h in ROWS})
    assert result(spark, warc.write(pages.limit(0))) == []


def test_records_come_back_byte_by_byte(spark):
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string")
    archive = warc.write(pages)
    rows = warc.rebuild(spark, archive).collect()
    assert len(rows) == len(ROWS)
    for r in rows:
        head, body = bytes(r["record"]).split(b"\r\n\r\n", 1)
        fields = dict(line.split(b": ", 1) for line in head.split(b"\r\n")[1:])
        assert head.startswith(b"WARC/1.1\r\n")
        body = body[:-4]
        assert len(body) == int(fields[b"Content-Length"])
        said = base64.b32encode(hashlib.sha1(bytes(r["payload"])).digest())
        assert fields[b"WARC-Payload-Digest"] == b"sha1:" + said
        assert body == (bytes(r["payload"]) if fields[b"WARC-Type"] == b"response" else b"")


@pytest.mark.parametrize("table,column,new,said", [
    ("payloads", "payload", "cast('else' as binary)", "is not what was stored"),
    ("records", "header", "cast(replace(decode(header, 'UTF-8'), 'sha1:', 'sha1:A') as binary)", "does not fit"),
    ("records", "header", "cast(regexp_replace(decode(header, 'UTF-8'), 'Length: [0-9]+', 'Length: 3') as binary)", "does not fit"),
    ("records", "header", "cast(replace(decode(header, 'UTF-8'), 'Type: revisit', 'Type: response') as binary)", "does not fit"),
    ("records", "key", "cast('other' as binary)", "does not fit"),
])
def test_damage_is_noticed(spark, table, column, new, said):
    archive = warc.write(spark.createDataFrame(ROWS[:2], "page_id long, url string, html string"))
    path = getattr(archive, table)
    stored = spark.read.parquet(path)
    broken = stored.withColumn(column, F.expr(new)).collect()
    spark.createDataFrame(broken, stored.schema).write.mode("overwrite").parquet(path)
    with pytest.raises(Exception, match=said):
        warc.read(spark, archive).collect()


def test_a_payload_that_a_third_of_the_pages_share(spark):
    pages = spark.range(6000).select(
        F.col("id").alias("page_id"), F.lit("http://h").alias("url"),
        F.when(F.col("id") % 3 == 1, "not found").otherwise(F.concat(F.lit("page "), "id")).alias("html"))
    rows = [tuple(r) for r in pages.collect()]
    assert result(spark, warc.write(pages.repartition(7))) == plain(rows)
