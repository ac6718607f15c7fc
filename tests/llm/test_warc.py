import hashlib
import random

import pytest
from brute import SF

from peerbench.llm import queries
from peerbench.llm.warc import MAGIC, page_records, parse_header, read_warc, write_warc


def expected(rows):
    """rows: (page_id, url, html)."""
    first, out = {}, []
    for i, _, html in rows:
        data = (html or "").encode()
        if len(data) >= 100 and i is not None:
            first[data] = min(i, first.get(data, i))
    for i, _, html in rows:
        data = (html or "").encode()
        at = first.get(data, i) if i is not None else None
        again = at != i
        out.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", at if again else None))
    return sorted(out, key=str)


def found(df):
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()), key=str)


def test_pages_of_the_table(spark):
    rows = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    assert found(queries.op3_warc(spark, SF)) == expected(rows)


@pytest.fixture()
def small_blocks(spark):
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    yield lambda n: spark.conf.set(key, str(n))
    spark.conf.set(key, before)


@pytest.mark.parametrize("block", [700, 4096, 1 << 20])
def test_magic_in_payloads_and_block_bounds(spark, small_blocks, tmp_path, block):
    rng = random.Random(block)
    fake = f"{MAGIC}WARC-Type: response\r\nContent-Length: 7\r\n\r\npayload\r\n\r\n"
    wrong = f"{MAGIC}WARC-Type: response\r\nContent-Length: 99999\r\n\r\nx"
    parts = [fake, wrong, MAGIC, "WARC/1.1", "\r\n\r\n", "\r\n", "é漢😀", "text " * 20, "W", "WARC/1.1\r"]
    rows = [(i * 3 - 50, f"http://x/{i} a\r\nWARC/1.1", "".join(rng.choices(parts, k=rng.randint(0, 8)))) for i in range(120)]
    rows += [(1000, None, None), (1001, "", ""), (1002, "u", MAGIC * 300), (1003, "u", MAGIC * 300), (1004, "u", "y" * 100), (1005, "u", "y" * 100), (1006, "u", "y" * 99), (1007, "u", "y" * 99)]
    rows += [(None, "n", "y" * 100), (1004, "again", "y" * 100), (1004, "other", "z" * 500), (900, "other", "z" * 500), (1008, "long", "w" * 30_000)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "1 as digest", "2 as first", "3 as bytes").repartition(2)
    small_blocks(1 << 27)
    write_warc(df, f"{tmp_path}/a")
    small_blocks(block)
    assert found(page_records(read_warc(spark, f"{tmp_path}/a"))) == expected(rows)


def test_broken_chain_is_an_error(spark, tmp_path):
    write_warc(spark.createDataFrame([(1, "u", "x" * 50), (2, "u", "y")], "page_id bigint, url string, html string").coalesce(1), f"{tmp_path}/a")
    (file,) = (tmp_path / "a").glob("part*")
    text = file.read_bytes().replace(b"Content-Length: 50", b"Content-Length: 51")
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "part.txt").write_bytes(text)
    with pytest.raises(ValueError, match="do not reach"):
        read_warc(spark, f"{tmp_path}/b")


def test_header_and_empty_table(spark, tmp_path):
    assert parse_header(b"warc-type: response\r\nCONTENT-LENGTH:  5\r\n\r\nhello") == (43, {"warc-type": "response", "content-length": "5"})
    assert parse_header(b"no colon\r\n\r\n") is None and parse_header(b"WARC-Type: x\r\n\r\n") is None
    write_warc(spark.createDataFrame([], "page_id bigint, url string, html string"), f"{tmp_path}/e")
    assert page_records(read_warc(spark, f"{tmp_path}/e")).collect() == []
