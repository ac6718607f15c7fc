"""WARC archives: writing pages, and reading records back with boundary-chain verification.

Spark's text files write and split the archives: a record is a header and a payload, ended by the
separator of lines. Reading splits a file at each place where the magic bytes stand, also in payloads,
so what is read are candidates. Each task tells for its candidates where the record would end, which is
where the next one has to begin. Pointer jumping from the start of each file keeps those that are
reached: within a block of a file chains are followed at once, and between blocks the pointers double,
so rounds grow with the logarithm of the blocks of a file. Magic bytes inside a payload are not
reached, whatever they are followed by. A file whose chain does not reach its end is an error.

Records whose payloads hold the magic are put together from their parts in a second pass over the
files; others are digested in the first. No task holds more than a block's candidates or a record.

Defined results: a null payload is empty; rows with a null id are response records without an id; rows
that repeat an id and a payload are each written and returned; control characters and blanks of a URL
are percent-encoded, a null URL has no header. Other columns are not read. Header lines that end in
the magic, which this writer never makes, break the chain.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from peerbench.llm.tables import settle

MAGIC = "WARC/1.1\r\n"
END = "\r\n\r\n"
#: Payloads from this size on refer to an equal earlier one.
REVISIT_BYTES = 100
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_HEADER = re.compile(rb"([^:\r\n]+):[ \t]*([^\r\n]*)\r\n")
_ID = "<urn:page:"


def _header(name: str, value: Column) -> Column:
    """One line, or nothing for null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))


def _safe_url(url: Column) -> Column:
    for c in ("%09", "%0A", "%0B", "%0C", "%0D", "%20"):
        url = F.replace(url, F.lit(chr(int(c[1:], 16))), F.lit(c))
    return F.replace(url, F.lit("WARC/1.1"), F.lit("WARC/1%2E1"))


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", date: str = DATE) -> None:
    """One record for each row. Only digests are grouped; payloads move only if the table of
    revisits is too large for Spark to broadcast."""
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.coalesce(payload_col, F.lit("")).alias("payload"))
    rows = rows.withColumns({"bytes": F.octet_length("payload"), "digest": F.sha2(F.col("payload").cast("binary"), 256)})
    large = rows.where(F.col("bytes") >= REVISIT_BYTES).select("id", "digest")
    firsts = large.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1")
    revisits = settle(large.join(firsts, "digest").where("id <> first").select("id", "digest", "first").distinct(), "revisits")
    rows = rows.join(revisits, ["id", "digest"], "left")
    again = F.col("first").isNotNull()
    name = lambda c: F.concat(F.lit(_ID), F.col(c), F.lit(">"))
    record = F.concat(
        F.lit(MAGIC),
        _header("WARC-Type", F.when(again, "revisit").otherwise("response")),
        _header("WARC-Record-ID", F.coalesce(name("id"), F.concat(F.lit("<urn:uuid:"), F.uuid(), F.lit(">")))),
        _header("WARC-Date", F.lit(date)),
        _header("WARC-Target-URI", _safe_url(F.col("url"))),
        _header("WARC-Profile", F.when(again, PROFILE)),
        _header("WARC-Refers-To", name("first")),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        _header("Content-Type", F.lit("text/html")),
        _header("Content-Length", F.when(again, 0).otherwise(F.col("bytes")).cast("string")),
        F.lit("\r\n"),
        F.when(again, "").otherwise(F.col("payload")),
    )
    rows.select(record.alias("value")).write.option("lineSep", END).text(path)


def _parts(spark: SparkSession, path: str) -> DataFrame:
    """What stands between magic bytes, in the order of the file within each block."""
    text = spark.read.option("lineSep", MAGIC).text(path)
    return text.select(F.col("value").cast("binary").alias("part"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


def parse_header(part: bytes) -> tuple[int, dict[str, str]] | None:
    """Bytes up to the payload and the fields of a header; None if this is no record's header."""
    stop = part.find(b"\r\n\r\n")
    if stop < 0:
        return None
    fields, at = {}, 0
    while at < stop + 2:
        m = _HEADER.match(part, at)
        if not m:
            return None
        fields[m[1].decode("utf-8", "replace").strip().lower()] = m[2].decode("utf-8", "replace").strip()
        at = m.end()
    if not fields.get("content-length", "").isascii() or not fields.get("content-length", "").isdigit() or "warc-type" not in fields:
        return None
    return stop + 4, fields


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, int, bytes]]:
    """File, block, place after the block's first part, and part."""
    where, local = None, 0
    for batch in batches:
        for part, file, block in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if where != (file, block):
                where, local = (file, block), 0
            yield file, block, local, part
            local += len(part) + len(MAGIC)


_CANDIDATE = "file string, block bigint, local bigint, size bigint, next bigint, head bigint, type string, id bigint, refers_to bigint, digest string, bytes bigint, url string, claimed string"


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each part's size and, if it begins with a record's header, where the next record's part begins.
    ``digest`` is that of the payload if the record ends with the part."""
    names = [x.split()[0] for x in _CANDIDATE.split(", ")]
    types = [pa.string(), *[pa.int64()] * 5, pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string()]
    rows: list[tuple] = []

    def out() -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

    page = lambda x: int(x[len(_ID) : -1]) if x.startswith(_ID) and x[len(_ID) : -1].lstrip("-").isdigit() else None
    for file, block, local, part in _placed(batches):
        parsed = parse_header(part)
        if parsed is None:
            rows.append((file, block, local, len(part), *[None] * 9))
        else:
            head, fields = parsed
            size = int(fields["content-length"])
            end = head + size + len(END)
            whole = end == len(part) and part.endswith(END.encode())
            digest = hashlib.sha256(part[head : head + size]).hexdigest() if whole else None
            rows.append((file, block, local, len(part), local + end + len(MAGIC), head, fields["warc-type"], page(fields.get("warc-record-id", "")), page(fields.get("warc-refers-to", "")), digest, size, fields.get("warc-target-uri"), fields.get("warc-payload-digest", "").removeprefix("sha256:") or None))
        if len(rows) >= 5000:
            yield out()
            rows = []
    yield out()


def _follow(starts: list[int], nexts: list[int], entries: set[int] | None = None) -> tuple[list[int], list[int]]:
    """Where the chain of each record of a block leaves it; and the records on the chains of ``entries``."""
    to = dict(zip(starts, nexts, strict=True))
    leaves: dict[int, int] = {}
    for start in sorted(to, reverse=True):
        leaves[start] = leaves.get(to[start], to[start])
    on = []
    for at in entries or ():
        while at in to:
            on.append(at)
            at = to.pop(at)
    return [leaves[s] for s in starts], on


def _leaving(table: pa.Table) -> pa.Table:
    leave, _ = _follow(table["start"].to_pylist(), table["next"].to_pylist())
    return pa.table({"file": table["file"], "start": table["start"], "leave": pa.array(leave, pa.int64())})


def _on_chain(table: pa.Table) -> pa.Table:
    starts = table["start"].to_pylist()
    entries = {s for s, x in zip(starts, table["entry"].to_pylist(), strict=True) if x}
    _, on = _follow(starts, table["next"].to_pylist(), entries)
    on = set(on)
    return table.filter(pa.array([s in on for s in starts], pa.bool_())).drop_columns(["entry"])


def _reached(records: DataFrame) -> DataFrame:
    """file and start of records of each block at which the chain from the file's start enters it."""
    leaves = records.select("file", "block", "start", "next").groupBy("file", "block").applyInArrow(_leaving, "file string, start bigint, leave bigint")
    leaves = settle(leaves, "leaves")
    first = records.select("file").distinct().withColumn("start", F.lit(len(MAGIC)).cast("long"))
    marks = leaves.select("file", F.col("leave").alias("start")).union(first).distinct()
    jump = settle(leaves.join(marks, ["file", "start"], "left_semi"), "jumps")
    reach, known = first, -1
    while True:
        reach = settle(reach.union(reach.join(jump, ["file", "start"]).select("file", F.col("leave").alias("start"))).distinct(), "reached")
        n = reach.count()
        if n == known:
            return reach
        known = n
        far = jump.select("file", F.col("start").alias("leave"), F.col("leave").alias("far"))
        jump = settle(jump.join(far, ["file", "leave"], "left").select("file", "start", F.coalesce("far", "leave").alias("leave")), "jumps")


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """``type, id, refers_to, url, claimed, bytes, digest`` of every record; size and digest are those
    of the payload as it stands in the archive, ``claimed`` is the digest that the header names."""
    parts = settle(_parts(spark, path).mapInArrow(_candidates, _CANDIDATE), "candidates")
    blocks = parts.groupBy("file", "block").agg(F.sum(F.col("size") + len(MAGIC)).alias("span"))
    blocks = settle(blocks.selectExpr("file", "block", "sum(span) over (partition by file order by block) - span as base", "sum(span) over (partition by file) as stop"), "blocks")
    placed = parts.join(blocks, ["file", "block"]).selectExpr("*", "base + local as start", "base + next as following")
    placed = placed.drop("next").withColumnRenamed("following", "next")
    # what stands before the first magic bytes of a file is no record
    records = settle(placed.where("next is not null and start > 0").drop("local", "base"), "records")
    reached = _reached(records)
    broken = blocks.select("file", F.col("stop").alias("start")).distinct().where(f"start > {len(MAGIC)}").join(reached, ["file", "start"], "left_anti")
    bad = broken.select("file").limit(3).collect()
    if bad:
        raise ValueError(f"the records do not reach the end of {[r.file for r in bad]}")
    entered = records.join(reached.withColumn("entry", F.lit(True)), ["file", "start"], "left")
    entered = entered.select("file", "block", "start", "next", "head", "type", "id", "refers_to", "digest", "bytes", "url", "claimed", F.coalesce("entry", F.lit(False)).alias("entry"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in entered.schema if f.name != "entry")
    chain = settle(entered.groupBy("file", "block").applyInArrow(_on_chain, schema), "chain")
    split = chain.where("digest is null")
    whole = chain.where("digest is not null").select("type", "id", "refers_to", "url", "claimed", "bytes", "digest")
    if split.isEmpty():
        return whole
    return whole.union(_put_together(spark, path, blocks, split, placed))


def _put_together(spark: SparkSession, path: str, blocks: DataFrame, split: DataFrame, placed: DataFrame) -> DataFrame:
    """Records whose payload holds the magic, from all parts between their start and the next record."""
    files = split.select("file").distinct()
    heads = split.select("file", "start", F.col("start").alias("first"), F.col("next").alias("stop"))
    known = placed.join(files, "file", "left_semi").select("file", "block", "local", "start").join(heads, ["file", "start"], "left")
    # only files with such records; a file's places, not its bytes
    belongs = known.selectExpr("file", "block", "local", "start", "last(first, true) over (partition by file order by start) as first", "last(stop, true) over (partition by file order by start) as stop")
    belongs = belongs.where("start < stop").select("file", "block", "local", "start", "first")

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for file, block, local, part in _placed(batches):
            yield pa.RecordBatch.from_pydict({"file": [file], "block": [block], "local": [local], "part": [part]}, schema=pa.schema([("file", pa.string()), ("block", pa.int64()), ("local", pa.int64()), ("part", pa.binary())]))

    pieces = _parts(spark, path).mapInArrow(texts, "file string, block bigint, local bigint, part binary").join(belongs, ["file", "block", "local"])
    joined = pieces.groupBy("file", "first").agg(F.expr(f"array_join(transform(array_sort(collect_list(struct(start, hex(part) as part))), x -> x.part), '{MAGIC.encode().hex()}')").alias("text"))
    joined = joined.withColumn("text", F.unhex("text"))
    out = split.join(joined.withColumnRenamed("first", "start"), ["file", "start"])
    payload = F.expr("substring(text, cast(head as int) + 1, cast(bytes as int))")
    return out.select("type", "id", "refers_to", "url", "claimed", "bytes", F.sha2(payload, 256).alias("digest"))


def page_records(records: DataFrame) -> DataFrame:
    """Every page with size and digest of its full payload; revisits take them from the record that
    they refer to."""
    full = records.where("type = 'response'").groupBy(F.col("id").alias("refers_to"), "digest").agg(F.max("bytes").alias("full_bytes"))
    full = full.withColumnRenamed("digest", "full_digest")
    own = records.where("type = 'response'").select(F.col("id").alias("page_id"), F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), F.lit(None).cast("long").alias("refers_to"))
    again = records.where("type = 'revisit'").select("id", "type", "refers_to", F.col("claimed").alias("full_digest")).join(full, ["refers_to", "full_digest"])
    return own.union(again.select("id", "full_bytes", "full_digest", "type", "refers_to"))
