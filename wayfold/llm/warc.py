"""WARC archives: writing with segmented records, reading with segment reassembly.

A page becomes a response record whose block is an HTTP response with chunked transfer framing.
Blocks longer than a segment are cut: the first segment carries the headers, the others are
continuation records that name the origin record, their number and, on the last, the total
length. Reading parses archives by content length, groups continuation records by origin,
orders them by segment number, verifies the total length and decodes the chunks.

Of pages with equal payloads of ``REVISIT_FROM`` bytes or more, the one with the largest page_id is
the response and the others revisit it. Archives are gzipped files in the shared folder, of bounded
size. Pages are numbered once, in a written table. Null html is an empty payload; rows with equal ids are records of their own (the response
among equal ids is one of them); a null id loses ties to any other; an empty table writes no
record. A record that lacks a segment or whose length is wrong raises.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayfold.llm.common import discard, keyed_join, new_path, pick, read, written

#: Payloads from this size on are not written twice.
REVISIT_FROM = 1000
SEGMENT, CHUNK = 32 << 10, 8 << 10
#: Records of one archive file; with a segment's bound this bounds the file.
PER_FILE = 2000
END = b"\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    """Chunked transfer framing of a payload."""
    parts = [payload[at : at + size] for at in range(0, len(payload), size)]
    return b"".join(b"%x\r\n%s\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def dechunked(body: bytes) -> bytes:
    """The payload of chunked framing; raises if it breaks off."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        n = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if n == 0:
            return b"".join(out)
        if body[at + n : at + n + 2] != b"\r\n":
            raise ValueError("a chunk breaks off")
        out.append(body[at : at + n])
        at += n + 2


def record(kind: str, rid: str, block: bytes, **more) -> bytes:
    """One WARC record without the two line ends that close it."""
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: <{rid}>", f"WARC-Date: {DATE}", *[f"{k.replace('_', '-')}: {v}" for k, v in more.items() if v is not None], f"Content-Length: {len(block)}"]
    return ("WARC/1.1\r\n" + "\r\n".join(head)).encode() + END + block


def records(rid: str, url: str | None, payload: bytes, sha1: str, refers: str | None, segment: int = SEGMENT, chunk: int = CHUNK) -> list[bytes]:
    """The records of a page: a revisit, or a response in as many segments as it needs."""
    uri = re.sub(r"[\r\n]", "", url or "") or None
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
    common = {"WARC_Target_URI": uri, "WARC_Payload_Digest": f"sha1:{sha1}"}
    if refers is not None:
        return [record("revisit", rid, head, **common, WARC_Refers_To=f"<{refers}>", WARC_Profile="http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", X_Payload_Length=len(payload))]
    block = head + chunked(payload, chunk)
    if len(block) <= segment:
        return [record("response", rid, block, **common)]
    cuts = [block[at : at + segment] for at in range(0, len(block), segment)]
    out = [record("response", rid, cuts[0], **common, WARC_Segment_Number=1)]
    for i, cut in enumerate(cuts[1:], 2):
        total = {"WARC_Segment_Total_Length": len(block)} if i == len(cuts) else {}
        out.append(record("continuation", f"{rid}:{i}", cut, WARC_Segment_Origin_ID=f"<{rid}>", WARC_Segment_Number=i, **total))
    return out


def parsed(archive: bytes):
    """(headers, block) of each record of an archive."""
    at = 0
    while at < len(archive):
        end = archive.index(END, at)
        lines = archive[at:end].decode("utf-8").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        fields = {k.strip().lower(): v.strip() for k, v in (x.split(":", 1) for x in lines[1:])}
        n = int(fields["content-length"])
        block = archive[end + 4 : end + 4 + n]
        if len(block) < n:
            raise ValueError("a record breaks off")
        yield fields, block
        at = end + 4 + n + len(END)


def write_archives(pages: DataFrame, segment: int = SEGMENT, chunk: int = CHUNK, per_file: int = PER_FILE) -> str:
    """Archives of page_id, url, html; returns their folder. Record ids are urn:page:<id>:<row>."""
    spark = pages.sparkSession
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    numbered = pick(pages, "page_id", "url", "html").select("page_id", "url", payload.alias("payload"), F.monotonically_increasing_id().alias("uid"))
    rows = written(numbered.withColumns({"size": F.length("payload").cast("long"), "sha1": F.sha1("payload")}), "pages")
    # one row per payload leaves a task, however many copies it has
    best = F.max(F.struct(F.col("page_id").isNotNull().alias("known"), "page_id", "uid")).alias("best")
    keys = ["sha1", "size"]
    slim = rows.where(F.col("size") >= REVISIT_FROM).select("uid", "page_id", *keys)
    groups = written(slim.groupBy(*keys).agg(best, F.count("*").alias("n")).where("n > 1"), "copies")
    linked = keyed_join(slim.drop("page_id"), groups.drop("n"), keys, groups.select(*keys, "n")).where(F.col("uid") != F.col("best.uid"))
    linked = written(linked.select("uid", F.col("best.uid").alias("of"), F.col("best.page_id").alias("of_page")), "revisits")
    # a revisit holds no payload, so only first copies are moved whole
    plan = rows.join(linked, "uid", "left")

    def write(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for row in batch.to_pylist():
                name = lambda page, uid: f"urn:page:{'' if page is None else page}:{uid}"
                refers = None if row["of"] is None else name(row["of_page"], row["of"])
                out += records(name(row["page_id"], row["uid"]), row["url"], row["payload"], row["sha1"], refers, segment, chunk)
            for at in range(0, len(out), 500):
                yield pa.RecordBatch.from_pydict({"value": pa.array(out[at : at + 500], pa.binary())})

    path = new_path(spark, "warc")
    # a record's end is the writer's line end; a record itself is bytes that the text writer leaves alone
    lines = plan.select("uid", "page_id", "url", "payload", "sha1", "of", "of_page").mapInArrow(write, "value binary").select(F.col("value").cast("string").alias("value"))
    lines.write.option("lineSep", END.decode()).option("maxRecordsPerFile", per_file).option("compression", "gzip").text(path)
    discard(rows, groups, linked)
    return path


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """record_id, record_type, refers_to, digest and payload (null for revisits) of the archives in
    a folder, with segmented records whole again."""
    kinds = T.StructType.fromDDL("record_id string, record_type string, refers_to string, digest string, length long, origin string, segment int, total long, block binary")

    def parse(batches):
        import gzip

        import pyarrow as pa

        names = [f.name for f in kinds]
        for batch in batches:
            for archive in batch.column(0).to_pylist():
                rows = []
                for fields, block in parsed(gzip.decompress(archive) if archive[:2] == b"\x1f\x8b" else archive):
                    number = int(fields.get("warc-segment-number", 0))
                    bare = lambda k: fields[k].strip("<>") if k in fields else None  # noqa: B023, E731
                    rid, length = bare("warc-record-id"), fields.get("x-payload-length")
                    total = fields.get("warc-segment-total-length")
                    rows.append((rid, fields["warc-type"], bare("warc-refers-to"), fields.get("warc-payload-digest"), length and int(length), bare("warc-segment-origin-id") or (rid if number else None), number, total and int(total), block))
                    if sum(len(r[8]) for r in rows[-200:]) > 4 << 20 or len(rows) >= 200:
                        yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema=schema)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema=schema)

    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(kinds)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    rows = files.mapInArrow(parse, kinds)
    single = rows.where("origin IS NULL").select("record_id", "record_type", "refers_to", "digest", "length", "block")
    parts = rows.where("origin IS NOT NULL").groupBy("origin").agg(
        F.array_sort(F.collect_list(F.struct("segment", "block"))).alias("parts"),
        F.max("total").alias("total"),
        F.max(F.when(F.col("segment") == 1, F.struct("record_type", "refers_to", "digest", "length"))).alias("h"),
    )
    @F.arrow_udf("binary")
    def joined_blocks(blocks):
        import pyarrow as pa

        return pa.array([b"".join(x) for x in blocks.to_pylist()], pa.binary())

    whole = parts.select("origin", "h", "total", F.expr("parts.segment").alias("numbers"), joined_blocks(F.expr("parts.block")).alias("block"))
    complete = (F.col("numbers") == F.sequence(F.lit(1), F.size("numbers"))) & F.col("h").isNotNull() & (F.length("block") == F.col("total"))
    checked = F.when(F.coalesce(complete, F.lit(False)), F.col("block")).otherwise(F.raise_error(F.concat(F.lit("segments missing of "), F.col("origin"))).cast("binary"))
    joined = whole.select(F.col("origin").alias("record_id"), "h.record_type", "h.refers_to", "h.digest", "h.length", checked.alias("block"))

    @F.arrow_udf("binary")
    def body(blocks):
        import pyarrow as pa

        def payload(b):
            head, _, rest = b.partition(END)
            return dechunked(rest) if b"transfer-encoding: chunked" in head.lower() else rest

        return pa.array([None if b is None else payload(b) for b in blocks.to_pylist()], pa.binary())

    everything = single.unionByName(joined)
    return everything.select("record_id", "record_type", "refers_to", "digest", "length", body(F.when(F.col("record_type") == "response", F.col("block"))).alias("payload"))


def archived(pages: DataFrame, segment: int = SEGMENT, chunk: int = CHUNK, per_file: int = PER_FILE) -> DataFrame:
    """Pages written to archives and read back: page_id, payload_bytes, payload_digest, record_type,
    refers_to. Digests of responses are taken of the payload that was read."""
    rows = read_archives(pages.sparkSession, write_archives(pages, segment, chunk, per_file))
    kind = pick(pages, "page_id").schema["page_id"].dataType

    def page(name):
        text = F.element_at(F.split(name, ":"), 3)
        return F.when(text != "", text).cast(kind)

    return rows.select(
        page(F.col("record_id")).alias("page_id"),
        F.coalesce(F.length("payload").cast("long"), F.col("length")).alias("payload_bytes"),
        F.coalesce(F.sha1("payload"), F.substring_index("digest", ":", -1)).alias("payload_digest"),
        "record_type",
        page(F.col("refers_to")).alias("refers_to"),
    )


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archived(read(spark, sf_dir, "pages"))
