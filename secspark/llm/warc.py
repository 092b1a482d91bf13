"""Operator 5: WARC archives with revisit records.

Payload digests (bare base32 SHA-1) and page ids are grouped by digest without the payloads; of records with equal
payloads the largest page id is the response, the others become revisit records that refer to it. Archives are WARC 1.0:
one file for each partition, one gzip member for each record, a warcinfo record first, responses and revisits with an HTTP
header, and fresh record headers. They are written by Spark's own committer: a member ends with the highest byte of its
size, which is 0, so the sink's row separator is that byte (records of 16 MB and more take several members).

``read_archives`` reads any gzip-compressed WARC files: they are read as streams of pieces that start at a version line, and
joined by Content-Length, so no file is held whole and a payload may hold anything; each payload is checked against its
digest.

Cases: null html is an empty payload; null url an empty target; line breaks in a url become blanks; rows repeating the
response's page id and payload are responses too; record ids are made from page id, digest and url, and from the
place in the archive for rows that repeat these (a revisit then names its response by URI and date); a null page_id is never
chosen over others; extra columns are ignored; an empty table gives an archive without pages and no rows. Payloads smaller
than ``min_bytes`` are always responses. A file that is cut off or a payload that doesn't meet its digest raises an error.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from secspark.llm.common import materialize, read_table, scratch_dir

#: Base32 (RFC 4648).
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"


def base32_sha1(payload: Column) -> Column:
    """160 bits as 32 letters: each 5 hex digits are 20 bits, that is 4 letters."""
    h = F.sha1(payload)
    words = [F.conv(F.substring(h, 5 * i + 1, 5), 16, 10).cast("int") for i in range(8)]
    return F.concat(*[F.substring(F.lit(ALPHABET), F.shiftright(w, 15 - 5 * j).bitwiseAND(31) + 1, F.lit(1)) for w in words for j in range(4)])


def revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Rows ``(page_id, digest, url, refers_to, refers_url, again, known)`` of the pages that revisit another one or repeat a row,
    from headers alone. ``again``: the row is repeated; ``known``: its response isn't."""
    head = pages.select("page_id", "url", base32_sha1(F.col("payload")).alias("digest"), F.octet_length("payload").cast("long").alias("bytes"))
    heads = materialize(head.groupBy("page_id", "url", "digest", "bytes").agg(F.count("*").alias("rows")), "headers")
    large = heads.where(F.col("bytes") >= min_bytes)
    first = large.groupBy("digest").agg(F.max(F.struct("page_id", "url", "rows")).alias("first"), F.count("*").alias("n")).where("n > 1")
    seen = large.join(first, "digest").where("not page_id <=> first.page_id")
    seen = seen.select("page_id", "digest", "url", F.col("first.page_id").alias("refers_to"), F.col("first.url").alias("refers_url"), (F.col("rows") > 1).alias("again"), (F.col("first.rows") == 1).alias("known"))
    # responses that occur more than once
    twice = heads.where("rows > 1").select("page_id", "digest", "url", F.lit(None).cast("long").alias("refers_to"), F.lit(None).cast("string").alias("refers_url"), F.lit(True).alias("again"), F.lit(False).alias("known"))
    return materialize(seen.unionByName(twice).groupBy("page_id", "digest", "url").agg(F.max("refers_to").alias("refers_to"), F.max("refers_url").alias("refers_url"), F.max("again").alias("again"), F.max("known").alias("known")), "revisits")


_DATE = "1970-01-01T00:00:00Z"
_SPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:x-secspark:pages")


def _record_id(*parts) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, chr(0).join(map(str, parts)))}>"


def _members(record: bytes) -> Iterator[bytes]:
    """The record's gzip members without their last byte, which is 0 below 16 MB."""
    for i in range(0, len(record), 1 << 23):
        z = zlib.compressobj(6, zlib.DEFLATED, 31)
        yield (z.compress(record[i : i + (1 << 23)]) + z.flush())[:-1]


def _record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    lines = ["WARC/1.0", *(f"{k}: {v}" for k, v in fields if v is not None), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _archive(run_id: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        info = _record_id(run_id, part)
        out = list(_members(_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", info), ("WARC-Date", _DATE), ("Content-Type", "application/warc-fields")], b"software: secspark\r\nformat: WARC File Format 1.0\r\n")))
        place = 0
        for b in batches:
            for r in range(b.num_rows):
                page, url, payload, digest, refers, refers_url, again, known = (b.column(k)[r].as_py() for k in range(8))
                uri = lambda u: re.sub(r"[\r\n]+", " ", u or "")
                http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
                block = http if refers is not None else http + payload
                fields = [
                    ("WARC-Type", "response" if refers is None else "revisit"),
                    ("WARC-Record-ID", _record_id(run_id, part, place) if again else _record_id("page", page, digest, url)),
                    ("WARC-Warcinfo-ID", info),
                    ("WARC-Target-URI", uri(url)),
                    ("WARC-Date", _DATE),
                    ("WARC-Payload-Digest", f"sha1:{digest}"),
                    ("WARC-Block-Digest", "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()),
                    ("X-Page-ID", page),
                    ("Content-Type", "application/http; msgtype=response"),
                ]
                if refers is not None:
                    fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _record_id("page", refers, digest, refers_url) if known else None), ("WARC-Refers-To-Target-URI", uri(refers_url)), ("WARC-Refers-To-Date", _DATE), ("X-Refers-To-Page-ID", refers)]
                out += _members(_record(fields, block))
                place += 1
                if sum(map(len, out)) > 1 << 20 or len(out) > 1000:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])
                    out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    return run


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0) -> None:
    """``pages (page_id, url, payload binary)`` as WARC files under ``path``."""
    spark = pages.sparkSession
    known = revisits(pages, min_bytes).withColumnsRenamed({"page_id": "rid", "digest": "rdigest", "url": "rurl"})
    p = pages.withColumn("digest", base32_sha1(F.col("payload")))
    p = p.join(known, F.col("page_id").eqNullSafe(F.col("rid")) & (F.col("digest") == F.col("rdigest")) & F.col("url").eqNullSafe(F.col("rurl")), "left")
    p = p.select("page_id", "url", "payload", "digest", "refers_to", "refers_url", F.coalesce("again", F.lit(False)).alias("again"), F.coalesce("known", F.lit(False)).alias("known"))
    members = p.mapInArrow(_archive(uuid.uuid4().hex), "value binary")
    # the sink writes the bytes of a string as they are
    members.select(F.col("value").cast("string").alias("value")).write.option("lineSep", "\0").text(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    for status in files.listStatus(where):  # one file for each partition
        name = status.getPath().getName()
        if name.startswith("part-"):
            files.rename(status.getPath(), spark._jvm.org.apache.hadoop.fs.Path(path, name.removesuffix(".txt") + ".warc.gz"))


_VERSION = b"WARC/1.0\r\n"
_PAGE = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary())])


def _fields(head: bytes) -> dict[str, str]:
    """Header fields by lower-case name."""
    lines = (x.partition(b":") for x in head.split(b"\r\n"))
    return {k.strip().lower().decode("utf-8", "replace"): v.strip().decode("utf-8", "replace") for k, c, v in lines if c}


def _page(head: dict[str, str], block: bytes) -> tuple | None:
    """The row of a response, resource or revisit record; none for others."""
    kind = head.get("warc-type")
    if kind not in ("response", "resource", "revisit"):
        return None
    payload, http = block, {}
    if head.get("content-type", "").startswith("application/http"):
        top, _, payload = block.partition(b"\r\n\r\n")
        http = _fields(top)
    number = lambda x: int(x) if re.fullmatch(r"-?[0-9]+", x or "") else None
    digest = head.get("warc-payload-digest", "")
    own = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    if kind != "revisit" and digest.startswith("sha1:") and digest != f"sha1:{own}":
        raise ValueError(f"damaged record {head.get('warc-record-id')}: {digest}, but its payload has {own}")
    size = number(http.get("content-length")) if kind == "revisit" else len(payload)
    return number(head.get("x-page-id")), head.get("warc-target-uri"), kind, number(head.get("x-refers-to-page-id")), digest.removeprefix("sha1:") or own, size, None if kind == "revisit" else payload


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records from pieces between version lines, which come file by file and in order."""
    now, held, missing, head = None, [], 0, {}
    for b in batches:
        rows = []
        for piece, file in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if file != now:
                if held:
                    raise ValueError(f"{now} is cut off")
                now = file
                if not piece:
                    continue  # before the first version line
            if held:  # a version line inside of a block
                held += [_VERSION, piece]
                missing -= len(_VERSION) + len(piece)
            else:
                top, end, rest = piece.partition(b"\r\n\r\n")
                head = _fields(top)
                if not end or "content-length" not in head:
                    raise ValueError(f"{file}: a record without a whole header")
                held, missing = [rest], int(head["content-length"]) - len(rest)
            if missing <= 0:
                row = _page(head, b"".join(held)[: int(head["content-length"])])
                rows += [row] if row else []
                held = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _PAGE, strict=True)], schema=_PAGE)
    if held:
        raise ValueError(f"{now} is cut off")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """``(page_id, url, record_type, refers_to, payload_digest, payload_bytes, payload)`` of the pages in the .warc.gz files under
    ``path``; the page ids are null for archives of others."""
    pieces = spark.read.option("lineSep", _VERSION.decode()).option("pathGlobFilter", "*.warc.gz").text(path)
    pieces = pieces.select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file"))
    return pieces.mapInArrow(_parse, "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary")


def archive_round_trip(pages: DataFrame, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write ``pages`` as archives into the shared folder and read them back."""
    spark = pages.sparkSession
    src = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary").alias("payload"))
    path = scratch_dir(spark, "archives")
    write_archives(src, path, min_bytes)
    return read_archives(spark, path)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = archive_round_trip(read_table(spark, sf_dir, "pages"))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP5_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
 m AS (SELECT page_id, t, sha1(t) AS h, max(page_id) OVER (PARTITION BY t) AS r FROM p)
SELECT page_id, CAST(strlen(t) AS BIGINT) AS payload_bytes,
 array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
  CAST(((CAST('0x' || substr(h, CAST((i // 4) * 5 + 1 AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31) + 1 AS BIGINT), 1)), '') AS payload_digest,
 CASE WHEN page_id = r THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id = r THEN NULL ELSE r END AS refers_to
FROM m
"""
