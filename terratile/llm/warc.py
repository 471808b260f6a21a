"""WARC archives: a writer and a splittable reader.

Writer: each record is a gzip member of its own.  Of records with equal
payloads of at least ``min_bytes`` bytes, that with the largest page_id is a
``response`` and the others are ``revisit`` records that refer to it; smaller
payloads are always ``response``.  Digests, not payloads, are grouped; the
answer comes back by a join on the digest that adaptive execution can split
where one payload is very frequent.

Reader: a task takes a byte range of a file, looks for the gzip magic, and
takes a candidate for a member if its first bytes decode to a WARC version
line.  It owns every record whose member starts inside its range and reads past
the range's end to finish the last one, so each record is read once whatever
the ranges.

Nulls: a null html is an empty payload; a null url or page_id leaves its header
out and comes back null, and counts as smaller than any other page_id.  Rows
that repeat the largest page_id of a payload are all responses; those of them
that also repeat its url are equal records with one id, to which the revisits
refer.  A record that is cut off ends the job with its place.  An empty table
gives no file and no row.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terratile.storage import AtomicFile, broadcast_if_small, open_fs, shared_dir, stage_table

MAGIC = b"\x1f\x8b\x08"
STEP = 1 << 16
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
RECORD = "record_type string, page_id long, url string, refers_to long, payload_sha1 string, payload_bytes long, payload binary"


def record_id(*of: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, ' '.join(map(str, of)))}>"


def record(page_id: int | None, url: str | None, payload: bytes, sha1: str, own_id: str, refers_to: int | None = None, refers_id: str | None = None) -> bytes:
    """One gzip member holding one record; with ``refers_id`` a revisit."""
    block = HTTP if refers_id else HTTP + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if refers_id else 'response'}",
        f"WARC-Record-ID: {own_id}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(sha1)).decode()}",
        "Content-Type: application/http; msgtype=response",
        f"X-Payload-Length: {len(payload)}",
    ]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A"))
    if refers_id:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {refers_id}"]
        if refers_to is not None:
            head.append(f"X-Refers-To-Page: {refers_to}")
    head.append(f"Content-Length: {len(block)}")
    data = "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    squeeze = zlib.compressobj(4, zlib.DEFLATED, 31)
    return squeeze.compress(data) + squeeze.flush()


def _number(text: str | None) -> int | None:
    return int(text) if text is not None and text.strip().isdecimal() else None


def _sha1(digest: str | None) -> str | None:
    """Bare hex of a ``sha1:`` digest in base 32 or hex; None for any other."""
    kind, _, value = (digest or "").strip().partition(":")
    if kind.lower() != "sha1":
        return None
    try:
        return (bytes.fromhex(value) if len(value) == 40 else base64.b32decode(value.upper())).hex()
    except ValueError:
        return None


def parse(data: bytes) -> tuple:
    """The values of RECORD of one decoded member, of this writer or another's.

    Header names are taken in any case.  What a record does not say is null: page
    ids and references of other writers, the length and digest of a revisit
    without them.  Without a length the block ends where the member does.
    """
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])
    fields = {name.strip().lower(): value.strip(" \t") for name, _, value in lines}
    length = _number(fields.get("content-length"))
    block = rest if length is None else rest[:length]
    http = fields.get("content-type", "").lower().startswith("application/http")
    payload = block.partition(b"\r\n\r\n")[2] if http else block
    kind, url, page = fields.get("warc-type", "").lower(), fields.get("warc-target-uri"), fields.get("x-page-id")
    if url is not None and "x-payload-length" in fields:
        url = url.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")
    if kind == "revisit":
        sha1, size, payload = _sha1(fields.get("warc-payload-digest")), _number(fields.get("x-payload-length")), None
    else:
        sha1, size = hashlib.sha1(payload).hexdigest(), len(payload)
    refers = fields.get("x-refers-to-page")
    return kind, page and int(page), url, refers and int(refers), sha1, size, payload


def _member(read, at: int) -> tuple[bytes, int] | None:
    """(decoded bytes, end) of the member at ``at``; None if no WARC member starts there."""
    inflate, out, pos = zlib.decompressobj(31), b"", at
    pieces: list[bytes] = []
    while not inflate.eof:
        data = read(pos, STEP)
        if not data:
            if b"".join(pieces).startswith(b"WARC/1."):
                raise EOFError(f"the record at byte {at} is cut off")
            return None
        pos += len(data)
        try:
            pieces.append(inflate.decompress(data))
        except zlib.error:
            return None
        if out is not None:
            out += pieces[-1]
            if len(out) >= 7:
                if not out.startswith(b"WARC/1."):
                    return None
                out = None
    return b"".join(pieces), pos - len(inflate.unused_data)


def read_range(read, start: int, end: int) -> Iterator[tuple]:
    """Records whose members start in [start, end); ``read(at, n)`` gives bytes of the file."""
    at = start
    while at < end:
        window = read(at, min(STEP, end - at) + len(MAGIC) - 1)
        hit = window.find(MAGIC)
        if hit < 0:
            at += max(1, len(window) - len(MAGIC) + 1)
            continue
        at += hit
        if at >= end:
            return
        if (found := _member(read, at)) is None:
            at += 1
        else:
            yield parse(found[0])
            at = found[1]


def write_warc(pages: DataFrame, folder: str, min_bytes: int = 1000) -> DataFrame:
    """Write page_id, url, html as archives; (path, n_records) of each file from the manifest."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        path, n, rows = f"{folder}/part-{TaskContext.get().partitionId():06d}.warc.gz", 0, next(batches, None)
        if rows is None:
            return
        with AtomicFile(path) as out:
            while rows is not None:
                for k, r in enumerate(rows.itertuples(index=False), n):
                    page, first = (None if pd.isna(x) else int(x) for x in (r.page_id, r.first_id))
                    answer = record_id(first, r.first_url, r.sha1)
                    own = answer if r.shared and not r.revisit and r.url == r.first_url else record_id(path, k)
                    out.write(record(page, r.url, bytes(r.payload), r.sha1, own, *((first, answer) if r.revisit else ())))
                n += len(rows)
                rows = next(batches, None)
        yield pd.DataFrame({"path": [path], "n_records": [n]})

    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumn("sha1", F.sha1("payload"))
    large = rows.where(F.octet_length("payload") >= min_bytes)
    shared = large.groupBy("sha1").agg(F.max(F.struct("page_id", "url")).alias("first"), F.count("*").alias("n")).where("n > 1")
    shared = shared.select("sha1", F.col("first.page_id").alias("first_id"), F.col("first.url").alias("first_url"), F.lit(True).alias("shared"))
    # counted: the payloads stay where they are unless the shared digests are too many for a broadcast
    shared = broadcast_if_small(stage_table(shared, "shared_digests"), 200)
    joined = rows.join(shared, "sha1", "left").withColumn("shared", F.coalesce("shared", F.lit(False)))
    joined = joined.withColumn("revisit", F.col("shared") & ~F.col("page_id").eqNullSafe(F.col("first_id")))
    as_text = joined.withColumns({c: F.col(c).cast("string") for c in ("page_id", "first_id")})
    return stage_table(as_text.mapInPandas(write, "path string, n_records long"), "manifest")


def read_warc(spark: SparkSession, folder: str, split_bytes: int = 8 << 20) -> DataFrame:
    """The records (columns RECORD) of the ``*.warc.gz`` files in a folder."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split(" ")[0] for x in RECORD.split(", ")]

        def frame(rows: list) -> pd.DataFrame:
            out = pd.DataFrame(rows, columns=names)
            return out.astype({"page_id": "Int64", "refers_to": "Int64", "payload_bytes": "Int64"})

        for splits in batches:
            for path, start, end in splits[["path", "start", "end"]].itertuples(index=False):
                fs, name = open_fs(path)
                with fs.open_input_file(name) as data:
                    rows, size = [], 0
                    for row in read_range(lambda at, n: data.read_at(n, at), int(start), int(end)):
                        rows.append(row)
                        size += row[5] or 0
                        if size > 16 << 20:
                            yield frame(rows)
                            rows, size = [], 0
                    yield frame(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder).select("path", "length")
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(split_bytes).cast("long")))
    splits = files.select("path", "length", starts.alias("start"))
    splits = splits.select("path", "start", F.least(F.col("start") + split_bytes, "length").alias("end"))
    return splits.repartition(max(1, splits.count()), "path", "start").mapInPandas(read, RECORD)


def archived(pages: DataFrame, min_bytes: int = 1000) -> DataFrame:
    """Write ``pages`` as archives in the shared folder and read back their records."""
    spark = pages.sparkSession
    folder = shared_dir(spark, "warc")
    if write_warc(pages, folder, min_bytes).isEmpty():
        return spark.createDataFrame([], RECORD)
    return read_warc(spark, folder)
