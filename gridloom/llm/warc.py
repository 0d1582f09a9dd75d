"""WARC archives: written with Spark's own writer, read back by boundary-chain verification.

Each page becomes a record in a text file whose line separator is the record separator, so archives go wherever Spark can write. Of
records with equal payloads of at least MIN_REVISIT bytes the one with the smallest page_id is a response, the others are revisits
that carry the HTTP header and the payload's digest, but no payload.

Reading: every place of a file at which the magic stands is a candidate, also inside payloads; its header's length gives the offset of
its successor, if a separator stands before it. Pointer jumping from the start of the file (the table of successors is composed with
itself, so a chain of n takes log n steps) marks what can be reached: these are the records, and a magic inside a payload is not among
them. A file whose chain does not end at its end is damaged and raises an error.

Pages are written by classes of size, each class with as many records a file as keep it within FILE_BYTES; only a single page larger
than that makes a larger file. So a task holds one file of bounded size at a time.

Defined cases: a null html is an empty payload, a null url leaves its header out; control characters of a url are percent-encoded; of
repeated rows with the smallest page_id of a payload, all are responses; a null page_id is kept, as larger than any; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import folder, written

MAGIC, END = b"WARC/1.1\r\n", b"\r\n\r\n"
MIN_REVISIT = 100
FILE_BYTES = 128 << 20
#: Bounds of the size classes, in bytes of a record: 64 kB, and four times the one before.
CLASS_BYTES = [(64 << 10) << (2 * k) for k in range(8)]
HEADER_BYTES = 4 << 10
RESULT = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
_FIELD = re.compile(rb"^([A-Za-z-]+):[ \t]*(.*?)[ \t]*$", re.M)


def records(pages: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """value: each page's record without the separator at its end; bytes: how large it is at most."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html")).withColumn("n", F.octet_length("html").cast("long")).withColumn("digest", F.sha2(F.col("html").cast("binary"), 256))
    many = rows.where(F.col("n") >= min_revisit).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("k")).where("k > 1 and first is not null")
    # Written, so that both sides of the join are plain exchanges, whose large partitions are split.
    rows = rows.join(written(many.select("digest", "first"), "copies"), "digest", "left").withColumn("revisit", F.coalesce(F.col("page_id") != F.col("first"), F.col("first").isNotNull()))
    uri = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("null")), F.lit(">"))
    url = F.regexp_replace("url", r"[\x00-\x20\x7f]", "%20")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n").cast("string"), F.lit("\r\n\r\n"))
    block = F.when(F.col("revisit"), http).otherwise(F.concat(http, F.col("html")))
    header = F.concat_ws(
        "\r\n",
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(F.col("revisit"), "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), uri("page_id")),
        F.concat(F.lit("WARC-Target-URI: "), url),
        F.lit("WARC-Date: 1970-01-01T00:00:00Z"),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("digest")),
        F.when(F.col("revisit"), F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.when(F.col("revisit"), F.concat(F.lit("WARC-Refers-To: "), uri("first"))),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    )
    most = F.when(F.col("revisit"), F.lit(0)).otherwise(F.col("n")) + F.coalesce(F.octet_length(url), F.lit(0)) + HEADER_BYTES
    return rows.select(F.concat(header, F.lit("\r\n\r\n"), block).alias("value"), most.cast("long").alias("bytes"))


def write_archives(pages: DataFrame, path: str, min_revisit: int = MIN_REVISIT, file_bytes: int = FILE_BYTES) -> str:
    """Archives under the path, a folder for each class of size that has records."""
    rows = records(pages, min_revisit)
    size = F.coalesce(F.octet_length("html"), F.lit(0)) + F.coalesce(F.octet_length("url") * 3, F.lit(0)) + HEADER_BYTES
    largest = pages.select(size.alias("s")).agg(F.max("s")).first()[0] or 0
    low = -1
    for k, high in enumerate([*CLASS_BYTES, 1 << 62]):
        own = rows.where((F.col("bytes") > low) & (F.col("bytes") <= high))
        if k == 0 or low < largest:
            own.select("value").write.option("lineSep", END.decode()).option("maxRecordsPerFile", max(1, file_bytes // high)).text(f"{path}/class={k}")
        low = high
    return path


def candidates(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Offsets of the magic, and for each the offset after its record, or -1 where no record can stand."""
    at = [m.start() for m in re.finditer(re.escape(MAGIC), data)]
    after = []
    for a in at:
        head = data.find(END, a)
        length = re.search(rb"^Content-Length:[ \t]*(\d{1,18})[ \t]*\r?$", data[a:head], re.M | re.I) if head >= 0 else None
        end = head + len(END) + int(length[1]) + len(END) if length else -1
        after.append(end if end >= 0 and data[end - len(END) : end] == END and end <= len(data) else -1)
    return np.array(at, np.int64), np.array(after, np.int64)


def reachable(at: np.ndarray, after: np.ndarray, size: int) -> np.ndarray:
    """Which candidates the chain from offset 0 passes, by pointer jumping. ValueError if it does not end at the size."""
    n = len(at)
    end, lost = n, n + 1
    pos = np.searchsorted(at, after)
    to = np.where(after == size, end, np.where((pos < n) & (at[np.minimum(pos, n - 1)] == after), pos, lost)) if n else np.zeros(0, np.int64)
    jump = np.concatenate([to, [end, lost]]).astype(np.int64)
    seen = np.zeros(n + 2, bool)
    seen[0 if n and at[0] == 0 else end if not size else lost] = True
    for _ in range(max(1, n).bit_length() + 1):
        seen[jump[seen]] = True
        jump = jump[jump]
    if seen[lost] or not seen[end]:
        raise ValueError("the chain of records breaks off before the end of the archive")
    return seen[:n]


def parse(data: bytes) -> list[dict]:
    at, after = candidates(data)
    out = []
    for a, e in zip(at[keep := reachable(at, after, len(data))], after[keep]):
        head = data.index(END, a)
        fields = {k.lower().decode(): v.decode("utf-8", "replace") for k, v in _FIELD.findall(data[a:head].replace(b"\r", b""))}
        block = data[head + len(END) : e - len(END)]
        http, _, payload = block.partition(END)
        out.append(fields | {"payload": payload, "payload_length": int(re.search(rb"(?i)^content-length:[ \t]*(\d+)", http, re.M)[1])})
    return out


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """A row for each record. Of a response, length and digest are those of the payload that stands in the archive."""

    def page(uri: str | None) -> int | None:
        return None if uri is None or (own := uri.strip("<>").rpartition(":")[2]) == "null" else int(own)

    def run(batches):
        for batch in batches:
            for data in batch["content"]:
                rows = []
                for r in parse(data.as_buffer().to_pybytes()):
                    if r["warc-type"] == "response":
                        digest = hashlib.sha256(r["payload"]).hexdigest()
                        if f"sha256:{digest}" != r["warc-payload-digest"] or len(r["payload"]) != r["payload_length"]:
                            raise ValueError(f"record {r['warc-record-id']} does not match its digest")
                        rows.append((page(r["warc-record-id"]), len(r["payload"]), digest, "response", None))
                    else:
                        rows.append((page(r["warc-record-id"]), r["payload_length"], r["warc-payload-digest"].removeprefix("sha256:"), "revisit", page(r["warc-refers-to"])))
                types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true").load(path).select("content").mapInArrow(run, RESULT)


def round_trip(pages: DataFrame) -> DataFrame:
    return read_archives(pages.sparkSession, write_archives(pages, f"{folder(pages.sparkSession)}/warc"))
