"""WARC archives with an index first.

Writing: every task writes its rows as gzip members (one record each) into one archive in the shared folder and returns
index rows: file, offset, length, url, digest and record type. Equal payloads of min_bytes or more are stored once: the
record with the smallest key is the response, the others are revisit records that name it. The index is a table; only
archives that it names count, so a task that is run again leaves at most an unnamed file behind.

Reading: index rows are sorted by file and offset, near ranges are coalesced into one read each, and the members are
unpacked and checked against their length and digest.

Cases: a null payload counts as empty; a null url is written as an empty target; small payloads (under min_bytes) are
never revisits; repeated rows with one key are records of their own, and of equal smallest keys each is a response;
rows with a null key are written last in the order of keys; payloads of any length are one record; an empty table gives
an empty index.
"""

from __future__ import annotations

import hashlib
import itertools
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fairline.llm.common import new_folder, source, table

INDEX = "key long, file string, offset long, length long, url string, digest string, record_type string"
_MEMBER = {"level": 4, "wbits": 31}


def classified(pages: DataFrame, key: str = "page_id", payload: str = "html", min_bytes: int = 100) -> DataFrame:
    """key, url, payload, digest and refers_to (the smallest key with the same payload, if another; else null).

    Only digests, lengths and keys are grouped; of a hot digest each task sends one partial row, and payloads travel
    once, spread by key.
    """
    body = F.coalesce(F.col(payload), F.lit(""))
    rows = pages.select(F.col(key).alias("key"), "url", body.alias("payload"))
    firsts = (
        rows.select("key", F.sha2(F.col("payload").cast("binary"), 256).alias("digest"), F.octet_length("payload").alias("n"))
        .filter(F.col("n") >= min_bytes)
        .groupBy("digest")
        .agg(F.min("key").alias("first"), F.max("key").alias("last"), F.count("*").alias("records"))
        .filter("records > 1")
        .select("digest", "first")
    )
    small = table(firsts, "warc-firsts")
    full = rows.withColumn("digest", F.sha2(F.col("payload").cast("binary"), 256))
    # the shared digests are few against the pages: joined by Spark's own size check, beyond it by a shuffle
    return full.join(small, "digest", "left").select(
        "key", "url", "payload", "digest",
        F.when((F.octet_length("payload") >= min_bytes) & ((F.col("first") < F.col("key")) | (F.col("key").isNull() & F.col("first").isNotNull())), F.col("first")).alias("refers_to"),
    )


def _record(key, url: str | None, payload: str, digest: str, refers_to, date: str) -> bytes:
    body = payload.encode("utf-8", "surrogatepass")
    kind = "response" if refers_to is None else "revisit"
    stored = body if refers_to is None else b""
    target = re.sub(r"[\r\n]+", " ", url or "")
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{key}:{digest}')}>",
        f"WARC-Date: {date}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha256:{digest}",
        f"Content-Type: {'text/html; charset=utf-8' if refers_to is None else 'message/http'}", f"X-Page-Key: {'' if key is None else key}",
        f"X-Payload-Length: {len(body)}",
    ]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Key: {refers_to}"]
    head.append(f"Content-Length: {len(stored)}")
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + stored + b"\r\n\r\n"


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri)


def write(rows: DataFrame, folder: str, date: str = "2020-01-01T00:00:00Z") -> DataFrame:
    """Write the classified rows as archives into the folder; returns the index as a table in the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(((b, batches) for b in batches if b.num_rows), None)
        if first is None:
            return
        store, base = _filesystem(folder)
        store.create_dir(base, recursive=True)
        name = f"pages-{uuid.uuid4().hex}.warc.gz"
        at = 0
        with store.open_output_stream(f"{base}/{name}", compression=None) as out:
            for batch in itertools.chain([first[0]], first[1]):
                index = []
                for r in batch.to_pylist():
                    packer = zlib.compressobj(**_MEMBER)
                    member = packer.compress(_record(r["key"], r["url"], r["payload"], r["digest"], r["refers_to"], date)) + packer.flush()
                    out.write(member)
                    index.append((r["key"], name, at, len(member), r["url"], r["digest"], "response" if r["refers_to"] is None else "revisit"))
                    at += len(member)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*index, strict=True), (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()), strict=True)], names=names)

    names = [x.split()[0] for x in INDEX.split(", ")]
    return table(rows.mapInArrow(run, INDEX), "warc-index")


def _unpack(member: bytes) -> tuple[dict[str, str], bytes]:
    data = zlib.decompress(member, wbits=31)
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    n = int(fields["Content-Length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError("record length does not fit")
    return fields, rest[:n]


def ranges(rows: list[dict], gap: int = 64 << 10, most: int = 8 << 20) -> Iterator[list[dict]]:
    """Neighbouring records of one file (in order of offset) that one read fetches."""
    run: list[dict] = []
    for r in rows:
        if run and (r["file"] != run[0]["file"] or r["offset"] - (run[-1]["offset"] + run[-1]["length"]) > gap or r["offset"] + r["length"] - run[0]["offset"] > most):
            yield run
            run = []
        run.append(r)
    if run:
        yield run


def read(index: DataFrame, folder: str, with_payload: bool = False) -> DataFrame:
    """Read the selected index rows back: key, payload_bytes, payload_digest, record_type, refers_to (and the payload)."""
    schema = "key long, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload string" * with_payload

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _filesystem(folder)
        for batch in batches:
            for group in ranges(batch.to_pylist()):
                with store.open_input_file(f"{base}/{group[0]['file']}") as f:
                    start = group[0]["offset"]
                    data = f.read_at(group[-1]["offset"] + group[-1]["length"] - start, start)
                out = []
                for r in group:
                    fields, body = _unpack(data[r["offset"] - start : r["offset"] - start + r["length"]])
                    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
                    kind = fields["WARC-Type"]
                    if kind == "response" and (hashlib.sha256(body).hexdigest() != digest or len(body) != int(fields["X-Payload-Length"])) or digest != r["digest"]:
                        raise ValueError(f"payload of {r['key']} does not fit its digest")
                    key, refers = fields["X-Page-Key"], fields.get("X-Refers-To-Key")
                    out.append((int(key) if key else None, int(fields["X-Payload-Length"]), digest, kind, int(refers) if refers else None, body.decode("utf-8", "surrogatepass")))
                columns = list(zip(*out, strict=True))[: 6 if with_payload else 5]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()][: 6 if with_payload else 5]
    names = [x.split()[0] for x in schema.split(", ")]
    ordered = index.select("key", "file", "offset", "length", "digest").repartitionByRange("file", "offset").sortWithinPartitions("file", "offset")
    return ordered.mapInArrow(run, schema)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "warc")
    index = write(classified(source(spark, sf_dir, "pages")), folder)
    back = read(index, folder)
    return back.select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS d FROM pages),
     f AS (SELECT d, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY d)
SELECT page_id, n AS payload_bytes, p.d AS payload_digest,
       CASE WHEN n >= 100 AND first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND first < page_id THEN first END AS refers_to
FROM p LEFT JOIN f ON p.d = f.d
"""
