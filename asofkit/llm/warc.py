"""WARC: a deterministic sharded writer with revisit records, and a reader.

Records are cut into shards by ranges of page_id found from an exact histogram of the table (page counts in up to
``CELLS`` equal parts of the id range, a table of that size), so shards depend on the rows alone and not on how they are partitioned.
Each shard is sorted, its headers and digests are made anew, and its records are gzip members in files that roll when
``roll`` compressed bytes are reached. A file is written under a temporary name and renamed; then its
manifest is, and readers open only what manifests list.

Of rows with equal payloads of ``REVISIT_FROM`` bytes or more, those with the largest page_id are response records
and the others revisit it, without a payload; smaller payloads are always responses. A null html is an empty
payload, a null url an empty one. A null page_id comes first and is never the largest. Rows that repeat an id and payload become records of their
own. An empty table makes no file and gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from asofkit.llm.shared import file_store, new_folder, stored, write_committed

REVISIT_FROM = 1000
CELLS = 16384
SHARD_ROWS = 500
ROLL = 4_000_000
DATE = "2024-01-01T00:00:00Z"  # one date for all, so that reruns give equal bytes
LEAST = -(2**63)


def prepared(pages: DataFrame) -> DataFrame:
    """(id, page_id, url, payload, digest, size)."""
    payload = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select(F.coalesce(F.col("page_id").cast("long"), F.lit(LEAST)).alias("id"), "page_id", "url", payload.alias("payload"))
    return rows.withColumn("digest", F.sha1("payload")).withColumn("size", F.octet_length("payload").cast("long"))


def shards(rows: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Rows with their shard, found from the histogram of all ids: at most CELLS counts reach the driver."""
    spark = rows.sparkSession
    ids = rows.select("id").filter(F.col("id") > LEAST)
    low, high, n = ids.agg(F.min("id"), F.max("id"), F.count(F.lit(1))).first()
    if not n:
        return rows.withColumn("shard", F.lit(0))
    width = -(-(high - low + 1) // CELLS)
    behind = F.col("id").cast("decimal(38,0)") - F.lit(str(low)).cast("decimal(38,0)")
    cell = F.when(F.col("id") > LEAST, F.floor(behind / width).cast("int"))
    counts = np.zeros(CELLS, np.int64)
    for r in ids.groupBy(cell.alias("cell")).agg(F.count(F.lit(1)).alias("n")).collect():
        counts[r["cell"]] = r["n"]
    parts = max(1, min(CELLS, -(-n // shard_rows)))
    shard = (np.cumsum(counts) - counts) * parts // n
    table = spark.createDataFrame([(int(c), int(shard[c])) for c in np.flatnonzero(counts)], "cell int, shard int")
    return rows.withColumn("cell", cell).join(F.broadcast(table), "cell", "left").withColumn("shard", F.coalesce("shard", F.lit(0))).drop("cell")


def originals(rows: DataFrame, least: int = REVISIT_FROM) -> DataFrame:
    """(id, digest, refers_to) of the rows that revisit another one: sums per payload first, so copies combine early."""
    large = rows.filter(F.col("size") >= least).select("id", "digest")
    top = large.groupBy("digest").agg(F.max("id").alias("refers_to"), F.min("id").alias("low")).filter("low < refers_to").drop("low")
    return large.distinct().join(top, "digest").filter("id < refers_to").select("id", "digest", "refers_to")


def _record(page, url, digest: str, size: int, payload: bytes | None, refers_to) -> bytes:
    kind = "revisit" if payload is None else "response"
    name = hashlib.sha1(f"{page}/{url}/{digest}".encode("utf-8", "surrogatepass")).hexdigest()
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{name[:8]}-{name[8:12]}-{name[12:16]}-{name[16:20]}-{name[20:32]}>",
        f"WARC-Date: {DATE}", f"WARC-Target-URI: {json.dumps(url)[1:-1] if url is not None else ''}", f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Page-ID: {'' if page is None else page}", f"WARC-Payload-Length: {size}",
    ]
    if payload is None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To-Page: {refers_to}"]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload or b"")
    head += ["Content-Type: application/http; msgtype=response", f"WARC-Block-Digest: sha1:{hashlib.sha1(block).hexdigest()}", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write(pages: DataFrame, folder: str, roll: int = ROLL, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(path, records, bytes, sha1) of the files written: shard number, then file number within the shard."""
    rows = prepared(pages)
    # Marks of revisits and pages travel once, to the same shard; a mark comes right before its pages.
    marks = originals(rows).withColumn("mark", F.lit(0))
    both = shards(rows.withColumn("mark", F.lit(1)).unionByName(marks, allowMissingColumns=True), shard_rows)
    parts = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = both.repartition(parts, "shard").sortWithinPartitions("shard", "id", "digest", "mark", "url")

    def save(batches):
        store, base = file_store(folder)
        store.create_dir(base, recursive=True)
        buffer, state, out = io.BytesIO(), {"shard": None, "file": 0, "records": 0}, []

        def close():
            if state["records"]:
                name = f"pages-{state['shard']:05d}-{state['file']:05d}.warc.gz"
                data = buffer.getvalue()
                write_committed(store, f"{base}/{name}", data)
                entry = (name, state["records"], len(data), hashlib.sha1(data).hexdigest())
                write_committed(store, f"{base}/{name}.manifest.json", json.dumps(dict(zip(("path", "records", "bytes", "sha1"), entry, strict=True))).encode())
                out.append(entry)
                state["file"] += 1
                state["records"] = 0
            buffer.seek(0)
            buffer.truncate()

        marked = None
        for batch in batches:
            for shard, key, page, url, payload, digest, size, refers_to, mark in zip(*(batch.column(c).to_pylist() for c in ("shard", "id", "page_id", "url", "payload", "digest", "size", "refers_to", "mark")), strict=True):
                if shard != state["shard"]:
                    close()
                    state.update(shard=shard, file=0)
                if not mark:
                    marked = (key, digest, refers_to)
                    continue
                to = marked[2] if marked and marked[:2] == (key, digest) else None
                buffer.write(gzip.compress(_record(page, url, digest, size, payload if to is None else None, to), 6, mtime=0))
                state["records"] += 1
                if buffer.tell() >= roll:
                    close()
        close()
        columns = list(zip(*out, strict=True)) if out else [[]] * 4
        types = [pa.string(), pa.int64(), pa.int64(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["path", "records", "bytes", "sha1"])

    return stored(spread.mapInArrow(save, "path string, records long, bytes long, sha1 string"), "manifest")


def read(manifest: DataFrame, folder: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, url, payload) from the archives alone.

    Digests and lengths of responses are those of the payload read; a file or payload that does not
    match its digest is an error.
    """
    def load(batches):
        store, base = file_store(folder)
        for batch in batches:
            for path, sha1 in zip(batch.column("path").to_pylist(), batch.column("sha1").to_pylist(), strict=True):
                with store.open_input_file(f"{base}/{path}") as f:
                    data = f.read()
                if hashlib.sha1(data).hexdigest() != sha1:
                    raise ValueError(f"{path} is not what its manifest says")
                stream, out = gzip.GzipFile(fileobj=io.BytesIO(data)), []
                while line := stream.readline():
                    if line.strip() != b"WARC/1.1":
                        raise ValueError(f"{path}: no record where one is due")
                    head = {}
                    while (line := stream.readline().strip()) != b"":
                        name, _, value = line.decode().partition(":")
                        head[name] = value.strip()
                    block = stream.read(int(head["Content-Length"]))
                    stream.read(4)
                    page = int(head["WARC-Page-ID"]) if head["WARC-Page-ID"] else None
                    digest, size, payload, to = head["WARC-Payload-Digest"].removeprefix("sha1:"), int(head["WARC-Payload-Length"]), None, None
                    if head["WARC-Type"] == "response":
                        payload = block[block.index(b"\r\n\r\n") + 4 :]
                        if hashlib.sha1(payload).hexdigest() != digest or len(payload) != size:
                            raise ValueError(f"{path}: a payload is not what its header says")
                    else:
                        to = int(head["WARC-Refers-To-Page"])
                    out.append((page, size, digest, head["WARC-Type"], to, json.loads(f'"{head["WARC-Target-URI"]}"'), payload))
                    if len(out) >= 500:
                        yield _read_rows(out)
                        out = []
                yield _read_rows(out)

    files = manifest.select("path", "sha1")
    return files.repartition(int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")), "path").mapInArrow(load, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary")


def _read_rows(out: list) -> pa.RecordBatch:
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
    columns = list(zip(*out, strict=True)) if out else [[]] * 7
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


SQL = """
WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
t AS (SELECT payload_digest, max(page_id) AS top FROM p GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id < top THEN top END AS refers_to
FROM p JOIN t USING (payload_digest)
"""


def query(spark, folder: str) -> DataFrame:
    to = new_folder(spark, "warc")
    return read(write(spark.read.parquet(f"{folder}/pages.parquet"), to), to).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
