"""Token counts: documents found in flat, unindexed token files by their separators.

A token file is nothing but little-endian 16-bit ids; ``EOD`` ends each document. Files are cut into blocks of a
fixed number of tokens whatever lies at their borders. A task reads one block, finds all separators in one
vectorised comparison, and reports the documents that begin and end inside it, its tokens before the first separator
and those after the last. A prefix scan over a file's blocks then stitches: what is left open runs on through blocks
without a separator until the next one closes it. Tokens behind a file's last separator are a document that
was not ended.

The writer that makes such files from a table puts the document id in front of each document as five
ids of ``ID_BASE`` and more, which no vocabulary id reaches; they are not counted. Null and empty texts are documents of
no tokens; a null id comes back as null, repeated rows as rows of their own. An empty table makes no
file and gives no rows. Only doc_id and text are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from asofkit.llm.shared import file_store, new_folder, stored, token_bytes, write_committed

EOD = 50256
ID_BASE = 57344  # 13 bits of the document id in each of five ids from here on
ID_IDS = 5
FILE_TOKENS = 8_000_000
BLOCK_TOKENS = 1_000_000


def _header(doc: int | None) -> np.ndarray:
    """Five ids; a null is one more than the largest id."""
    value = 2**64 if doc is None else doc + 2**63
    return np.array([ID_BASE + (value >> 13 * k & 8191) for k in range(ID_IDS)], "<u2")


def write_tokens(docs: DataFrame, folder: str, tokenizer: str) -> DataFrame:
    """(path, tokens) of the files written under the folder, each once whole, by a name of its own."""
    from uuid import uuid4

    def write(batches):
        store, base = file_store(folder)
        store.create_dir(base, recursive=True)
        vocabulary, parts, held = token_bytes(tokenizer), [], 0

        def flush():
            name = f"{uuid4().hex}.u16"
            write_committed(store, f"{base}/{name}", b"".join(parts))
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([held], pa.int64())], ["path", "tokens"])

        for batch in batches:
            for doc, ids in zip(batch.column(0).to_pylist(), vocabulary.ids(batch.column(1).to_pylist()), strict=True):
                parts += [_header(doc).tobytes(), np.frombuffer(ids, "<u4").astype("<u2").tobytes(), np.array([EOD], "<u2").tobytes()]
                held += len(ids) // 4 + ID_IDS + 1
                if held >= FILE_TOKENS:
                    yield flush()
                    parts, held = [], 0
        if held:
            yield flush()

    # What is stored here is the manifest: files of lost attempts are not in it.
    return stored(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(write, "path string, tokens long"), "manifest")


def scan(files: DataFrame, folder: str, eod: int = EOD, block: int = BLOCK_TOKENS, keep: int = ID_IDS) -> DataFrame:
    """(path, ordinal, n_tokens, first, ended) of each document of flat files (path, tokens) in a folder.

    ``first`` is the document's first ``keep`` ids, which may lie in several blocks.
    """
    blocks = files.select("path", "tokens", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("tokens") - 1) / block))).alias("block"))

    def find(batches):
        store, base = file_store(folder)
        for batch in batches:
            rows = []
            for path, tokens, b in zip(*(batch.column(c).to_pylist() for c in ("path", "tokens", "block")), strict=True):
                n = min(block, tokens - b * block)
                with store.open_input_file(f"{base}/{path}") as f:
                    f.seek(2 * b * block)
                    ids = np.frombuffer(f.read(2 * n), "<u2")
                ends = np.flatnonzero(ids == eod)
                # Each document's first ids, as far as they lie in this block; the run into the block comes first.
                starts = np.append(0, ends + 1)
                stops = np.append(ends, n)
                firsts = [ids[s : min(s + keep, e)].tolist() for s, e in zip(starts.tolist(), stops.tolist(), strict=True)]
                rows.append((path, b, n, (stops - starts).tolist(), firsts))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            types = [pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["path", "block", "tokens", "sizes", "firsts"])

    schema = "path string, block long, tokens long, sizes array<long>, firsts array<array<int>>"
    found = stored(blocks.mapInArrow(find, schema), "blocks")
    # Piece k of a block belongs to the document with as many separators before it as the file has up to there.
    by_file = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = found.select("path", "block", (F.size("sizes") - 1).alias("n")).withColumn("before", F.coalesce(F.sum("n").over(by_file), F.lit(0))).select("path", "block", "before")
    ended = found.groupBy("path").agg(F.sum(F.size("sizes") - 1).alias("documents"))
    pieces = found.join(before, ["path", "block"]).select("path", "block", "before", F.posexplode(F.arrays_zip("sizes", "firsts")).alias("k", "piece"))
    pieces = pieces.select("path", "block", (F.col("before") + F.col("k")).alias("ordinal"), F.col("piece.sizes").alias("size"), F.col("piece.firsts").alias("first"))
    whole = pieces.groupBy("path", "ordinal").agg(
        F.sum("size").alias("n_tokens"),
        # Only pieces up to the first full one can hold the first ids; runs inside a document end in a full piece.
        F.slice(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("block", "first"))), lambda p: p["first"])), 1, keep).alias("first"),
    )
    out = whole.join(ended, "path").withColumn("ended", F.col("ordinal") < F.col("documents"))
    return out.filter("ended OR n_tokens > 0").drop("documents")


def token_counts(docs: DataFrame, tokenizer: str, folder: str | None = None, block: int = BLOCK_TOKENS) -> DataFrame:
    """(doc_id, n_tokens): documents written as flat files and found again in them."""
    folder = folder or new_folder(docs.sparkSession, "tokens")
    found = scan(write_tokens(docs, folder, tokenizer), folder, block=block)
    digits = [(F.get("first", F.lit(k)).cast("decimal(38,0)") - ID_BASE) * 8192**k for k in range(ID_IDS)]
    value = digits[0]
    for d in digits[1:]:
        value = value + d
    doc = F.when(value < F.lit(str(2**64)).cast("decimal(38,0)"), (value - F.lit(str(2**63)).cast("decimal(38,0)")).cast("long"))
    return found.select(doc.alias("doc_id"), (F.col("n_tokens") - ID_IDS).alias("n_tokens"))


def query(spark, folder: str) -> DataFrame:
    import public_tokenizers

    return token_counts(spark.read.parquet(f"{folder}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
