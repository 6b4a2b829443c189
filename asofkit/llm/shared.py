"""Shared storage, token ids and the linking of similar items, used by several operators."""

from __future__ import annotations

import functools
import os
import re
import uuid

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from asofkit.session import shared_folder

NULL_ID = -(2**63)


# Storage that all executors and the driver see.
def new_folder(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/llm-{label}-{uuid.uuid4().hex}"


def stored(frame: DataFrame, label: str) -> DataFrame:
    """Cut lineage by a table in the shared folder; a lost executor costs no recomputation."""
    spark = frame.sparkSession
    path = new_folder(spark, label)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def file_store(folder: str):
    """(file system, path) of a shared folder for tasks that write other formats than Spark's."""
    from pyarrow import fs

    if folder.startswith("file:") and not folder.startswith("file://"):
        folder = "file://" + folder[len("file:"):]
    return fs.FileSystem.from_uri(folder if "://" in folder else os.path.abspath(folder))


def write_committed(store, path: str, data: bytes) -> None:
    """Write under a temporary name, then rename: a retried task leaves the same whole file."""
    temporary = f"{path}.{uuid.uuid4().hex}.tmp"
    with store.open_output_stream(temporary) as out:
        out.write(data)
    store.move(temporary, path)


def row_key() -> list:
    """(id, sig) names a document row: the id, then a hash of its text for ids that repeat."""
    return [
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("id"),
        F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("sig"),
    ]


def packed_texts(docs: DataFrame) -> DataFrame:
    """(id, sig, packed): whole texts under zstd, for joins that must move them. A null text stays null."""
    def pack(batches):
        import pyarrow as pa
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            data = [None if t is None else squeeze.compress(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(data, pa.binary())], ["id", "sig", "packed"])

    return docs.select(*row_key(), F.col("text").cast("binary").alias("text")).mapInArrow(pack, "id long, sig long, packed binary")


def unpacker():
    """A function from packed text to UTF-8 bytes; null gives no bytes."""
    import zstandard

    spread = zstandard.ZstdDecompressor()
    return lambda data: b"" if data is None else spread.decompress(data)


# Words and their hashes.
class WordHashes(dict):
    """64-bit hash of each word, remembered; emptied when it grows past ``most`` words."""

    def __init__(self, most: int = 400_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(values: np.ndarray, seed: int = 0) -> np.ndarray:
    """A permutation of the 64-bit integers (the splitmix finaliser); each seed gives another order."""
    with np.errstate(over="ignore"):
        x = values + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) % 2**64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """One hash for each run of ``width`` consecutive words; order matters."""
    n = len(words) - width + 1
    with np.errstate(over="ignore"):
        out = np.zeros(n, np.uint64)
        for k in range(width):
            out = (out ^ words[k : k + n]) * np.uint64(0x9FB21C651E98DF25)
            out ^= out >> np.uint64(32)
    return out


# Token ids of a public byte-level vocabulary.
#: Characters on whose classes all regular-expression libraries agree.
PLAIN = re.compile(r"[\n\x20-\x7e\xa1-\xac\xae-\u024f]*")
#: White space that the vocabulary's split does not cut before its last character.
RUNS = ("  ", " \n", "\n ", "\n\n")


class TokenBytes:
    """Little-endian 32-bit ids of a text by a tokenizer file.

    Where the file's merges are numbered in their own order, its vocabulary is one of ranks, and plain
    texts are encoded by rank, which costs a third of the time and remembers nothing. Texts with characters outside ``PLAIN``
    or with runs of white space, and all texts of other files, are encoded by the tokenizer itself.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.ranks = _by_rank(path)

    def encoded(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def ids(self, texts: list[str | None]):
        """The ids of each text, in order."""
        for text in texts:
            text = text or ""
            if self.ranks is None or not PLAIN.fullmatch(text) or any(run in text for run in RUNS):
                yield from self.encoded([text])
            else:
                yield np.array(self.ranks.encode_ordinary(text), "<u4").tobytes()


def _by_rank(path: str):
    """The file's byte-level vocabulary as ranks, or None where its merges are not numbered in order or its split is another."""
    import json

    import public_tokenizers
    import tiktoken
    from tokenizers.pre_tokenizers import ByteLevel

    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    split, model = told["pre_tokenizer"] or {}, told["model"]
    own = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and not told["normalizer"]
    if not own or model["type"] != "BPE" or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix") or model.get("dropout"):
        return None
    letters = sorted(ByteLevel.alphabet())
    merged = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
    if any(model["vocab"].get(w) != len(letters) + i for i, w in enumerate(merged)):
        return None
    # A byte's letter is its own character, or, for bytes without a visible one, the next free character from 256 on.
    hidden = iter(c for c in letters if ord(c) > 255)
    values = {(chr(b) if chr(b) in letters else next(hidden)): b for b in range(256)}
    ranks = {bytes(values[c] for c in w): model["vocab"][w] for w in [*letters, *merged]}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@functools.cache
def token_bytes(path: str) -> TokenBytes:
    """One per Python worker, kept for its next tasks."""
    return TokenBytes(path)


# Filters of a fixed size.
def filter_of(frame: DataFrame, bits: int) -> bytes:
    """A bit for each hash ``h`` by its last bits, packed; the driver gets 2**bits bits at most."""
    import zstandard

    slot = F.col("h").bitwiseAND(F.lit((1 << bits) - 1).cast("long")) + 1
    rows = frame.select(slot.alias("s")).groupBy(F.bitmap_bucket_number("s").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("s")).alias("bits"))
    out = bytearray(max(1 << bits, 32768) // 8)
    for b, part in rows.collect():
        out[(b - 1) * 4096 : b * 4096] = part
    return zstandard.ZstdCompressor(level=1).compress(bytes(out))


class Filter:
    """Whether hashes may be in a set: never wrong about one that is."""

    def __init__(self, packed: bytes, bits: int):
        import zstandard

        data = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8)
        self.set = np.unpackbits(data, bitorder="little").view(bool)
        self.mask = np.uint64((1 << bits) - 1)

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        return self.set[hashes & self.mask]


# Components.
def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable, for every node of ``edges`` (a, b).

    Alternating large-star and small-star steps; every step's edges are written to the
    shared folder. A hub's neighbours meet only as partial minima.
    """
    def mark(step):
        return step.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()

    current = stored(_ordered(edges), "edges")
    seen = mark(current)
    while seen[0]:
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b"))
        large = _ordered(large)
        down = large.select(F.col("b").alias("u"), F.col("a").alias("v"))  # u is the larger end
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").select(F.explode(F.array(F.struct(F.col("u").alias("a"), F.col("m").alias("b")), F.struct(F.col("v").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        current = stored(_ordered(small), "edges")
        now = mark(current)
        if now == seen:
            break
        seen = now
    roots = current.select(F.col("b").alias("node"), F.col("a").alias("root"))
    return roots.unionByName(current.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())


def _ordered(edges: DataFrame) -> DataFrame:
    return edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def link(entries, refine, verify, dense: int = 64, first: int | None = None, blocks=None) -> DataFrame:
    """Components (node, root) of the links among nodes that share a key.

    ``entries(level, kept)`` gives (key, node, idx, prb) with one row per key and node: level 0
    of all nodes, deeper ones of the (key, node) rows in ``kept``, with narrower keys; ``refine`` is
    the number of deeper levels. A link needs a key that one node has as idx and the other
    as prb. ``verify`` keeps the true links of pairs (a, b, shared), in either order of a and b; ``shared`` is null, or the pair shares
    at most so many keys of level 0. A node is b in a bounded number of pairs for each of its keys, but may be a in any number.

    A key's members are paired only while that makes at most ``dense`` pairs for each of them, counting pairs of
    different components only. Larger keys first compare each member with the smallest and the largest one, then
    with two others picked by hash, which leaves a group of similar members in one component. Those with
    members in different components after that get narrower keys on the next level, however few they are. Where
    ``blocks`` is given, it gets those (key, node) rows instead, and its pairs (a, b) of one component end the search.
    """
    roots = None
    level, kept = 0, None

    def joined(paired, stars=None):
        nonlocal roots
        pairs = paired.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "shared")
        if stars is not None:
            # A star's centre is a, so what is dealt by b stays even however large the star is.
            unknown = stars.filter("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b")).distinct()
            unknown = unknown.withColumn("shared", F.lit(None).cast("long"))
            pairs = pairs.unionByName(unknown)
        found = stored(verify(pairs), "links")
        if roots is None:
            roots = stored(components(found), "roots")
        elif not found.isEmpty():
            roots = stored(_contracted(found, roots), "roots")

    while True:
        rows = entries(level, kept)
        both = rows.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi"), F.count(F.lit(1)).alias("n"), F.max("idx").alias("i"), F.max("prb").alias("p"))
        shared = both.filter("lo < hi AND i AND p").drop("i", "p")
        kept = stored(rows.join(shared, "key"), "shared")
        near = _across(kept, roots)
        if level == refine and not blocks:
            joined(_pairs(near, near.limit(0), False))
            return roots
        few = F.col("open") <= (first or dense)
        many = near.filter(~few)
        joined(_pairs(near.filter(few), many, level == 0), many.select(F.col("node").alias("a"), F.explode(F.array("lo", "hi")).alias("b")))
        large = stored(many.select("key", "node", "idx", "prb", "lo", "hi", "n"), "large")
        if large.isEmpty():
            return roots
        near = _across(large, roots)
        many = near.filter(F.col("open") > dense)
        picks = many.groupBy("key").agg(*[F.min(F.xxhash64("node", F.lit(k))).alias(f"m{k}") for k in (1, 2)])
        picked = many.join(picks, "key").filter((F.xxhash64("node", F.lit(1)) == F.col("m1")) | (F.xxhash64("node", F.lit(2)) == F.col("m2")))
        stars = many.select("key", F.col("node").alias("a")).join(picked.select("key", F.col("node").alias("b")), "key").select("a", "b")
        joined(_pairs(near.filter(F.col("open") <= dense), many, False), stars)
        kept = stored(_across(many.select("key", "node"), roots).select("key", "node").distinct(), "large")
        if kept.isEmpty():
            return roots
        if blocks:
            found = stored(blocks(kept), "links")
            return roots if found.isEmpty() else stored(_contracted(found, roots), "roots")
        level += 1


def _contracted(found: DataFrame, roots: DataFrame) -> DataFrame:
    """Roots after new links: only the edges between the components they join are solved."""
    edges = found.select("a", "b")
    for side in ("a", "b"):
        edges = edges.join(roots.select(F.col("node").alias(side), F.col("root").alias(f"{side}r")), side, "left")
    edges = edges.select(F.coalesce("ar", "a").alias("a"), F.coalesce("br", "b").alias("b"))
    moved = stored(components(edges), "moved")
    # A node that had no link yet stands among the moved ones alone.
    every = roots.unionByName(moved.select("node", F.col("node").alias("root")).join(roots.select("node"), "node", "left_anti"))
    return every.join(moved.select(F.col("node").alias("root"), F.col("root").alias("to")), "root", "left").select("node", F.coalesce("to", "root").alias("root"))


def _pairs(rows: DataFrame, rest: DataFrame, known: bool) -> DataFrame:
    """Pairs (a, b, shared) of different components within a key, one as idx, the other as prb.

    Where known, shared is the number of keys in which the pair was found, and those of ``rest`` that both could have.
    """
    a = rows.filter("idx").select("key", F.col("node").alias("a"), F.col("root").alias("ra"))
    b = rows.filter("prb").select("key", F.col("node").alias("b"), F.col("root").alias("rb"), F.col("idx").alias("ib"))
    each = a.join(b, "key").filter("a <> b AND ra <> rb AND (NOT ib OR a < b)").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    pairs = each.groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"))
    if not known:
        return pairs.withColumn("shared", F.lit(None).cast("long"))
    more = rest.groupBy("node").agg(F.count(F.lit(1)).alias("more"))
    for side in ("a", "b"):
        pairs = pairs.join(more.select(F.col("node").alias(side), F.col("more").alias(f"more_{side}")), side, "left")
    slack = F.least(F.coalesce("more_a", F.lit(0)), F.coalesce("more_b", F.lit(0)))
    return pairs.select("a", "b", (F.col("shared") + slack).alias("shared"))


def _across(kept: DataFrame, roots: DataFrame | None) -> DataFrame:
    """The rows of keys whose nodes are not in one component, with ``open``: pairs across components for each node."""
    rows = kept.withColumn("root", F.col("node"))
    if roots is not None:
        rows = kept.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    sizes = rows.groupBy("key", "root").agg(F.count(F.lit(1)).cast("double").alias("m"))
    spread = sizes.groupBy("key").agg(((F.sum("m") * F.sum("m") - F.sum(F.col("m") * F.col("m"))) / 2 / F.sum("m")).alias("open"))
    return rows.join(spread.filter("open > 0"), "key")
