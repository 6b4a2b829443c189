"""Line dedup: a segment-partition edit join over the distinct lines of all documents.

A line is compared without its outer ASCII white space. Lines of ``SHORTEST`` characters or more link when
their edit distance (characters) is at most ``tau``; a class is a component of links. A line goes if its class has an
earlier one: smaller document, then smaller place. Shorter lines link with equal ones only, since one edit would make
another word of them; the query and the stage take them from one character on, ``repeats`` from ``least``.
Lines without characters stay. Lines end at ``\\n`` only.

Each line is cut into tau + 1 segments, one of which any line within tau edits holds
unchanged. Segments are indexed with the line's length; other lines probe with the substrings that
can still meet them (multi-match-aware windows). A key that very many lines share is narrowed by the
same scheme inside the longer of its two unmatched sides, whose share of the edits is known.
Candidates are verified by a banded bit-parallel distance of 64-bit words.

Lines are named by 64-bit hashes: of 10^9 distinct lines, none would be expected to share one.
Null and empty texts have nothing to remove. A null id comes before all others; rows with one id are
ordered by the hash of their texts, and rows equal in both are one document with equal answers. An empty table
gives no rows. Input columns other than doc_id and text pass through the stage untouched.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from asofkit.llm.shared import link, packed_texts, row_key, stored, unpacker

TAU = 1
SHORTEST = 24
SPACE = " \t\n\x0b\f\r"
WORD = (1 << 64) - 1


# The segment scheme.
def segments(length: int, parts: int) -> list[tuple[int, int]]:
    """(start, size) of nearly equal parts; the last ones take the rest."""
    size, rest = divmod(length, parts)
    out, at = [], 0
    for i in range(parts):
        k = size + (i >= parts - rest)
        out.append((at, k))
        at += k
    return out


def probes(n: int, length: int, tau: int):
    """(i, start, size): the substrings of a string of n characters that can meet segment i of one of ``length``."""
    for i, (p, k) in enumerate(segments(length, tau + 1)):
        shift = n - length
        low = max(0, p - i, p + shift - (tau - i))
        for at in range(low, min(n - k, p + i, p + shift + tau - i) + 1):
            yield i, at, k


def _hash(text: str, seed: int) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"), seed * 0x9E3779B97F4A7C15 % 2**64)


def signatures(line: str, tau: int) -> list[tuple]:
    """(key, i, start, size, length, idx, prb): idx as the shorter line of a pair, prb as the longer one."""
    n = len(line)
    out = []
    for length in range(max(1, n - tau), n + 1):
        own = segments(n, tau + 1) if length == n else None
        for i, at, k in probes(n, length, tau):
            out.append((_hash(line[at : at + k], length * 64 + i), i, at, k, length, own is not None and own[i] == (at, k), True))
    return out


def narrowed(line: str, signature: tuple, tau: int) -> list[tuple]:
    """(key, idx, prb) inside the longer unmatched side, seen from the indexed line."""
    key, i, at, k, length, idx, prb = signature
    p, _ = segments(length, tau + 1)[i]
    right = length - p - k >= p
    side, size, budget = (line[at + k :], length - p - k, tau - i) if right else (line[:at], p, i)
    out = []
    if abs(len(side) - size) <= budget:
        own = segments(size, budget + 1)
        for j, start, m in probes(len(side), size, budget):
            out.append((_hash(side[start : start + m], key + j + 1), idx and own[j] == (start, m), prb))
    return out


def within(a: str, b: str, tau: int) -> bool:
    """Whether the edit distance is at most tau (up to 31), by a band of bits around the diagonal."""
    if abs(len(a) - len(b)) > tau:
        return False
    if a == b:
        return True
    if not tau:
        return False
    if len(a) < len(b):
        a, b = b, a
    k = 0
    most = len(b)
    while k < most and a[k] == b[k]:
        k += 1
    a, b = a[k:], b[k:]
    k = 0
    most = len(b)
    while k < most and a[-1 - k] == b[-1 - k]:
        k += 1
    a, b = a[: len(a) - k], b[: len(b) - k]
    if not b:
        return len(a) <= tau
    at: dict[str, int] = {}
    for r, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << r
    return _banded(a, b, at, tau)


def _banded(a: str, b: str, at: dict[str, int], tau: int) -> bool:
    # Distances along the band: VP and VN hold the vertical differences, D0 whether a diagonal step costs nothing.
    vp, vn, score = (WORD << (64 - tau - 1)) & WORD, 0, tau
    start, last = tau + 1 - 64, 1 << 63
    bottom = 1 << 62
    n, m = len(a), len(b)
    for j in range(m):
        bits = at.get(b[j], 0)
        pm = ((bits >> start) if start >= 0 else (bits << -start)) & WORD
        d0 = ((((pm & vp) + vp) ^ vp) | pm | vn) & WORD
        hp = (vn | ~(d0 | vp)) & WORD
        hn = d0 & vp
        if j < n - tau:
            score += not d0 & last
        else:
            score += bool(hp & bottom)
            score -= bool(hn & bottom)
            bottom >>= 1
        if score > 2 * tau + m - n + tau:
            return False
        x = d0 >> 1
        vp = (hn | ~(x | hp)) & WORD
        vn = x & hp
        start += 1
    return score <= tau


# The join.
def lines_of(text: bytes) -> list[str]:
    return [x.strip(SPACE) for x in text.decode("utf-8", "surrogatepass").split("\n")]


def _node(line: str) -> int:
    return xxhash.xxh3_64_intdigest(line.encode("utf-8", "surrogatepass"))


def _longs(values) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view("i8"))


def occurrences(docs: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """(id, sig, pos, node) of every line that is long enough."""
    def scan(batches):
        for batch in batches:
            keys, sigs, places, nodes = [], [], [], []
            for key, sig, text in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                for pos, line in enumerate(lines_of(text)):
                    if len(line) >= shortest:
                        keys.append(key)
                        sigs.append(sig)
                        places.append(pos)
                        nodes.append(_node(line))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(sigs, pa.int64()), pa.array(places, pa.int32()), _longs(nodes)], ["id", "sig", "pos", "node"])

    source = docs.filter("text IS NOT NULL").select(*row_key(), F.col("text").cast("binary"))
    return source.mapInArrow(scan, "id long, sig long, pos int, node long")


def _key_rows(rows: list[tuple]) -> pa.RecordBatch:
    keys, nodes, idx, prb = zip(*rows, strict=True) if rows else [[]] * 4
    return pa.RecordBatch.from_arrays([_longs(keys), _longs(nodes), pa.array(idx, pa.bool_()), pa.array(prb, pa.bool_())], ["key", "node", "idx", "prb"])


def line_classes(docs: DataFrame, seen: DataFrame, tau: int = TAU, shortest: int = SHORTEST) -> DataFrame:
    """(node, root) of the distinct lines that link with another one; ``seen`` is occurrences(docs)."""
    schema = "key long, node long, idx boolean, prb boolean"

    def keys(batches):
        for batch in batches:
            done, out = set(), []
            for text in batch.column(0).to_pylist():
                for line in lines_of(text):
                    if len(line) >= shortest and (node := _node(line)) not in done:
                        done.add(node)
                        out += [(s[0], node, s[5], s[6]) for s in signatures(line, tau)]
                if len(out) >= 50_000:
                    yield _key_rows(out)
                    out = []
            yield _key_rows(out)

    every = docs.filter("text IS NOT NULL").select(F.col("text").cast("binary")).mapInArrow(keys, schema)
    # Whole lines are fetched for nodes that share a key with another one, from the line's first place.
    both = every.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi"), F.max("idx").alias("i"), F.max("prb").alias("p"))
    shared = every.join(both.filter("lo < hi AND i AND p").select("key"), "key")
    shared = stored(shared.groupBy("key", "node").agg(F.max("idx").alias("idx"), F.max("prb").alias("prb")), "keys")
    first = seen.join(shared.select("node").distinct(), "node").groupBy("node").agg(F.min(F.struct("id", "sig", "pos")).alias("at"))
    wanted = first.groupBy("at.id", "at.sig").agg(F.collect_list(F.struct("at.pos", "node")).alias("want"))

    def fetch(batches):
        text_of = unpacker()
        for batch in batches:
            nodes, found = [], []
            for data, want in zip(*(batch.column(c).to_pylist() for c in ("packed", "want")), strict=True):
                lines = lines_of(text_of(data))
                for w in want:
                    nodes.append(w["node"])
                    found.append(lines[w["pos"]])
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(found, pa.string())], ["node", "line"])

    lines = packed_texts(docs).join(wanted, ["id", "sig"]).select("packed", "want").mapInArrow(fetch, "node long, line string")
    lines = stored(lines.dropDuplicates(["node"]), "lines")

    def narrow(batches):
        for batch in batches:
            out = []
            for node, line, kept in zip(*(batch.column(c).to_pylist() for c in ("node", "line", "keys")), strict=True):
                kept = {k % 2**64 for k in kept}
                out += [(key, node % 2**64, idx, prb) for s in signatures(line, tau) if s[0] in kept for key, idx, prb in narrowed(line, s, tau)]
            yield _key_rows(out)

    def entries(level, kept):
        if level == 0:
            return shared
        rows = kept.groupBy("node").agg(F.collect_set("key").alias("keys")).join(lines, "node").select("node", "line", "keys").mapInArrow(narrow, schema)
        return rows.groupBy("key", "node").agg(F.max("idx").alias("idx"), F.max("prb").alias("prb"))

    def check(batches):
        for batch in batches:
            yield batch.filter(pa.array([within(a, b, tau) for a, b in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True)], pa.bool_())).select(["a", "b"])

    def verify(pairs):
        both = pairs.join(lines.select(F.col("node").alias("a"), F.col("line").alias("x")), "a").join(lines.select(F.col("node").alias("b"), F.col("line").alias("y")), "b")
        return both.filter(F.abs(F.length("x") - F.length("y")) <= tau).select("a", "b", "x", "y").mapInArrow(check, "a long, b long")

    return link(entries, 1, verify)


def repeats(docs: DataFrame, tau: int = TAU, shortest: int = SHORTEST, least: int | None = None) -> DataFrame:
    """(id, sig, removed): places of the lines of each document that an earlier one stands for.

    Lines of ``least`` to ``shortest`` characters have only equal ones; without ``least`` they are left out.
    """
    docs = docs.select("doc_id", "text")
    seen = stored(occurrences(docs, shortest if least is None else min(least, shortest)), "lines-seen")
    roots = line_classes(docs, seen, tau, shortest)
    by_node = seen.groupBy("node").agg(F.min(F.struct("id", "sig", "pos")).alias("at"), F.count(F.lit(1)).alias("n"))
    classed = by_node.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    first = classed.groupBy("root").agg(F.min("at").alias("first"), F.sum("n").alias("total")).filter("total > 1").drop("total")
    decided = classed.join(first, "root").select("node", "first")
    gone = seen.join(decided, "node").filter(F.struct("id", "sig", "pos") != F.col("first"))
    return gone.groupBy("id", "sig").agg(F.sort_array(F.collect_set("pos")).alias("removed"))


def query(spark, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    removed = repeats(docs, least=1)
    rows = docs.select("doc_id", *row_key(), F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).cast("long").alias("n_lines"))
    rows = rows.withColumn("n_lines", F.when(F.col("n_lines") < 0, 0).otherwise(F.col("n_lines")))
    out = rows.join(removed, ["id", "sig"], "left").withColumn("removed", F.coalesce("removed", F.array().cast("array<int>")))
    return out.select("doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"), "removed")


def stage(spark, docs: DataFrame, folder: str) -> DataFrame:
    """Documents without their repeated lines; one whose lines with a word have all gone is dropped."""
    names = docs.columns
    rows = docs.select(*row_key(), F.struct(*[docs[c] for c in names]).alias("row")).join(repeats(docs, least=1), ["id", "sig"], "left")
    lines = F.split("row.text", "\n")
    # The places that stay are found by hashing, and the lines are split once: the work is linear in a document's lines.
    places = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "removed")
    both = F.array(F.struct(lines.alias("lines"), places.alias("places")))
    left = F.array_join(F.transform(both, lambda d: F.transform(d["places"], lambda i: F.get(d["lines"], i)))[0], "\n")
    out = rows.withColumn("left", F.when(F.col("removed").isNull(), F.col("row.text")).otherwise(left))
    out = out.filter(F.col("removed").isNull() | F.col("left").rlike(r"[^\x20\x09-\x0D]"))
    return out.select(*[F.col("left").alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in names])
