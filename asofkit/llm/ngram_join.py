"""N-gram Jaccard join: prefixes under several global token orders filter the candidates.

A document's set holds its distinct runs of ``width`` words (lower-cased A-Z). Under any global
order of the tokens, two sets of similarity ``percent`` share a token among the first
``n - ceil(n * percent / 100) + 1`` of each. Order 0 gives the join keys, each with a class of set sizes. A pair found by order 0
must share as many prefix tokens there as a link needs, then a prefix token under order 1 and under order 2, before the whole sets
are compared. Sets of a key that many share are compared with a few of them first; those that stay in
different components are cut into blocks of a bounded size, and each two blocks meet in one task, which
filters all their pairs by orders 1 and 2 as arrays, compares those left, and passes on one edge for each set at most.

Every order goes by frequency, rare tokens first: a passage that many documents share stands behind their own
words, so it brings no pair together. Frequencies are counted over all sets: runs of ``COUNTED`` tokens report those that
several of their sets hold, and the sums choose the class of a token (``STEPS``). Each class is a
bit filter of a fixed size, so what tasks receive does not grow; a filter that errs changes the
order alike for all documents and never the result. Within a class long shingles, which are rare, come before short
ones, and hashes decide within a length.

Equal sets are one node from the start (128-bit digest of the sorted set). Documents without words or text
have no set and link with nothing; their component is their own id. Ids may repeat or be null: every row
is answered, and a component is named after the smallest id in it. An empty table gives no rows.
Input columns that clash with result columns never meet them.
"""

from __future__ import annotations

import functools
import math
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from asofkit.llm.shared import NULL_ID, Filter, filter_of, link, mixed, packed_texts, row_key, stored, unpacker, window_hashes

STEPS = (32, 128, 512, 2048, 8192)  # sets that hold a token of each class at least
COUNTED = 4_000_000  # tokens that are counted together
REPORTED = 3  # sets among them that hold a reported token at least
FREQUENCY_BITS = 22  # a class's filter is half a megabyte
ORDERS = 3
BLOCK_SETS = 256  # sets of a block at most
BLOCK_TOKENS = 200_000  # and their tokens, but for a single set
CLASS = 1.5  # ratio of the sizes in a size class
SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
CODES = mixed(np.arange(256, dtype=np.uint64))
WEIGHTS = mixed(np.arange(1 << 12, dtype=np.uint64), 1) | np.uint64(1)


def word_hashes(text: bytes, block: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word, and its bytes: random codes of its bytes, summed with weights by their place in it.

    Words are hashed together, about ``block`` bytes at a time.
    """
    raw = np.frombuffer(text, np.uint8)
    solid = np.zeros(len(raw) + 2, bool)
    solid[1:-1] = ~SPACE[raw]
    edges = np.flatnonzero(solid[1:] != solid[:-1])
    lengths = edges[1::2] - edges[::2]
    ends = np.cumsum(lengths)
    letters, out = raw[solid[1:-1]], []
    cuts = np.unique(np.searchsorted(ends, np.arange(0, len(letters), block)))
    for i, j in pairwise([*cuts, len(lengths)]):
        first = ends[i:j] - lengths[i:j]
        place = np.arange(first[0], ends[j - 1]) - np.repeat(first, lengths[i:j])
        weights = WEIGHTS[place] if lengths[i:j].max() <= len(WEIGHTS) else mixed(place.astype(np.uint64), 1) | np.uint64(1)
        out.append(np.add.reduceat(CODES[letters[first[0] : ends[j - 1]]] * weights, first - first[0]))
    return np.concatenate(out) if out else np.zeros(0, np.uint64), lengths


def shingle_set(text: bytes, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted 64-bit tokens of the set, and the bytes of each one's words."""
    words, lengths = word_hashes(text.lower())
    if not len(words):
        return np.zeros(0, np.uint64), np.zeros(0, int)
    width = min(width, len(words))
    tokens, at = np.unique(window_hashes(words, width), return_index=True)
    ends = np.append(0, np.cumsum(lengths))
    return tokens, (ends[width:] - ends[:-width])[at]


class Frequencies:
    """The class of tokens: how many of the filters hold them, each filter being part of the one before."""

    def __init__(self, packed: list[bytes], bits: int = FREQUENCY_BITS):
        self.filters = [Filter(data, bits) for data in packed]

    def __call__(self, tokens: np.ndarray) -> np.ndarray:
        out = np.zeros(len(tokens), np.uint64)
        at = np.arange(len(tokens))
        for some in self.filters:
            at = at[some(tokens[at])]
            out[at] += np.uint64(1)
        return out


@functools.lru_cache(2)
def frequencies(packed: tuple[bytes, ...]) -> Frequencies:
    """Unpacked once per Python worker."""
    return Frequencies(list(packed))


def prefix(tokens: np.ndarray, sizes: np.ndarray, order: int, common: Frequencies, percent: int) -> np.ndarray:
    """The first tokens of a set in a global order: frequent ones last, longer words (which are rarer) first, then by hash."""
    n = len(tokens)
    size = n - -(-n * percent // 100) + 1
    if size >= n:
        return tokens
    place = np.uint64(31) - np.minimum(sizes // 8, 31).astype(np.uint64) + (common(tokens) << np.uint64(5))
    place = place << np.uint64(56) | mixed(tokens, order + 1) >> np.uint64(8)
    return tokens[np.argpartition(place, size - 1)[:size]]


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Common values of two arrays without repeats."""
    both = np.concatenate((a, b))
    both.sort()
    return int(np.count_nonzero(both[1:] == both[:-1]))


class Sets(dict):
    """Each node's set and its prefixes under the orders from 1 on, remembered up to ``most`` tokens."""

    def __init__(self, read, first, most: int = 2_000_000):
        super().__init__()
        self.read, self.first, self.most, self.held = read, first, most, 0

    def __call__(self, node: int, packed):
        if node not in self:
            tokens, sizes = self.read(packed.as_py())
            if self.held + len(tokens) > self.most:
                self.clear()
                self.held = 0
            self.held += len(tokens)
            self[node] = tokens, [self.first((tokens, sizes), k) for k in range(1, ORDERS)]
        return self[node]


def shared_counts(left: list[np.ndarray], right: list[np.ndarray], chunk: int = 4096) -> np.ndarray:
    """Common tokens of each set on the left with each on the right; tokens are taken ``chunk`` at a time."""
    out = np.zeros((len(left), len(right)), np.float32)
    if not len(left) or not len(right):
        return out
    tokens = np.intersect1d(np.concatenate(left), np.concatenate(right))
    places = []
    for side in (left, right):
        row, value = np.repeat(np.arange(len(side)), [len(x) for x in side]), np.concatenate(side)
        at = np.searchsorted(tokens, value)
        known = at < len(tokens)
        known[known] = tokens[at[known]] == value[known]
        order = np.argsort(at[known], kind="stable")
        places.append((row[known][order], at[known][order], len(side)))
    for start in range(0, len(tokens), chunk):
        parts = []
        for row, at, n in places:
            i, j = np.searchsorted(at, (start, start + chunk))
            part = np.zeros((n, min(chunk, len(tokens) - start)), np.float32)
            part[row[i:j], at[i:j] - start] = 1
            parts.append(part)
        out += parts[0] @ parts[1].T
    return out


def linked_sets(sets: list[np.ndarray], firsts: list[list[np.ndarray]], left: np.ndarray, right: np.ndarray, percent: int) -> np.ndarray:
    """Which sets on the left link with which on the right: pairs pass the prefixes of every order, then the whole sets are compared."""
    candidates = np.ones((len(left), len(right)), bool)
    for prefixes in firsts:
        candidates &= shared_counts([prefixes[i] for i in left], [prefixes[i] for i in right]) > 0
    rows, columns = candidates.any(1), candidates.any(0)
    left, right = left[rows], right[columns]
    both = shared_counts([sets[i] for i in left], [sets[i] for i in right]).astype(np.int64)
    sizes = np.array([len(s) for s in sets], np.int64)
    some = 100 * both >= percent * (sizes[left][:, None] + sizes[right] - both)
    candidates[np.ix_(rows, columns)] &= some
    return candidates


def joined_labels(linked: np.ndarray, left: np.ndarray, right: np.ndarray, n: int) -> np.ndarray:
    """The smallest place that each of ``n`` places reaches through links of the left with the right."""
    labels = np.arange(n)
    while linked.size:
        before = labels.copy()
        np.minimum.at(labels, right, np.where(linked, labels[left][:, None], n).min(0))
        np.minimum.at(labels, left, np.where(linked, labels[right], n).min(1))
        if np.array_equal(before, labels):
            break
    return labels


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    values = np.concatenate(arrays) if arrays else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, arrays)]), pa.int32()), pa.array(values.view("i8")))


def token_classes(texts: DataFrame, width: int) -> tuple[bytes, ...]:
    """Packed filters of the tokens of each class, from one pass over all texts; equal sets of a run count once."""
    def count(batches):
        sets, seen, total = [], set(), 0

        def report():
            tokens, n = np.unique(np.concatenate(sets), return_counts=True)
            most = n >= REPORTED
            return pa.RecordBatch.from_arrays([pa.array(tokens[most].view("i8")), pa.array(n[most].astype("i8"))], ["h", "n"])

        for batch in batches:
            for text in batch.column(0):
                words = word_hashes(text.as_py().lower())[0]
                tokens = np.unique(window_hashes(words, min(width, len(words)))) if len(words) else words
                digest = xxhash.xxh3_128_digest(tokens.tobytes())
                if len(tokens) and digest not in seen:
                    seen.add(digest)
                    sets.append(tokens)
                    total += len(tokens)
                if total >= COUNTED:
                    yield report()
                    sets, seen, total = [], set(), 0
        if sets:
            yield report()

    found = texts.select("text").mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    found = stored(found.filter(F.col("n") >= STEPS[0]), "frequent")
    return tuple(filter_of(found.filter(F.col("n") >= step), FREQUENCY_BITS) for step in STEPS)


def classes(docs: DataFrame, width: int = 4, percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id, id, sig, keep): ``keep`` marks one row of each component.

    The kept row is the one with the smallest id; among rows of that id, the one whose text
    hash is smallest. Rows without a set are all kept.
    """
    docs = docs.select("doc_id", "text")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select(*row_key(), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    common = docs.sparkSession.sparkContext.broadcast(token_classes(texts, width))

    def sign(batches):
        for batch in batches:
            sets = [shingle_set(t, width) for t in batch.column("text").to_pylist()]
            digests = [xxhash.xxh3_128_digest(t.tobytes()) if len(t) else None for t, _ in sets]
            first = _lists([prefix(t, s, 0, frequencies(common.value), percent) for t, s in sets])
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("sig"), pa.array([len(t) for t, _ in sets], pa.int64()), pa.array(digests, pa.binary()), first], ["id", "sig", "n", "digest", "p0"])

    signed = stored(texts.mapInArrow(sign, "id long, sig long, n long, digest binary, p0 array<long>"), "signed")
    sets = stored(
        signed.filter("n > 0").groupBy("digest").agg(F.min("id").alias("id"), *[F.first(c).alias(c) for c in ("n", "p0")])
        .withColumn("node", F.monotonically_increasing_id()), "sets",
    )
    holders = signed.groupBy("digest", "id").agg(F.min("sig").alias("sig"))

    # Texts are fetched again for nodes that share a key with another one.
    # Linked sets lie in one size class or in neighbouring ones: the smaller is found in its own, the larger looks in its own and,
    # where a set of the least size it can link with would lie below, in the one below. A key is a token and a size class.
    size = F.floor(F.log("n") / math.log(CLASS))
    below = F.floor(F.log(F.col("n") * (percent - 1) / 100) / math.log(CLASS))
    own = F.struct(size.alias("c"), F.lit(True).alias("idx"))
    looks = F.when(below < size, F.array(own, F.struct(below.alias("c"), F.lit(False).alias("idx")))).otherwise(F.array(own))
    tokens = sets.select("p0", "node", looks.alias("looks")).select(F.explode("p0").alias("token"), "node", "looks")
    keys = tokens.select("token", "node", F.explode("looks").alias("l")).select(F.xxhash64("token", "l.c").alias("key"), "node", "l.idx", F.lit(True).alias("prb"))
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("idx").alias("i")).filter("n > 1 AND i").select("key")
    shared = stored(keys.join(shared, "key"), "keys")
    rivals = sets.join(shared.select("node").distinct(), "node").select("node", "digest", "id").join(holders, ["digest", "id"]).select("node", "id", "sig")
    once = packed_texts(docs).dropDuplicates(["id", "sig"])
    whole = stored(once.join(rivals, ["id", "sig"]).select("node", "packed"), "texts")

    def entries(level, kept):
        return shared

    def compare(batches):
        text_of = unpacker()
        sets = Sets(lambda x: shingle_set(text_of(x), width), lambda x, k: prefix(*x, k, frequencies(common.value), percent))
        for batch in batches:
            good = []
            for i, j, x, y in zip(*(batch.column(c) for c in ("a", "b", "x", "y")), strict=True):
                (a, firsts), (b, others) = sets(i.as_py(), x), sets(j.as_py(), y)
                if all(overlap(p, q) for p, q in zip(firsts, others, strict=True)):
                    both = overlap(a, b)
                    good.append(100 * both >= percent * (len(a) + len(b) - both))
                else:
                    good.append(False)
            yield batch.filter(pa.array(good, pa.bool_())).select(["a", "b"])

    def verify(pairs):
        near = pairs
        for side in ("a", "b"):
            near = near.join(sets.select(F.col("node").alias(side), F.col("n").alias(f"{side}n")), side)
        near = near.filter(f"100 * least(an, bn) >= {percent} * greatest(an, bn)")
        # Of two linked sets, the one whose prefix ends first misses at most its size less the least overlap of the other's tokens there.
        least = f"({percent} * (an + bn) + {99 + percent}) div {100 + percent} - ({percent} * greatest(an, bn) + 99) div 100 + 1"
        known = near.filter(f"shared >= {least}").select("a", "b")
        # Other pairs are counted on their prefixes before any text is fetched.
        unknown = near.filter("shared IS NULL").drop("shared").distinct()
        for side in ("a", "b"):
            unknown = unknown.join(sets.select(F.col("node").alias(side), F.col("p0").alias(f"{side}0")), side)
        unknown = unknown.withColumn("shared", F.size(F.array_intersect("a0", "b0"))).filter(f"shared >= {least}").select("a", "b")
        near = known.unionByName(unknown).distinct()
        sides = [whole.select(F.col("node").alias(s), F.col("packed").alias(t)) for s, t in (("a", "x"), ("b", "y"))]
        # Few bytes are much work here, so partitions are not merged by size; a node's pairs as b come together.
        near = near.join(sides[0], "a").repartition(parts, "b").join(sides[1].hint("merge"), "b")
        return near.select("a", "b", "x", "y").mapInArrow(compare, "a long, b long")

    def meet(table):
        text_of = unpacker()
        found = [shingle_set(text_of(x), width) for x in table["packed"].to_pylist()]
        firsts = [[prefix(*f, k, frequencies(common.value), percent) for f in found] for k in range(1, ORDERS)]
        part, lo, hi = (table[c].to_numpy() for c in ("part", "lo", "hi"))
        left, right = np.flatnonzero(part == lo), np.flatnonzero(part == hi)
        linked = linked_sets([t for t, _ in found], firsts, left, right, percent)
        labels = joined_labels(linked, left, right, len(part))
        nodes = table["node"].to_numpy()
        moved = labels != np.arange(len(part))
        return pa.table({"a": nodes[labels[moved]], "b": nodes[moved]})

    def blocks(kept):
        rows = kept.join(sets.select("node", "n"), "node")
        most = F.greatest(F.lit(1), F.least(F.lit(BLOCK_SETS), F.floor(F.lit(BLOCK_TOKENS) / F.max("n"))))
        cuts = rows.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / most).alias("cuts"))
        part = F.pmod(F.xxhash64("node", "key"), F.col("cuts")).alias("part")
        rows = kept.join(cuts, "key").select("key", "node", "cuts", part).join(whole, "node")
        # Block i meets itself and each other block once.
        rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cuts") - 1)))
        cell = ("key", "lo", "hi")
        rows = rows.select("key", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"), "part", "node", "packed")
        return rows.repartition(parts, *cell).groupBy(*cell).applyInArrow(meet, "a long, b long").distinct()

    roots = link(entries, 0, verify, first=8, blocks=blocks)
    named = sets.select("digest", "node", "id").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    # A component is named after its smallest id.
    smallest = named.groupBy("root").agg(F.min("id").alias("component"))
    labels = stored(named.join(smallest, "root").select("digest", "root", "component"), "labels")
    light = signed.select("id", "sig", "n", "digest").join(labels, "digest", "left")
    # By root: an id that repeats can name two components.
    firsts = holders.join(labels, "digest").filter("id = component").groupBy("root").agg(F.min("sig").alias("first_sig"))
    out = light.join(firsts, "root", "left")
    keep = F.col("digest").isNull() | ((F.col("id") == F.col("component")) & (F.col("sig") == F.col("first_sig")))
    doc = F.nullif(F.col("id"), F.lit(NULL_ID))
    component = F.nullif(F.coalesce("component", "id"), F.lit(NULL_ID))
    return out.select(doc.alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"), "id", "sig", keep.alias("keep"))


SQL = r"""
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM documents),
s AS (
  SELECT DISTINCT r, array_to_string(words[i:i + 3], ' ') AS g
  FROM (SELECT r, words, unnest(generate_series(1, greatest(len(words) - 3, 1))) AS i FROM w WHERE len(words) > 0)),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
i AS (SELECT a.r AS a, b.r AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.r < b.r GROUP BY 1, 2),
l AS (SELECT a, b FROM i JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE 100 * i >= 85 * (x.n + y.n - i)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
c AS (SELECT r AS node, r AS other FROM w UNION SELECT c.node, e.b FROM c JOIN e ON e.a = c.other),
m AS (SELECT node, min(doc_id) AS component_id FROM c JOIN w ON w.r = c.other GROUP BY node)
SELECT doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id
FROM w JOIN m ON m.node = w.r LEFT JOIN n ON n.r = w.r
"""


def query(spark, folder: str) -> DataFrame:
    out = classes(spark.read.parquet(f"{folder}/documents.parquet"))
    return out.select("doc_id", "n_shingles", "component_id")


def keep_one(docs: DataFrame, width: int = 4, percent: int = 85) -> DataFrame:
    """The input rows without those that another row of their component stands for.

    Rows of equal id and text are one document, of which one row is kept.
    """
    rows = docs.select(*row_key(), F.struct(*[docs[c] for c in docs.columns]).alias("row")).dropDuplicates(["id", "sig"])
    dropped = classes(docs, width, percent).filter("NOT keep").select("id", "sig").distinct()
    return rows.join(dropped, ["id", "sig"], "left_anti").select("row.*")


def stage(spark, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each component under five words and similarity 0.8; the query has four words and 0.85."""
    return keep_one(docs, width=5, percent=80)
