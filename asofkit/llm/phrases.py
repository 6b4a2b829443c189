"""Phrase collocation mining: best-first growth of frequent word sequences with bounds from prefix counts.

Texts are lower-cased (A-Z), cut into pieces at ``[.,;:!?\\x0A-\\x0D]`` and pieces into words. Within one language a
candidate is a phrase of 2 to ``LONGEST`` words found at least ``least`` times inside pieces; its score is the lowest over its
cuts of floor(1000 a n / (l r)): a, l, r are the counts of the phrase, of the part before the cut and of the rest, n counts
all words of the language. A candidate that always stands inside one and the same longer candidate is dropped;
the first ``top`` of each language are returned.

Growth is a branch and bound over prefixes. A phrase occurs at most as often as its rest behind the first word, so no
phrase that begins with w scores above 1000 n / f(w): rare first words promise most. Words are opened in the order of that
bound, in waves that hold a growing share of all occurrences; each wave grows its prefixes word by word, and every level is one
scan of the encoded corpus that counts the extensions of the frontier. After a wave the score of the
``top``-th survivor of a language is known; a word whose bound is lower is never opened, and when no
word is left the result is settled. Ties with that score are kept, as equal bounds are opened.

The same scan keeps the smallest and largest neighbour on both sides of each occurrence. When all are one word, the phrase
extended by it has the same count and the phrase is dropped; that covers longer containers too, as the
phrases between have that count as well. Counts of a survivor's rests that growth has not met are counted in one more scan.

Words and phrases are 64-bit hashes that include the language until the end, when the words of the returned
phrases are looked up. What scans receive are bit filters of a fixed size (``bits``); false positives are removed by joins
and counts. Encoded words travel once, in blocks with a vocabulary of their own; counts are added up per block
before they are shuffled. A language has no task of its own: only the first ``top`` rows of each task are ranked.

Null texts have no words, null languages are ``und``; the id is not read, and a row that occurs twice counts
twice. Ties of score and count go by phrase, so nothing is left open. A language without candidates
and an empty table give no rows. Only lang and text are read, so other columns may have any name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from asofkit.llm.shared import Filter, filter_of, stored

LEAST = 100
TOP = 2000
LONGEST = 5
FILTER_BITS = 23  # a filter is 1 MB, whatever the corpus
WAVES = (1 / 16, 1 / 4, 1.0)  # share of the occurrences of frequent words that first words up to each wave hold
BLOCK_WORDS = 1 << 20
SLICE_WORDS = 1 << 17  # words of a block that a scan looks at together
BREAK = 0

# Fixed values of the contract: bytes that end a piece become line ends, tabs become spaces.
PIECES = bytes.maketrans(b".,;:!?\x0a\x0b\x0c\x0d\x09", b"\n" * 10 + b" ")


class Vocabulary(dict):
    """Numbers of a block's words from 1 on; 0 is the end of a piece, -1 what stands between two separators."""

    def __init__(self):
        super().__init__({b"": -1, b"\n": 0})

    def __missing__(self, word: bytes) -> int:
        value = self[word] = len(self) - 1
        return value

    def encode(self, text: bytes) -> np.ndarray:
        words = text.lower().translate(PIECES).replace(b"\n", b" \n ").split(b" ")
        ids = np.fromiter(map(self.__getitem__, words), np.int32, len(words))
        return ids[ids >= 0]


def word_hashes(lang: bytes, words: list[bytes]) -> np.ndarray:
    """Hashes of a language's words; none equals BREAK."""
    return np.fromiter((xxhash.xxh3_64_intdigest(lang + b"\n" + w) or 1 for w in words), np.uint64, len(words))


def joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hash of a phrase and one more word."""
    with np.errstate(over="ignore"):
        x = (left ^ (left >> np.uint64(31))) * np.uint64(0x9FB21C651E98DF25) + (right ^ (right >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xE7037ED1A0B428DB)
        return x ^ (x >> np.uint64(30))


def encoded(docs: DataFrame, most: int = BLOCK_WORDS) -> DataFrame:
    """Blocks (lang, g, n, vocabulary, words, counts, ids) of one language each; g is the language's hash."""
    def encode(batches):
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=1)
        held, total = {}, 0

        def block(lang):
            vocabulary, parts = held.pop(lang)
            ids = np.concatenate(parts)
            words = list(vocabulary)[2:]
            counts = np.bincount(ids, minlength=len(words) + 1)[1:].astype(np.uint32)
            data = [word_hashes(lang, words).tobytes(), b"\n".join(words), counts.tobytes(), ids.tobytes()]
            row = [[lang.decode()], [xxhash.xxh3_64_intdigest(lang) - 2**63], [int(counts.sum())]]
            kinds = [pa.string(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays(
                [*(pa.array(c, t) for c, t in zip(row, kinds, strict=True)), *(pa.array([squeeze.compress(d)], pa.binary()) for d in data)],
                ["lang", "g", "n", "vocabulary", "words", "counts", "ids"],
            )

        sizes = {}
        for batch in batches:
            for row in _each(batch):
                lang, text = row["lang"], row["text"]
                vocabulary, parts = held.setdefault(lang, (Vocabulary(), []))
                ids = vocabulary.encode(text)
                parts += [ids, np.zeros(1, np.int32)]
                sizes[lang] = sizes.get(lang, 0) + len(ids) + 1
                total += len(ids) + 1
                # The fullest language goes first, so many small ones do not add up either.
                while total >= 4 * most or sizes[lang] >= most:
                    full = max(sizes, key=sizes.get)
                    total -= sizes.pop(full)
                    yield block(full)
                    if full == lang:
                        break
        for lang in list(held):
            yield block(lang)

    source = docs.filter("text IS NOT NULL").select(F.coalesce("lang", F.lit("und")).cast("binary").alias("lang"), F.col("text").cast("binary").alias("text"))
    schema = "lang string, g long, n long, vocabulary binary, words binary, counts binary, ids binary"
    return stored(source.mapInArrow(encode, schema), "phrase-blocks")


def _unpack(data: bytes, kind) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind)


def _each(batch):
    """The rows of a batch one by one: a block is large."""
    for k in range(batch.num_rows):
        yield batch.slice(k, 1).to_pylist()[0]


def _rows(names, columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c).view("i8")) for c in columns], list(names))


def word_counts(blocks: DataFrame, least: int) -> DataFrame:
    """(h, g, a) of words found at least so often."""
    def counts(batches):
        for batch in batches:
            for row in _each(batch):
                h = _unpack(row["vocabulary"], np.uint64)
                yield _rows(("h", "g", "a"), [h, np.full(len(h), row["g"], np.int64), _unpack(row["counts"], np.uint32).astype(np.int64)])

    rows = blocks.select("g", "vocabulary", "counts").mapInArrow(counts, "h long, g long, a long")
    return rows.groupBy("h").agg(F.min("g").alias("g"), F.sum("a").alias("a")).filter(F.col("a") >= least)


def _phrases(row: dict, known: Filter, size: int):
    """Slice by slice the block's word hashes with margins, BREAK for words that are not frequent, and the hashes of runs of 1 to ``size`` words."""
    words = np.append(np.uint64(BREAK), _unpack(row["vocabulary"], np.uint64))
    words[~known(words)] = BREAK
    ids = _unpack(row["ids"], np.int32)
    margin = np.full(LONGEST + 1, BREAK, np.uint64)
    for start in range(0, len(ids), SLICE_WORDS):
        n = min(SLICE_WORDS, len(ids) - start)
        # h[1:] begins at the slice; one word before it and some behind it are seen too.
        before = words[ids[start - 1 : start]] if start else margin[:1]
        h = np.concatenate([before, words[ids[start : start + n + LONGEST]], margin])
        runs, whole = [h[1 : n + 1]], [h[1 : n + 1] != BREAK]
        for k in range(1, size):
            runs.append(joined(runs[-1], h[k + 1 : n + k + 1]))
            whole.append(whole[-1] & (h[k + 1 : n + k + 1] != BREAK))
        yield h, runs, whole


GROWN = ("h", "p", "last", "a", "left_low", "left_high", "right_low", "right_high")


def _grown(batches, known: bytes, front: bytes, bits: int, size: int):
    """Extensions of the frontier's phrases of ``size`` words: count, and the range of neighbours on both sides."""
    known, front = Filter(known, bits), Filter(front, bits)
    for batch in batches:
        for h, runs, whole in (p for row in _each(batch) for p in _phrases(row, known, size + 1)):
            at = np.flatnonzero(whole[size])
            at = at[front(runs[size - 1][at])]
            if not len(at):
                continue
            keys = runs[size][at]
            order = np.argsort(keys)
            keys, at = keys[order], at[order]
            edges = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            left, right = h[at].view("i8"), h[at + size + 2].view("i8")
            first = at[edges]
            yield _rows(GROWN, [
                keys[edges], runs[size - 1][first], h[first + size + 1], np.diff(np.append(edges, len(at))),
                np.minimum.reduceat(left, edges), np.maximum.reduceat(left, edges), np.minimum.reduceat(right, edges), np.maximum.reduceat(right, edges),
            ])


def _counted(batches, known: bytes, wanted: bytes, bits: int):
    """Counts of phrases of 2 and more words, but not of the longest ones, that the filter lets through."""
    known, wanted = Filter(known, bits), Filter(wanted, bits)
    for batch in batches:
        for _, runs, whole in (p for row in _each(batch) for p in _phrases(row, known, LONGEST - 1)):
            for size in range(2, LONGEST):
                keys = runs[size - 1][whole[size - 1]]
                keys, counts = np.unique(keys[wanted(keys)], return_counts=True)
                yield _rows(("h", "a"), [keys, counts])


def extended(blocks: DataFrame, known: bytes, front: DataFrame, size: int, least: int, bits: int) -> DataFrame:
    """Frequent phrases of size + 1 words that extend those of the frontier: (h, g, words, before, a, inside).

    ``before`` has the counts of the prefixes, ``inside`` marks phrases that always stand in one longer phrase.
    """
    packed = filter_of(front, bits)
    rows = blocks.select("vocabulary", "ids").mapInArrow(lambda b: _grown(b, known, packed, bits, size), ", ".join(f"{c} long" for c in GROWN))
    lows = [F.min(c).alias(c) for c in ("p", "last", "left_low", "right_low")]
    found = rows.groupBy("h").agg(F.sum("a").alias("a"), *lows, *[F.max(c).alias(c) for c in ("left_high", "right_high")]).filter(F.col("a") >= least)
    one = lambda side: (F.col(f"{side}_low") == F.col(f"{side}_high")) & (F.col(f"{side}_low") != BREAK)
    parent = front.select(F.col("h").alias("p"), "g", "words", F.concat("before", F.array("a")).alias("before"))
    return found.join(parent, "p").select(
        "h", "g", F.concat("words", F.array("last")).alias("words"), "before", "a", ((one("left") | one("right")) & F.lit(size + 1 < LONGEST)).alias("inside")
    )


def _rests(phrases: DataFrame, size: int) -> DataFrame:
    """``rests``: hashes of the phrase without its first word, without two, ..."""
    columns = "h long, g long, words array<long>, before array<long>, a long"

    def chain(batches):
        for batch in batches:
            words = batch.column("words").flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, size)
            out = []
            for first in range(1, size):
                h = words[:, first]
                for k in range(first + 1, size):
                    h = joined(h, words[:, k])
                out.append(h.view("i8"))
            rests = pa.ListArray.from_arrays(pa.array(np.arange(len(words) + 1, dtype=np.int32) * (size - 1)), pa.array(np.stack(out, 1).ravel() if len(words) else np.zeros(0, "i8")))
            yield pa.RecordBatch.from_arrays([*batch.columns, rests], [*batch.schema.names, "rests"])

    return phrases.select("h", "g", "words", "before", "a").mapInArrow(chain, f"{columns}, rests array<long>")


def _score(a, n, left, right):
    big = "decimal(19,0)"
    above = (a * 1000).cast(big) * n.cast(big)
    below = left.cast(big) * right.cast(big)
    return F.call_function("div", above, below)


def scored(survivors: DataFrame, counts: DataFrame, langs: DataFrame) -> DataFrame:
    """Survivors with the counts of all rests: (h, g, words, a, l, r, n, score) of the cut that scores lowest, the first of equals."""
    cuts = survivors.select("h", "g", "words", "a", F.posexplode(F.arrays_zip("before", "rests")).alias("k", "cut"))
    cuts = cuts.select("h", "g", "words", "a", "k", F.col("cut.before").alias("l"), F.col("cut.rests").alias("rest"))
    cuts = cuts.join(counts.select(F.col("h").alias("rest"), F.col("a").alias("r")), "rest").join(langs.select("g", "n"), "g")
    each = cuts.select("h", "g", "words", "a", "n", F.struct(_score(F.col("a"), F.col("n"), F.col("l"), F.col("r")).alias("score"), "k", "l", "r").alias("cut"))
    best = each.groupBy("h").agg(*[F.first(c).alias(c) for c in ("g", "words")], *[F.min(c).alias(c) for c in ("a", "n", "cut")])
    return best.select("h", "g", "words", "a", "cut.l", "cut.r", "n", "cut.score")


def _wave_of(words: DataFrame) -> DataFrame:
    """Words with the wave that opens them: the rarest first, by shares of all their occurrences.

    Counts are grouped on a logarithmic scale, at most some hundred groups for a language.
    """
    grouped = words.withColumn("step", F.floor(F.log2("a") * 4))
    mass = grouped.groupBy("g", "step").agg(F.sum("a").alias("mass"))
    up = Window.partitionBy("g").orderBy("step")
    share = F.sum("mass").over(up) / F.sum("mass").over(Window.partitionBy("g"))
    wave = F.lit(len(WAVES) - 1)
    for k in range(len(WAVES) - 2, -1, -1):
        wave = F.when(share <= WAVES[k], k).otherwise(wave)
    return grouped.join(mass.select("g", "step", wave.alias("wave")), ["g", "step"]).drop("step")


def _floors(ranked: DataFrame, top: int) -> DataFrame:
    """(g, floor): the score of a language's ``top``-th survivor, where it has that many."""
    rank = F.row_number().over(Window.partitionBy("g").orderBy(F.desc("score"), F.desc("a")))
    return ranked.select("g", "score", "a").withColumn("rank", rank).filter(F.col("rank") <= top).filter(F.col("rank") == top).select("g", F.col("score").alias("floor"), F.col("a").alias("floor_a"))


def mine(docs: DataFrame, least: int = LEAST, top: int = TOP, bits: int = FILTER_BITS, most: int = BLOCK_WORDS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of each language's first ``top`` phrases."""
    blocks = encoded(docs, most)
    langs = stored(blocks.groupBy("g").agg(F.min("lang").alias("lang"), F.sum("n").alias("n")), "langs")
    words = stored(_wave_of(word_counts(blocks, least)), "words")
    known = filter_of(words, bits)
    counts = words.select("h", "a")
    ranked, floors = None, None
    for wave in range(len(WAVES)):
        opened = words.filter(F.col("wave") == wave).join(langs.select("g", "n"), "g")
        if floors is not None:
            # No phrase behind a word can reach the floor once its bound is lower.
            opened = opened.join(floors, "g", "left").filter(F.col("a").cast("decimal(19,0)") * F.coalesce("floor", F.lit(0)).cast("decimal(19,0)") <= F.col("n").cast("decimal(19,0)") * 1000)
        front = opened.select("h", "g", F.array("h").alias("words"), F.array().cast("array<long>").alias("before"), "a")
        survivors = []
        for size in range(1, LONGEST):
            front = stored(extended(blocks, known, front, size, least, bits), "phrases")
            if front.isEmpty():
                break
            counts = counts.unionByName(front.select("h", "a"))
            survivors.append(_rests(front.filter("NOT inside"), size + 1))
        if not survivors:
            continue
        found = survivors[0]
        for more in survivors[1:]:
            found = found.unionByName(more)
        found = stored(found, "survivors")
        rests = found.select(F.explode("rests").alias("h")).distinct().join(counts, "h", "left_anti")
        rests = stored(rests, "rests")
        if not rests.isEmpty():
            packed = filter_of(rests, bits)
            each = blocks.select("vocabulary", "ids").mapInArrow(lambda b, packed=packed: _counted(b, known, packed, bits), "h long, a long")
            counts = counts.unionByName(stored(each.groupBy("h").agg(F.sum("a").alias("a")).join(rests, "h"), "rest-counts"))
        new = stored(scored(found, counts, langs), "scored")
        ranked = new if ranked is None else ranked.unionByName(new)
        floors = stored(_floors(ranked, top), "floors")
    if ranked is None:
        return docs.sparkSession.createDataFrame([], "lang string, rank long, phrase string, a long, l long, r long, n long, score long")
    # What stands behind the last place in score and count cannot come in; the rest is ordered by phrase.
    left = ranked.join(floors, "g", "left").filter("floor IS NULL OR score > floor OR score = floor AND a >= floor_a").drop("floor", "floor_a")
    left = stored(left, "ranked")
    spelled = _spelled(left, blocks, bits).join(langs.select("g", "lang"), "g")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    out = spelled.withColumn("rank", rank).filter(F.col("rank") <= top)
    return out.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def _spelled(phrases: DataFrame, blocks: DataFrame, bits: int) -> DataFrame:
    """The phrases' words from the blocks' vocabularies."""
    parts = phrases.select(F.col("h").alias("id"), F.posexplode("words").alias("k", "h"))
    wanted = parts.select("h").distinct()
    packed = filter_of(wanted, bits)

    def spell(batches):
        import zstandard

        some, spread = Filter(packed, bits), zstandard.ZstdDecompressor()
        for batch in batches:
            for row in _each(batch):
                h = _unpack(row["vocabulary"], np.uint64)
                at = np.flatnonzero(some(h))
                words = spread.decompress(row["words"]).split(b"\n") if len(at) else []
                yield pa.RecordBatch.from_arrays([pa.array(h[at].view("i8")), pa.array([words[i] for i in at.tolist()], pa.binary())], ["h", "word"])

    words = blocks.select("vocabulary", "words").mapInArrow(spell, "h long, word binary").distinct().join(wanted, "h")
    whole = parts.join(words, "h").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("k", F.col("word").cast("string").alias("word")))).alias("words"))
    return phrases.drop("words").join(whole.select(F.col("id").alias("h"), F.concat_ws(" ", "words.word").alias("phrase")), "h")


SQL = r"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang, doc_id,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, regexp_extract_all(unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w FROM d),
q AS (SELECT lang, w FROM p WHERE len(w) > 0),
n AS (SELECT lang, CAST(sum(len(w)) AS HUGEINT) AS n FROM q GROUP BY lang),
s AS (SELECT lang, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM q, (SELECT unnest(generate_series(1, 5)) AS k) WHERE len(w) >= k),
f AS (SELECT lang, k, w[i:i + k - 1] AS g, count(*) AS a FROM s GROUP BY ALL HAVING count(*) >= 100),
x AS (SELECT lang, g[1:k - 1] AS part, a FROM f WHERE k > 2 UNION ALL SELECT lang, g[2:k] AS part, a FROM f WHERE k > 2),
m AS (SELECT lang, part, max(a) AS longer FROM x GROUP BY lang, part),
c AS (
  SELECT f.lang, f.k, f.g, f.a FROM f LEFT JOIN m ON m.lang = f.lang AND m.part = f.g
  WHERE f.k > 1 AND (m.longer IS NULL OR 100 * m.longer < 100 * f.a)),
u AS (SELECT lang, k, g, a, unnest(generate_series(1, k - 1)) AS cut FROM c),
v AS (
  SELECT u.lang, u.g, u.a, u.cut, l.a AS l, r.a AS r, n.n, (CAST(1000 AS HUGEINT) * u.a * n.n) // (CAST(l.a AS HUGEINT) * r.a) AS score
  FROM u JOIN n ON n.lang = u.lang
  JOIN f AS l ON l.lang = u.lang AND l.g = u.g[1:u.cut] JOIN f AS r ON r.lang = u.lang AND r.g = u.g[u.cut + 1:u.k]),
z AS (SELECT *, row_number() OVER (PARTITION BY lang, g ORDER BY score, cut) AS first FROM v),
o AS (
  SELECT lang, array_to_string(g, ' ') AS phrase, a, l, r, n, score,
         row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(g, ' ')) AS rank
  FROM z WHERE first = 1)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r,
       CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM o WHERE rank <= 2000
"""


def query(spark, folder: str) -> DataFrame:
    return mine(spark.read.parquet(f"{folder}/documents.parquet"))
