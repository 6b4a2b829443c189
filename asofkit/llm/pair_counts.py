"""Cross-tokenizer alignment: tokens of two vocabularies that end at one byte, counted outside memory.

Every text, with one space before it, is encoded by a byte-level vocabulary (A) and by a sentence-piece vocabulary
(B). Where tokens of both end at one byte a group ends, and the two tokens that end there are a link. How often
two ids are linked in the whole corpus is counted as an external sort would:

* Tasks collect the (pair, document) records of a *block* of documents. Its distinct pairs, with their sums, are dealt
  by a radix of the B id, sorted B first inside each radix, and written as zstd *runs* beside the block's records.
* A radix goes to one task, which merges its runs with a heap, head by head, and so meets all runs of a pair
  together. All pairs of one B id follow each other: when the next one begins, the highest count is known, and
  the counts stream back, one answer for each entry of each run, in its order.
* A block meets its answers and adds them up for each of its documents.

Only runs and answers are shuffled, never pair-document records: a pair found in all documents is one entry for each block.
A merging task holds the runs of one radix; ``parts`` sets how many there are.

Null and empty texts, and texts whose bytes the tokens of A or B do not give back (a vocabulary that changes
characters), have no tokens: zeros and an empty digest. A null id stays null; repeated rows are rows of
their own, and count as such. Ties of the highest count all are the best. An empty table gives no rows. Only doc_id
and text are read, so other columns may have any name.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import uuid
from array import array
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from asofkit.llm.shared import PLAIN, RUNS, stored

BLOCK_RECORDS = 1 << 20
REMEMBERED = 300_000  # words whose alignment a Python worker remembers
SPACE = "▁"

# How byte-level vocabularies write bytes. Printable ones are themselves, others follow from U+0100 on.
PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]


def byte_of_character() -> dict[str, int]:
    others = [b for b in range(256) if b not in set(PRINTABLE)]
    return {**{chr(b): b for b in PRINTABLE}, **{chr(256 + k): b for k, b in enumerate(others)}}


class Aligner:
    """Groups of a text's tokens under both vocabularies.

    Neither vocabulary merges across a single space that follows a word or around a single line end
    (``splits`` tells whether that holds for the pieces of B), so a plain text is the sum of its words, each aligned once
    and remembered. All other texts are aligned whole.
    """

    def __init__(self, path_a: str, path_b: str, most: int = REMEMBERED):
        import os

        import sentencepiece
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True  # their strings in a text are ordinary text
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        of = byte_of_character()
        self.bytes_a = [b""] * self.a.get_vocab_size()
        for token, k in self.a.get_vocab().items():
            self.bytes_a[k] = bytes(of[c] for c in token) if all(c in of for c in token) else token.encode()
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace(SPACE, " ").encode() for k, p in enumerate(pieces)]
        self.splits = not any("\n" in p or SPACE in p.lstrip(SPACE) for p in pieces)
        self.words, self.most = {}, most

    def groups(self, data: bytes, a: list[int], b: list[int]):
        """(groups as text, links as 32-bit pairs, tokens of A, tokens of B), or None if the bytes differ."""
        of_a, of_b = [self.bytes_a[t] for t in a], [self.bytes_b[t] for t in b]
        if b"".join(of_a) != data or b"".join(of_b) != data:
            return None
        parts, links = [], array("I")
        i = j = first_a = first_b = 0
        end_a, end_b = len(of_a[0]), len(of_b[0])
        while True:
            if end_a == end_b:
                parts.append(f"{','.join(map(str, a[first_a : i + 1]))}|{','.join(map(str, b[first_b : j + 1]))}")
                links.append(b[j] << 16 | a[i])
                i, j = i + 1, j + 1
                if i == len(a):
                    return ";".join(parts).encode(), links.tobytes(), len(a), len(b)
                first_a, first_b = i, j
                end_a, end_b = end_a + len(of_a[i]), end_b + len(of_b[j])
            elif end_a < end_b:
                i += 1
                end_a += len(of_a[i])
            else:
                j += 1
                end_b += len(of_b[j])

    def _whole(self, texts: list[str]) -> list:
        """Texts behind the space that is put before each."""
        encoded = self.a.encode_batch_fast([f" {t}" for t in texts], add_special_tokens=False)
        return [self.groups(f" {t}".encode(), a.ids, b) for t, a, b in zip(texts, encoded, self.b.encode(texts), strict=True)]

    def _remember(self, words: list[str]) -> None:
        """Words stand behind their space; those that begin with a line end have none, so B's first token, the space, goes."""
        a = self.a.encode_batch_fast([w if w[0] == "\n" else f" {w}" for w in words], add_special_tokens=False)
        for word, x, b in zip(words, a, self.b.encode(words), strict=True):
            line = word[0] == "\n"
            found = self.groups((word if line else f" {word}").encode(), x.ids, b[1:] if line else b)
            self.words[word] = found and (*found[:2], found[2] | found[3] << 32)

    def align(self, texts: list[str | None], step: int = 64):
        """For each text (groups as text, links, tokens of A, tokens of B), or None where it has no tokens."""
        for k in range(0, len(texts), step):
            some = [t or "" for t in texts[k : k + step]]
            cut = [self._cut(t) for t in some]
            if len(self.words) > self.most:
                self.words.clear()
            new = list({w for words in cut if words for w in words if w not in self.words})
            if new:
                self._remember(new)
            whole = iter(self._whole([t for t, words in zip(some, cut, strict=True) if words is None and t]))
            for text, words in zip(some, cut, strict=True):
                if not text:
                    yield None
                elif words is None:
                    yield next(whole)
                else:
                    found = list(map(self.words.__getitem__, words))
                    if None in found:
                        yield None
                        continue
                    tokens = sum([f[2] for f in found])
                    yield b";".join([f[0] for f in found]), b"".join([f[1] for f in found]), tokens & 0xFFFFFFFF, tokens >> 32

    def _cut(self, text: str) -> list[str] | None:
        spaced = f" {text}"
        if not self.splits or not text or text[-1] == " " or not PLAIN.fullmatch(text) or any(run in spaced for run in RUNS):
            return None
        return text.replace("\n", " \n").split(" ")


@functools.cache
def aligner(path_a: str, path_b: str) -> Aligner:
    """One per Python worker, kept for its next tasks."""
    return Aligner(path_a, path_b)


def _radix(codes: np.ndarray, parts: int) -> np.ndarray:
    """The part of each pair, by its B id alone."""
    return ((codes >> np.uint32(16)).astype(np.uint64) * np.uint64(0x9E3779B1) >> np.uint64(13)) % np.uint64(parts)


BLOCK = (
    "block string, doc_id array<bigint>, n_a array<bigint>, n_b array<bigint>, n_links array<bigint>, groups_sha256 array<string>, "
    "sizes array<bigint>, records binary, runs array<struct<part:int,run:binary>>"
)
RUN = pa.list_(pa.struct([("part", pa.int32()), ("run", pa.binary())]))


def _blocks(batches, path_a: str, path_b: str, parts: int, most: int):
    """One row for each block: its documents, their records in order of documents, its runs."""
    import zstandard

    squeeze = zstandard.ZstdCompressor(level=1)
    both, held, docs, pairs, times = aligner(path_a, path_b), 0, [], [], []

    def block():
        codes = np.concatenate([np.zeros(0, np.uint32), *pairs])
        counts = np.concatenate([np.zeros(0, np.int64), *times]).astype(np.uint32)
        distinct, at = np.unique(codes, return_inverse=True)
        sums = np.zeros(len(distinct), np.uint64)
        np.add.at(sums, at, counts)
        part = _radix(distinct, parts)
        order = np.argsort(part, kind="stable")  # by part, then by code
        place = np.empty(len(order), np.uint32)
        place[order] = np.arange(len(order), dtype=np.uint32)
        distinct, sums, part = distinct[order], sums[order], part[order]
        edges = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else np.zeros(0, int)
        runs = [
            {"part": int(part[s]), "run": squeeze.compress(distinct[s:e].tobytes() + sums[s:e].tobytes())}
            for s, e in zip(edges.tolist(), [*edges[1:].tolist(), len(part)], strict=False)
        ]
        records = squeeze.compress(place[at].tobytes() + counts.tobytes())
        columns = [list(c) for c in zip(*docs, strict=True)]
        lists = [pa.array([c], pa.list_(pa.string() if k == 4 else pa.int64())) for k, c in enumerate(columns)]
        return pa.RecordBatch.from_arrays(
            [pa.array([uuid.uuid4().hex]), *lists, pa.array([records], pa.binary()), pa.array([runs], RUN)],
            ["block", "doc_id", "n_a", "n_b", "n_links", "groups_sha256", "sizes", "records", "runs"],
        )

    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for doc, found in zip(ids, both.align(texts), strict=True):
            if found is None:
                docs.append((doc, 0, 0, 0, "", 0))
                continue
            groups, links, n_a, n_b = found
            codes, counts = np.unique(np.frombuffer(links, np.uint32), return_counts=True)
            docs.append((doc, n_a, n_b, len(links) // 4, hashlib.sha256(groups).hexdigest(), len(codes)))
            pairs.append(codes)
            times.append(counts)
            held += len(codes)
            if held >= most:
                yield block()
                held, docs, pairs, times = 0, [], [], []
    if docs:
        yield block()


def _entries(run: bytes, k: int, spread):
    """The entries of one run, in order: (pair, run, count)."""
    data = spread.decompress(run)
    n = len(data) // 12
    return zip(np.frombuffer(data, np.uint32, n).tolist(), repeat(k), np.frombuffer(data, np.uint64, n, 4 * n).tolist())


def merged(runs: list[bytes]) -> list[bytes]:
    """The answers to each run: for each entry twice its pair's count, one more where no pair of its B id counts higher."""
    import zstandard

    spread, squeeze = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=1)
    answers = [array("Q") for _ in runs]
    waiting, highest = [], 0  # pairs of one B id: (count, runs that hold it)
    pair, side, total, holders = -1, -1, 0, []

    def settle():
        for count, where in waiting:
            value = 2 * count + (count == highest)
            for k in where:
                answers[k].append(value)

    for code, k, count in heapq.merge(*[_entries(run, k, spread) for k, run in enumerate(runs)]):
        if code != pair:
            if holders:
                waiting.append((total, holders))
                highest = max(highest, total)
            if code >> 16 != side:
                settle()
                waiting, highest, side = [], 0, code >> 16
            pair, total, holders = code, 0, []
        total += count
        holders.append(k)
    if holders:
        waiting.append((total, holders))
        highest = max(highest, total)
    settle()
    return [squeeze.compress(a.tobytes()) for a in answers]


def _answers(batches):
    """Rows (part, block, run) sorted by part; a part may go on in the next batch."""
    part, blocks, runs = None, [], []

    def out():
        return pa.RecordBatch.from_arrays([pa.array(blocks), pa.array([part] * len(blocks), pa.int32()), pa.array(merged(runs), pa.binary())], ["block", "part", "answer"])

    for batch in batches:
        for p, block, run in zip(*(batch.column(c).to_pylist() for c in ("part", "block", "run")), strict=True):
            if p != part:
                if runs:
                    yield out()
                part, blocks, runs = p, [], []
            blocks.append(block)
            runs.append(run)
    if runs:
        yield out()


COUNTS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


def _documents(batches):
    """Blocks with their answers in the order of their parts, added up for each document."""
    import zstandard

    spread = zstandard.ZstdDecompressor()
    for batch in batches:
        for row in batch.to_pylist():
            answers = np.frombuffer(b"".join(spread.decompress(a) for a in row["answers"] or ()), np.uint64)
            data = spread.decompress(row["records"])
            n = len(data) // 8
            place, counts = np.frombuffer(data, np.uint32, n), np.frombuffer(data, np.uint32, n, 4 * n).astype(np.uint64)
            values = answers[place]
            ends = np.cumsum([0, *row["sizes"]])
            sums = []
            for each in ((values & np.uint64(1)) * counts, (values >> np.uint64(1)) * counts):
                run = np.append(np.uint64(0), np.cumsum(each, dtype=np.uint64))
                sums.append((run[ends[1:]] - run[ends[:-1]]).astype(np.int64))
            columns = [row["doc_id"], row["n_a"], row["n_b"], row["n_links"], row["n_links"], *sums]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns), pa.array(row["groups_sha256"], pa.string())], ["doc_id", *COUNTS, "groups_sha256"])


def linked_counts(docs: DataFrame, path_a: str, path_b: str, parts: int | None = None, most: int = BLOCK_RECORDS) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), one row for each row of docs.

    Every group ends in exactly one link, as no token is empty. A block is closed once it holds ``most`` records.
    """
    spark = docs.sparkSession
    parts = parts or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    source = docs.select(F.col("doc_id").cast("long"), "text")
    blocks = stored(source.mapInArrow(lambda b: _blocks(b, path_a, path_b, parts, most), BLOCK), "blocks")
    runs = blocks.select("block", F.explode("runs").alias("r")).select("r.part", "block", "r.run")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    answers = runs.repartition(tasks, "part").sortWithinPartitions("part", "block").mapInArrow(_answers, "block string, part int, answer binary")
    answers = answers.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("part", "answer"))).alias("answers"))
    whole = blocks.drop("runs").join(answers, "block", "left").withColumn("answers", F.col("answers.answer"))
    return whole.mapInArrow(_documents, f"doc_id long, {', '.join(f'{c} long' for c in COUNTS)}, groups_sha256 string")


def query(spark, folder: str) -> DataFrame:
    import public_tokenizers as tokenizers

    return linked_counts(spark.read.parquet(f"{folder}/documents.parquet"), tokenizers.path("byte_bpe_50k.json"), tokenizers.path("piece_bpe_32k.model"))
