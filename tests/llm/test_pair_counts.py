"""Aligned token pairs against a plain count."""

import hashlib
import random
from collections import Counter

import pytest

from asofkit.llm import pair_counts
from tests.conftest import DATA

P = pytest.importorskip("public_tokenizers")
A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


def encoders():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def brute(rows):
    """The contract's columns by whole texts, byte offsets and one counter."""
    a, b = encoders()
    of = pair_counts.byte_of_character()
    names = {k: t for t, k in a.get_vocab().items()}
    docs, total = [], Counter()
    for key, text in rows:
        links, groups, ids_a, ids_b = [], [], [], []
        if text:
            ids_a, ids_b = a.encode(f" {text}", add_special_tokens=False).ids, b.encode(text)
            bytes_a = [bytes(of[c] for c in names[t]) for t in ids_a]
            bytes_b = [bytes([int(p[3:5], 16)]) if len(p := b.id_to_piece(t)) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode() for t in ids_b]
            if b"".join(bytes_a) != f" {text}".encode() or b"".join(bytes_b) != f" {text}".encode():
                ids_a, ids_b = [], []
            ends = []
            for ids, data in ((ids_a, bytes_a), (ids_b, bytes_b)):
                at, out = 0, {}
                for k in range(len(ids)):
                    at += len(data[k])
                    out[at] = k
                ends.append(out)
            last = (-1, -1)
            for at in sorted(set(ends[0]) & set(ends[1])):
                i, j = ends[0][at], ends[1][at]
                links.append((ids_a[i], ids_b[j]))
                groups.append(f"{','.join(map(str, ids_a[last[0] + 1 : i + 1]))}|{','.join(map(str, ids_b[last[1] + 1 : j + 1]))}")
                last = (i, j)
        total.update(links)
        docs.append((key, len(ids_a), len(ids_b), links, ";".join(groups)))
    best = Counter()
    for (_, y), n in total.items():
        best[y] = max(best[y], n)
    return [
        (key, n_a, n_b, len(links), len(links), sum(total[p] == best[p[1]] for p in links), sum(total[p] for p in links), hashlib.sha256(groups.encode()).hexdigest() if links else "")
        for key, n_a, n_b, links, groups in docs
    ]


def texts():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice(["th", "er", "ing", "ó", "ß", "an", "e", "qu", "-", "'s", "42"]) for _ in range(rng.randint(1, 4)))
    made = [" ".join(word() for _ in range(rng.randint(1, 60))) for _ in range(60)]
    lines = ["\n".join(" ".join(word() for _ in range(6)) for _ in range(8)) for _ in range(8)]
    odd = [
        None, "", " ", "a", " leading", "trailing ", "two  spaces", "line\n\nlines", "\nfirst", "last\n", "tab\there", "\x00nul", "<s> </s> <|endoftext|> <0x41> <unk>",
        "漢字 と かな", "emoji 😀😀 done", "▁ low block", "ﬁ ligature", "é combining", "don't we've I'm", "a \n b", "x\r\ny", "word " * 3000 + "end", "z" * 20000, " nbsp",
    ]
    return [*made, *lines, *odd, made[0], made[0], made[1]]


def rows():
    out = [(k % 90, t) for k, t in enumerate(texts())]
    return [*out, (None, "null id"), out[0]]


def order(rows):
    return sorted(rows, key=repr)


@pytest.mark.parametrize("records", [50, 1 << 20])
def test_equals_plain_count(spark, records):
    made = rows()
    docs = spark.createDataFrame([(k, t, "b", 1, 2) for k, t in made], "doc_id long, text string, block string, part int, n_a int").repartition(3)
    out = pair_counts.linked_counts(docs, A, B, parts=5, most=records)
    assert order(map(tuple, out.collect())) == order(brute(made))


def test_whole_and_word_paths_agree():
    both = pair_counts.Aligner(A, B, most=20)
    made = [t for t in texts() if t]
    slow = pair_counts.Aligner(A, B)
    slow.splits = False
    assert both.splits
    assert list(both.align(made)) == list(slow.align(made))


def test_tables_without_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert pair_counts.linked_counts(docs, A, B).collect() == []


def test_driver_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    assert order(map(tuple, pair_counts.query(spark, DATA).collect())) == order(brute(rows))
