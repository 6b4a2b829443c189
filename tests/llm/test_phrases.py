"""Mined phrases against a plain count of all phrases."""

import random
import re
from collections import Counter

import duckdb
import pytest

from asofkit.llm import phrases
from tests.conftest import DATA
from tools.compare import rows_of


def brute(rows, least, top):
    counts, words, out = {}, Counter(), []
    for lang, text in rows:
        lang = lang or "und"
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", lower):
            w = [x for x in re.split(r"[\x20\x09]+", piece) if x]
            words[lang] += len(w)
            for k in range(1, 6):
                for i in range(len(w) - k + 1):
                    key = (lang, tuple(w[i : i + k]))
                    counts[key] = counts.get(key, 0) + 1
    candidates = {key: a for key, a in counts.items() if a >= least and len(key[1]) > 1}
    gone = set()
    for (lang, w), a in candidates.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                if a >= candidates[lang, w[i : i + k]]:
                    gone.add((lang, w[i : i + k]))
    for (lang, w), a in candidates.items():
        if (lang, w) not in gone:
            cuts = [(1000 * a * words[lang] // (counts[lang, w[:k]] * counts[lang, w[k:]]), k) for k in range(1, len(w))]
            score, k = min(cuts)
            out.append((lang, -score, -a, " ".join(w).encode(), a, counts[lang, w[:k]], counts[lang, w[k:]], words[lang]))
    out.sort()
    ranks, result = Counter(), []
    for lang, score, _, phrase, a, left, right, n in out:
        ranks[lang] += 1
        if ranks[lang] <= top:
            result.append((lang, ranks[lang], phrase.decode(), a, left, right, n, -score))
    return sorted(result)


def corpus():
    rng = random.Random(11)
    common = "of the and to in it".split()
    rare = [f"w{i}" for i in range(60)]
    passages = [" ".join(rng.sample(rare, 9)) for _ in range(4)] + ["Öl und Zürich ABC x", "tab\tone two\tthree"]
    rows = []
    for k in range(150):
        words = [rng.choice(common) if rng.random() < 0.7 else rng.choice(rare) for _ in range(rng.randint(0, 40))]
        at = rng.randint(0, len(words))
        words[at:at] = [rng.choice(passages) + rng.choice(["", ".", "!", "\n", ",,"])]
        rows.append((rng.choice(["en", "en", "de", None]), " ".join(words)))
    return [*rows, ("en", None), (None, ""), ("fr", " \t \n.,;"), ("fr", "one two"), ("und", "of the of the of the"), rows[0], rows[0], ("en", "the of " * 3000), ("es", "a\x0bb a\x0cb a\x1cb")]


@pytest.mark.parametrize(("least", "top", "most", "bits"), [(3, 5, 100, 12), (3, 60, 1 << 20, 16), (12, 3, 50, 15), (2, 4000, 2000, 16), (10_000, 5, 100, 15)])
def test_equals_plain_count(spark, least, top, most, bits):
    rows = corpus()
    docs = spark.createDataFrame([(lang, text, 1, 2) for lang, text in rows], "lang string, text string, n long, rank long").repartition(3)
    out = phrases.mine(docs, least, top, bits, most)
    assert sorted(map(tuple, out.collect())) == brute(rows, least, top)


def test_empty_table(spark):
    assert phrases.mine(spark.createDataFrame([], "lang string, text string")).collect() == []


def test_driver_table(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{DATA}/documents.parquet')")
    relation = con.execute(phrases.SQL)
    names = [d[0] for d in relation.description]
    out = phrases.query(spark, DATA)
    assert sorted(names) == sorted(out.columns)
    assert rows_of(out.columns, out.collect()) == rows_of(names, relation.fetchall())


def test_slices_of_blocks(monkeypatch):
    """What a scan sees does not depend on where slices end."""
    import numpy as np
    import zstandard

    rng = np.random.default_rng(1)
    pack = lambda a: zstandard.compress(a.tobytes())
    row = {"vocabulary": pack(rng.integers(1, 2**63, 30).astype(np.uint64)), "ids": pack(rng.integers(0, 31, 200).astype(np.int32))}
    known = phrases.Filter(zstandard.compress(b"\xff" * 4096), 15)
    seen = []
    for size in (7, 1, 200):
        monkeypatch.setattr(phrases, "SLICE_WORDS", size)
        out = []
        for h, runs, whole in phrases._phrases(row, known, 5):
            n = len(runs[0])
            out += zip(h[:n].tolist(), *(np.where(w, r, 0).tolist() for r, w in zip(runs, whole, strict=True)), *(h[k : n + k].tolist() for k in range(2, 7)), strict=True)
        seen.append(out)
    assert seen[0] == seen[1] == seen[2] and len(seen[0]) == 200
