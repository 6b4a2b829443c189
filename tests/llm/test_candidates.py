"""How many pairs the n-gram join makes where many documents share a passage."""

import random

import pytest

from asofkit.llm import ngram_join


@pytest.mark.parametrize("group", [60, 150])
def test_a_shared_passage_brings_no_pairs(spark, monkeypatch, group):
    """Pairs made grow with the group at most, and near copies inside it are still found."""
    rng, made, link = random.Random(group), [], ngram_join.link

    def counting(entries, refine, verify, **limits):
        def counted(pairs):
            made.append(pairs.count())
            return verify(pairs)

        return link(entries, refine, counted, **limits)

    monkeypatch.setattr(ngram_join, "link", counting)
    word = lambda: f"w{rng.randint(0, 10**9)}"
    passage = " ".join(word() for _ in range(90))
    texts = [f"{' '.join(word() for _ in range(60))} {passage} {' '.join(word() for _ in range(50))}" for _ in range(group)]
    texts += [" ".join(word() for _ in range(8)) for _ in range(200)]
    texts += [f"{texts[0]} more", f"{texts[1]} and more"]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(2)
    found = {r.doc_id: r.component_id for r in ngram_join.classes(docs).collect()}
    last = len(texts) - 1
    assert {k: c for k, c in found.items() if c != k} == {last - 1: 0, last: 1}
    assert sum(made) <= 2 * group


def test_blocks_find_every_component(spark, monkeypatch):
    """Many near copies that are linked in part only: stars leave them apart, blocks join them as brute force does."""
    rng, link = random.Random(5), ngram_join.link
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", 8)
    met = []

    def small(entries, refine, verify, blocks, **limits):
        def counted(kept):
            met.append(kept.count())
            return blocks(kept)

        return link(entries, refine, verify, dense=2, first=2, blocks=counted)

    monkeypatch.setattr(ngram_join, "link", small)
    base, texts = [f"w{k}" for k in range(120)], []
    for _ in range(90):
        words = list(base)
        for place in rng.sample(range(120), rng.choice([1, 1, 2, 3])):
            words[place] = f"x{rng.randint(0, 3)}"
        texts.append(" ".join(words))
    texts += [None, "", texts[0], "short one"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    found = {r.doc_id: r.component_id for r in ngram_join.classes(docs).collect()}
    grams = [{tuple(w[i : i + 4]) for i in range(max(len(w) - 3, 1))} if w else set() for w in ((t or "").split() for t in texts)]
    root = list(range(len(texts)))
    for _ in texts:
        for i, a in enumerate(grams):
            for j, b in enumerate(grams):
                if a and b and 100 * len(a & b) >= 85 * len(a | b):
                    root[i] = root[j] = min(root[i], root[j])
    assert met and found == dict(enumerate(root))
    assert len(set(root[:90])) > 1 and max(map(root.count, root)) > 10


def test_shared_counts_in_chunks():
    rng = random.Random(3)
    sets = [ngram_join.np.array(sorted(rng.sample(range(60), rng.randint(0, 30))), "u8") for _ in range(12)]
    found = ngram_join.shared_counts(sets[:5], sets[5:], chunk=7)
    assert found.tolist() == [[len({*a.tolist()} & {*b.tolist()}) for b in sets[5:]] for a in sets[:5]]
