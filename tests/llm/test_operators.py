"""Each operator against a brute-force version on small rows with nulls, empty and long texts, ties and repeats."""

import bisect
import hashlib
import math
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from asofkit.llm import line_join, mixing, ngram_join, pattern_packing, progressive_jpeg, registry, rule_ledger, separator_scan, snapshots, super_kmers, warc
from asofkit.llm.shared import NULL_ID, components, link, new_folder
from tests.conftest import DATA
from tools.compare import TABLES, rows_of

P = pytest.importorskip("public_tokenizers")
TOKENIZER = P.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, source string, lang string, n_words long, id long, node long"


def prose(rng, n):
    return " ".join(rng.choice("alpha beta gamma delta eps zeta eta theta iota kappa".split()) + str(rng.randint(0, 400)) for _ in range(n))


def corpus():
    rng = random.Random(7)
    base = [prose(rng, n) for n in (60, 120, 45, 300, 24)]
    near = base[1].split()
    near[40] = "changed"
    shared = prose(rng, 30)
    line = "this very line is found in more than one document"
    texts = [
        *base, " ".join(near), base[0], base[0], f"{prose(rng, 12)} {shared} {prose(rng, 9)}", f"{shared} {prose(rng, 20)}",
        None, "", "   \n\t ", "one", "Ünï çode \x0b words", "same " * 90, "", f"{line}\n{prose(rng, 15)}", f"{prose(rng, 14)}\n{line}s\n\n  {line}", prose(rng, 3000) + "\n" + line,
        "a" * 5000, "x y z", "#1 $2 %3 &4 |5 <6>",
    ]
    rows = [(i * 7 % 23, t, None if i == 3 else f"s{i % 4}", "en", -1, -2, -3) for i, t in enumerate(texts)]
    return [*rows, rows[0], (None, base[2], "s1", "en", -1, -2, -3), (rows[4][0], "another text under an id that is taken", "s0", "en", -1, -2, -3)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def split(text):
    return [w for w in (text or "").encode().split()]


def in_order(rows):
    return sorted(rows, key=repr)


@pytest.mark.parametrize("name", list(registry.ORACLES))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    frame = registry.QUERIES[name](spark, DATA)
    relation = con.execute(registry.ORACLES[name])
    names = [d[0] for d in relation.description]
    assert rows_of(frame.columns, frame.collect()) == rows_of(names, relation.fetchall())


def test_token_counts(spark, docs, empty):
    tokenizer = pattern_packing.token_bytes(TOKENIZER).tokenizer
    expected = in_order((r[0], len(tokenizer.encode(r[1] or "", add_special_tokens=False).ids)) for r in corpus())
    for block in (7, 1_000_000):  # boundaries inside headers, documents and runs of documents
        assert in_order(tuple(r) for r in separator_scan.token_counts(docs, TOKENIZER, block=block).collect()) == expected
    assert separator_scan.token_counts(empty, TOKENIZER).count() == 0


def test_scan_of_an_unended_file(spark):
    from asofkit.llm.shared import file_store

    folder = new_folder(spark, "flat")
    store, base = file_store(folder)
    store.create_dir(base, recursive=True)
    with store.open_output_stream(f"{base}/f.u16") as f:
        f.write(np.array([1, 2, 9, 9, 3, 4, 5], "<u2").tobytes())
    files = spark.createDataFrame([("f.u16", 7)], "path string, tokens long")
    found = separator_scan.scan(files, folder, eod=9, block=2, keep=2).collect()
    assert in_order((r.ordinal, r.n_tokens, r.first, r.ended) for r in found) == [(0, 2, [1, 2], True), (1, 0, [], True), (2, 3, [3, 4], False)]


def brute_classes(rows, percent=85, width=4):
    sets = []
    for r in rows:
        w = [x.lower() for x in split(r[1])]
        k = min(width, len(w))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set())
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    return sets, group


def test_word_hashes_tell_words_apart():
    rng = random.Random(3)
    long = b"q" * 9000
    texts = [bytes(rng.choice(b"ab \t\n\x0b\x1cxy\xc3\xa9\x00") for _ in range(rng.randint(0, 60))) for _ in range(500)]
    seen = {}
    for text in [*texts, b"", b" ", long + b" " + long[:-1] + b"r z " + long]:
        for block in (1, 7, 1 << 20):
            hashes, lengths = ngram_join.word_hashes(text, block)
            words = text.split()
            assert lengths.tolist() == [len(w) for w in words]
            for word, value in zip(words, hashes.tolist(), strict=True):
                assert seen.setdefault(word, value) == value
    assert len(set(seen.values())) == len(seen)


def test_ngram_join(spark, docs, empty):
    rows = corpus()
    sets, group = brute_classes(rows)
    least = lambda g: min((r[0] for r, x in zip(rows, group, strict=True) if x == g), key=lambda d: (d is not None, d))
    expected = in_order((r[0], len(s), least(g) if s else r[0]) for r, s, g in zip(rows, sets, group, strict=True))
    found = ngram_join.classes(docs)
    assert in_order((r.doc_id, r.n_shingles, r.component_id) for r in found.collect()) == expected
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns
    filled = {g for g, s in zip(group, sets, strict=True) if s}
    assert sum(bool(split(r.text)) for r in kept.collect()) == len(filled)
    assert ngram_join.classes(empty).count() == 0 and ngram_join.keep_one(empty).count() == 0


def test_near_duplicates_stage(spark):
    words = iter(range(100_000))
    texts = []
    for n, changed in ((49, (20,)), (50, (25,)), (52, (30,)), (94, (30, 60)), (101, (20, 70)), (40, (20,)), (60, (30,)), (60, (20, 40))):
        base = [f"w{next(words)}" for _ in range(n)]
        texts += [" ".join(base), " ".join("changed" if i in changed else w for i, w in enumerate(base))]
    rows = [(i, text) for i, text in enumerate([*texts, texts[0], "one two", "one two", "", None])]
    sets, group = brute_classes(rows, 80, 5)
    assert group != brute_classes(rows)[1]
    first = {}
    expected = [r[0] for r, s, g in zip(rows, sets, group, strict=True) if not s or first.setdefault(g, r[0]) == r[0]]
    found = ngram_join.stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert sorted(r.doc_id for r in found.collect()) == expected


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (7, 7), (102, 101)]
    found = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.root for r in found} == {**{i: 1 for i in range(1, 41)}, 100: 100, 101: 100, 102: 100}


def test_link_of_large_keys(spark):
    rng = random.Random(4)
    names = rng.sample(range(10_000), 1_200)
    # (key, nodes): all nodes of a group are linked, others are not. Stars alone bring most of these keys from above dense to below.
    groups = [(key, [names.pop() for _ in range(size)]) for key in range(40) for size in (8, 6, 2, 2, 2)]
    nodes = spark.createDataFrame([(key, node, g) for g, (key, held) in enumerate(groups) for node in held], "key long, node long, g long").cache()

    def entries(level, kept):
        rows = nodes.select("key", "node") if not level else kept.join(nodes.select("node", "g"), "node").selectExpr("xxhash64(key, g) AS key", "node")
        return rows.selectExpr("key", "node", "true AS idx", "true AS prb")

    def verify(pairs):
        a, b = (nodes.selectExpr(f"node AS {s}", f"g AS g{s}") for s in "ab")
        return pairs.join(a, "a").join(b, "b").filter("ga = gb").select("a", "b").distinct()

    found = {r.node: r.root for r in link(entries, 1, verify, dense=8).collect()}
    assert found == {node: min(held) for _, held in groups for node in held}


def test_warc(spark):
    same = "<p>" + "same" * 400
    rows = [(1, "u", same, 1), (5, None, same, 1), (3, "v", same, 1), (2, "w", None, 1), (4, "x", "", 1), (6, 'q"\r\nx', "short", 1), (7, "y", "short", 1), (5, None, same, 1), (None, "n", same, 1), (8, "z", "ü\u0000" * 900, 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest long")
    folder = new_folder(spark, "warc")
    manifest = warc.write(pages, folder, roll=200, shard_rows=2)
    first = {r.path: r.sha1 for r in manifest.collect()}
    found = warc.read(manifest, folder).collect()
    expected = []
    for page, url, html, _ in rows:
        data = (html or "").encode()
        revisit = html == same and page != 5
        expected.append((page, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", 5 if revisit else None, url or "", None if revisit else data))
    assert in_order(tuple(r[:6]) + (None if r[6] is None else bytes(r[6]),) for r in found) == in_order(expected)
    again = warc.write(pages.repartition(5), new_folder(spark, "warc"), roll=200, shard_rows=2)
    assert {r.path: r.sha1 for r in again.collect()} == first and len(first) > 3
    nothing = warc.write(pages.limit(0), folder)
    assert warc.read(nothing, folder).count() == 0


def test_packing(spark, docs, empty):
    tokenizer = pattern_packing.token_bytes(TOKENIZER).tokenizer
    found = [r.asDict() for r in pattern_packing.pack(pattern_packing.pieces(docs, TOKENIZER, 64), 64).collect()]
    expected = []
    for doc, text, *_ in corpus():
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        head = (len(ids) - 1) % 64 + 1
        starts = [0, *range(head, len(ids), 64)]
        for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)], strict=True)):
            expected.append((doc, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    assert in_order((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found) == in_order(expected)
    check_packed([(r["sequence_id"], r["offset"], r["length"]) for r in found], 64)
    assert pattern_packing.pack(pattern_packing.pieces(empty, TOKENIZER)).count() == 0


def check_packed(rows, capacity):
    rows = sorted(rows)
    at = {}
    for sequence, offset, length in rows:
        assert offset == at.get(sequence, 0)
        at[sequence] = offset + length
    assert max(at.values()) <= capacity
    return len(at)


@pytest.mark.parametrize("low, high, better", [(1, 1025, 0), (1, 40, 0), (300, 700, 0), (500, 520, 0), (200, 256, 40), (120, 180, 80)])
def test_plan_needs_no_more_sequences_than_best_fit(low, high, better):
    lengths = np.random.default_rng(3).integers(low, high, 20_000)
    counts = np.bincount(lengths, minlength=1025)
    rows = []
    for n, (first, sequences, offsets) in pattern_packing.plan(counts, 1024).items():
        rank = np.arange(counts[n])
        run = np.searchsorted(first, rank, "right") - 1
        rows += zip((sequences[run] + rank - first[run]).tolist(), offsets[run].tolist(), [n] * len(rank), strict=True)
    assert len(rows) == len(lengths)
    used = check_packed(rows, 1024)
    free = []
    for n in sorted(lengths.tolist(), reverse=True):  # best fit decreasing, piece by piece
        at = bisect.bisect_left(free, n)
        bisect.insort(free, (free.pop(at) if at < len(free) else 1024) - n)
    assert used <= len(free) - better


def test_token_bytes_equal_the_tokenizer():
    tokens = pattern_packing.token_bytes(TOKENIZER)
    texts = ["", " ", "\n", " a", "a ", "a\n", "\na", "a  b", "a   b", "a \nb", "a\n b", "don't we'll", "x y", "tab\tb", "中文 z", "<|endoftext|> hi", "a\r\nb", "1 22 3³", "é\nü ö", "a \x1c b", "a\x85b", None]
    expected = [np.array(e.ids, "<u4").tobytes() for e in tokens.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert list(tokens.ids(texts)) == expected


SLOTS = ("doc_id", "source", "sig", "taken", "first_slot", "last_slot", "n_pieces")


def scheduled(rows, names, goal, size, block):
    """What each row gives, slot by slot of the golden-ratio schedule."""
    goals = [round(goal[s]) for s in names]
    slots = -(-sum(goals) // block)
    phi, got = (5**0.5 - 1) / 2, {s: [] for s in names}
    for slot in range(slots):
        point = slot * phi + phi
        point = (point - math.floor(point)) * sum(goals)
        got[names[next(i for i in range(len(goals)) if point < sum(goals[: i + 1]))]].append(slot)
    for s, words in zip(names, goals, strict=True):
        order = sorted((r for r in rows if r["source"] == s), key=lambda r: (hashlib.md5(f"{'' if r['doc_id'] is None else r['doc_id']}/{s or ''}".encode()).hexdigest(), r["sig"]))
        stream = [(i, e) for e in (0, 1) for i, r in enumerate(order) for _ in range(r["size"])][:words]
        given = [[] for _ in order]
        for at, (i, e) in enumerate(stream):
            k = at // block
            given[i].append((got[s][k] if k < len(got[s]) else slots + k, e))
        for r, some in zip(order, given, strict=True):
            first, last = (min(some)[0], max(some)[0]) if some else (None, None)
            yield r["doc_id"], s, r["sig"], len(some), first, last, len(set(some))


def test_mixing(spark, docs, empty):
    found = [r.asDict() for r in mixing.mix(docs, block=16).collect()]
    rows = corpus()
    assert in_order((r["doc_id"], r["size"], r["source"]) for r in found) == in_order((r[0], len(split(r[1])), r[2]) for r in rows)
    goal, taken, size = {}, {}, {}
    for r in found:
        goal[r["source"]] = r["target"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        size[r["source"]] = size.get(r["source"], 0) + r["size"]
        assert 0 <= r["taken"] <= 2 * r["size"]
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    open_, left, expected = set(names), 1.5 * sum(size.values()), {}
    while open_:
        share = {s: left * weights[s] / sum(weights[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] >= 2 * size[s]}
        if not over:
            expected.update(share)
            break
        expected.update({s: 2 * size[s] for s in over})
        left -= sum(2 * size[s] for s in over)
        open_ -= over
    for s in names:
        assert goal[s] == pytest.approx(expected[s]) and taken[s] == round(goal[s])
    assert in_order(tuple(r[c] for c in SLOTS) for r in found) == in_order(scheduled(found, names, goal, size, 16))
    out = mixing.stage(spark, docs, "")
    assert out.columns == docs.columns and in_order(map(repr, mixing.mix(docs, 16).collect())) == in_order(map(repr, mixing.mix(docs.repartition(2), 16).collect()))
    assert mixing.mix(empty).count() == 0 and mixing.stage(spark, empty, "").count() == 0


def test_rule_ledger(spark, docs, empty):
    book = rule_ledger.ledger(docs)
    expected = []
    for doc, text, *_ in corpus():
        words = split(text)
        windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
        cover = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(5)}
        expected.append((doc, len(words), sum(len(w.decode()) for w in words), sum((text or "").count(c) for c in "#*$%&|<>"), len(cover)))
    assert in_order((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_repeat_words) for r in book.select("row.doc_id", *rule_ledger.MEASURES).collect()) == in_order(expected)
    kept = rule_ledger.apply_policy(book, rule_ledger.STRICT)
    assert kept.columns == docs.columns
    cut = {r.rule: r for r in rule_ledger.ablations(book, rule_ledger.STRICT).collect()}
    without = rule_ledger.Policy("x", tuple(r for r in rule_ledger.STRICT.rules if r != "few_words"))
    assert cut["few_words"].kept_without == rule_ledger.apply_policy(book, without).count()
    assert cut["few_words"].failing == sum(len(split(r[1])) < 10 for r in corpus())
    assert rule_ledger.ledger(empty).count() == 0


@pytest.mark.parametrize("hot", [1, 256])
def test_super_kmers(spark, docs, empty, monkeypatch, hot):
    monkeypatch.setattr(super_kmers, "HOT", hot)
    rows = corpus()
    keyed = sorted({((r[0] is not None, r[0] or 0), s, r[1] or "") for r, s in zip(rows, [x.sig for x in spark.createDataFrame(rows, SCHEMA).select(*super_kmers.row_key()).collect()], strict=True)})
    seen, kept = set(), {}
    for key, sig, text in keyed:
        words = split(text)
        gone = set()
        for i in range(len(words) - 19):
            window = tuple(words[i : i + 20])
            if window in seen:
                gone |= set(range(i, i + 20))
            seen.add(window)
        kept[key, text] = (len(words), len(gone), b" ".join(w for i, w in enumerate(words) if i not in gone).decode())
    expected = in_order((r[0], *kept[(r[0] is not None, r[0] or 0), r[1] or ""]) for r in rows)
    assert in_order(tuple(r) for r in super_kmers.without_repeats(docs).collect()) == expected
    assert super_kmers.without_repeats(empty).count() == 0


@pytest.mark.parametrize("crowd", [0, 40, 1 << 17])
def test_super_kmers_crowds(spark, monkeypatch, crowd):
    """Hot minimisers give the same rows from buckets as from windows, and what lies under CROWD makes no row for each window."""
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(w if (i + 7 * k) % 23 else f"x{i}" for k, w in enumerate(words))) for i in range(40)] + [(99, " ".join(["same"] * 70)), (100, " ".join(words))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    cold = in_order(tuple(r) for r in super_kmers.without_repeats(docs).collect())
    monkeypatch.setattr(super_kmers, "HOT", 1)
    monkeypatch.setattr(super_kmers, "CROWD", crowd)
    assert in_order(tuple(r) for r in super_kmers.without_repeats(docs).collect()) == cold
    firsts = super_kmers.marks(docs, super_kmers.packed_texts(docs)).filter("kind = 'FIRST'").agg(F.count(F.lit(1)).alias("rows"), F.sum("windows").alias("windows")).first()
    assert (firsts.rows == firsts.windows) == (crowd == 0)


def test_snapshots(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "bot", "yo"), (2, 0, "user", "hi"), (3, 0, "user", "hi"), (3, 1, "bot", "yo"), (3, 2, "user", None), (4, 0, "user", "hi"), (4, 1, "bot", "other"),
            (5, 0, "user", "hi"), (5, 1, "bot", "yo"), (5, 2, "user", ""), (6, 0, None, ""), (None, 0, "a", "b"), (7, 0, "a", "b"), (7, 0, "a", "b"), (7, None, "z", "first")]
    rows += [(8, i, "user", str(i)) for i in range(1200)] + [(9, i, "user", str(i)) for i in range(700)]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn int, role string, text string, place long")
    found = snapshots.render(frame).collect()
    assert sorted({(str(r.conv_id), r.n_turns) for r in found}) == sorted([("3", 3), ("4", 2), ("6", 1), ("None", 1), ("7", 2), ("8", 1200)])
    parts = {(r.conv_id, r.part): r.text for r in found}
    assert parts[7, 0] == "<|im_start|>z\nfirst<|im_end|>\n<|im_start|>a\nb<|im_end|>\n"
    assert "".join(parts[8, k] for k in range(19)) == "".join(f"<|im_start|>user\n{i}<|im_end|>\n" for i in range(1200))
    assert snapshots.render(frame.limit(0)).count() == 0


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_edit_keys_and_distance():
    rng = random.Random(5)
    for _ in range(4000):
        tau = rng.randint(1, 4)
        a = "".join(rng.choice("abcd") for _ in range(rng.randint(6, 30)))
        b = list(a)
        for _ in range(rng.randint(0, tau + 1)):
            b[rng.randrange(len(b)) : rng.randrange(len(b)) + 1] = [rng.choice("abcd")] if rng.random() < 0.7 else []
            b = b or ["a"]
        b = "".join(b)
        d = distance(a, b)
        assert line_join.within(a, b, tau) == (d <= tau)
        if d <= tau < min(len(a), len(b)):
            short, long = sorted((a, b), key=len)
            own = [s for s in line_join.signatures(short, tau) if s[5]]
            probe = line_join.signatures(long, tau)
            assert {k for s in own for k, idx, _ in line_join.narrowed(short, s, tau) if idx} & {k for s in probe for k, _, prb in line_join.narrowed(long, s, tau) if prb and s[0] in {o[0] for o in own}}


def brute_lines(rows, tau, shortest):
    lines = [(r, pos, line.strip(line_join.SPACE)) for r in rows for pos, line in enumerate((r[2] or "").split("\n"))]
    lines = [x for x in lines if len(x[2]) >= shortest]
    names = sorted({x[2] for x in lines})
    group = {n: n for n in names}
    for i, a in enumerate(names):
        for b in names[:i]:
            if abs(len(a) - len(b)) <= tau and group[a] != group[b] and distance(a, b) <= tau:
                x, y = group[a], group[b]
                group = {k: y if v == x else v for k, v in group.items()}
    first, gone = {}, {}
    for r, pos, line in sorted(lines):
        if first.setdefault(group[line], (r, pos)) != (r, pos):
            gone.setdefault(r, []).append(pos)
    return gone


def test_line_join(spark, empty):
    rng = random.Random(2)
    base = ["a common line that many documents hold", "another one, of some length as well 1", "short"]
    rows = []
    for i in range(60):
        lines = []
        for _ in range(rng.randint(1, 4)):
            line = rng.choice([*base, f"item number {rng.randint(0, 9)}{rng.randint(0, 9)} of the long list"])
            if rng.random() < 0.4:
                k = rng.randrange(len(line))
                line = line[:k] + rng.choice("xyz") + line[k + rng.randint(0, 1) :]
            lines.append(rng.choice(["", "  "]) + line)
        rows.append((i % 50, "\n".join(lines)))
    rows += [(70, None), (71, ""), (72, "\n\n"), (None, base[0]), rows[0]]
    frame = spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id long, text string, node long, key string")
    keyed = [((r[0] is not None, r[0] or 0), sig.sig, r[1]) for r, sig in zip(rows, frame.select(*line_join.row_key()).collect(), strict=True)]
    for tau in (1, 2):
        gone = brute_lines(set(keyed), tau, 24)
        found = {((r.id != NULL_ID, r.id if r.id != NULL_ID else 0), r.sig): r.removed for r in line_join.repeats(frame, tau).collect()}
        assert found == {k[:2]: sorted(v) for k, v in gone.items()}
    out = line_join.stage(spark, frame, "")
    assert out.columns == frame.columns
    assert {r.doc_id for r in out.collect()} >= {70, 71, 72}
    assert line_join.stage(spark, empty, "").count() == 0


def test_short_lines(spark, tmp_path):
    long = "a line of more than twenty-four characters"
    texts = ["yes\nno\n\n  yes", f"no \nyep\n\n{long}", f"maybe\n{long}s\nyes", "no", None, "", "\n"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.doc_id: (r.n_removed, r.removed) for r in line_join.query(spark, str(tmp_path)).collect()}
    assert found == {0: (1, [3]), 1: (1, [0]), 2: (2, [1, 2]), 3: (1, [0]), 4: (0, []), 5: (0, []), 6: (0, [])}
    left = {r.doc_id: r.text for r in line_join.stage(spark, frame, "").collect()}
    assert left == {0: "yes\nno\n", 1: f"yep\n\n{long}", 2: "maybe", 4: None, 5: "", 6: "\n"}


def test_jpeg_round_trip(spark, docs, empty):
    found = progressive_jpeg.digests(progressive_jpeg.media(docs)).collect()
    expected = []
    for doc, text, *_ in corpus():
        data = (text or "").encode()
        size = max(64, -(-len(data) // 64) * 64)
        whole = data.ljust(size, b"\0")
        expected.append((doc, len(data), size, hashlib.sha256(whole).hexdigest(), zlib.crc32(whole[-64:])))
    assert in_order(tuple(r)[:5] for r in found) == in_order(expected)
    by_text = {}
    for r in found:
        assert by_text.setdefault((r.n_bytes, r.payload_sha256), (r.media_sha256, r.feature)) == (r.media_sha256, r.feature)
    image = progressive_jpeg.tensors(progressive_jpeg.media(docs)).first()
    assert len(image.rgb) == image.height * image.width * 3
    assert progressive_jpeg.digests(progressive_jpeg.media(empty)).count() == 0


def test_jpeg_long_payload():
    data = random.Random(1).randbytes(64 * 70_000)
    assert progressive_jpeg.payload(progressive_jpeg.Picture(progressive_jpeg.write(data))) == (data, len(data))


def test_jpeg_ordinary_scans():
    """One 8 x 8 grey block by runs, an end of band, and a refinement that makes a new coefficient."""
    bits = lambda s: np.array([int(c) for c in s.replace(" ", "")], np.uint8)
    seg, scan = progressive_jpeg._segment, progressive_jpeg._scan
    frame = seg(0xC2, bytes([8, 0, 8, 0, 8, 1, 1, 0x11, 0]))
    table = lambda kind, *symbols: seg(0xC4, bytes([kind << 4, 0, len(symbols), *[0] * 14, *symbols]))
    data = b"\xff\xd8" + seg(0xDB, bytes([0] + [1] * 64)) + frame
    data += table(0, 3) + scan([1], 0, 0, 0, 1, bits("00 101"))  # DC 5 << 1
    data += table(1, 0x21, 0x00) + scan([1], 1, 63, 0, 1, bits("00 1  01"))  # two zeros, 1 << 1, end of band
    data += table(1, 0x01, 0x00) + scan([1], 1, 63, 1, 0, bits("00 0  01 1"))  # a new -1 first; then the old one gets its bit
    picture = progressive_jpeg.Picture(data + b"\xff\xd9")
    expected = [0] * 64
    expected[0], expected[1], expected[3] = 10, -1, 3
    assert picture.planes[0][0].tolist() == expected
    assert picture.rgb().shape == (8, 8, 3)
