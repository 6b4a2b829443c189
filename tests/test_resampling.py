"""Resampling: hashes in blocks, shared controls."""

import datetime as dt
import hashlib

import numpy as np
import pytest

from asofkit.operators import evidence as ev

ORIGIN = dt.datetime(2000, 1, 1)
SCHEMA = "origin timestamp_ntz, seed int, policy string, entity long, truth int, prediction double"


def test_hash_words_equal_hashlib():
    firsts, seconds = ["", "7", "a|b", "é" * 25, "x" * 51, "x" * 52, "y" * 90], [str(k) for k in (0, 9, 10, 150)]
    found = ev.hash_words(firsts, seconds)
    for i, a in enumerate(firsts):
        for j, b in enumerate(seconds):
            assert (found[i, j] == np.frombuffer(hashlib.md5(f"{a}|{b}".encode()).digest(), ">u4")).all(), (a, b)


def _evidence(spark, missing=()):
    rows = [(ORIGIN, 0, p, e, e % 3 % 2, (e * k % 11) / 11) for k, p in ((3, "incumbent"), (5, "a"), (7, "b"), (8, "c"))
            for e in range(60) if (p, e) not in missing]
    return spark.createDataFrame(rows, SCHEMA)


def test_controls_are_resampled_once(spark, monkeypatch):
    """Policies on the same rows share their control; others keep their own, with the same bounds as alone."""
    sizes, areas = [], ev._resampled_areas

    def spy(rows, *rest):
        sizes.append(rows.count())
        return areas(rows, *rest)

    monkeypatch.setattr(ev, "_resampled_areas", spy)
    for missing, size in (((), 4 * 60), ([("b", 5)], 2 * (60 + 59 + 60))):
        frame = _evidence(spark, missing)
        together = {r["policy"]: r["lower_bound"] for r in ev.gain_lower_bounds(frame, ["a", "b", "c"], 20, 0.1).collect()}
        assert sizes == [size]
        alone = {p: ev.gain_lower_bounds(frame, [p], 20, 0.1).first()["lower_bound"] for p in "abc"}
        assert together == alone
        sizes.clear()


def _plain_resample(rows, repeats, alpha, task):
    """Every draw made one by one; entities in hash order."""
    def number(*parts):
        return int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:8], 16)

    places = sorted({r[0] for r in rows}, key=lambda e: (number(e), e))
    gains = []
    for repeat in range(repeats):
        drawn = [places[number(repeat, d) % len(places)] for d in range(len(places))]
        weighted = [(drawn.count(e), *rest) for e, *rest in rows if e in drawn]
        if task == "regression":
            gains.append(sum(w * (abs(t - a) - abs(t - b)) for w, t, a, b in weighted) / sum(w for w, *_ in weighted))
            continue
        value = []
        for side in (2, 3):
            pos, neg = [(r[0], r[side]) for r in weighted if r[1] == 1], [(r[0], r[side]) for r in weighted if r[1] == 0]
            both = sum(w for w, _ in pos) * sum(w for w, _ in neg)
            value.append(sum(w * v * ((s > z) + 0.5 * (s == z)) for w, s in pos for v, z in neg) / both if both else None)
        if None not in value:
            gains.append(value[1] - value[0])
    return float(np.quantile(gains, alpha)), len(gains)


@pytest.mark.parametrize("task", ["classification", "regression"])
@pytest.mark.parametrize("chunk, places", [(512, 4096), (7, 8)])
def test_recent_resample_equals_single_draws(spark, monkeypatch, task, chunk, places):
    """Repeated rows, a row without truth, ties, blocks smaller than the entities; no draw is a row."""
    monkeypatch.setattr(ev, "DRAWS", chunk)
    monkeypatch.setattr(ev, "PLACES", places)
    monkeypatch.setattr(ev, "CHUNK", 5)
    rows = [(e, e % 3 % 2, (3 * e % 11) / 11, (5 * e % 7) / 7) for e in range(40)] + [(4, 1, 0.5, 0.25)]
    data = [(ORIGIN, 0, p, r[0], r[1], r[k]) for r in rows[:40] for k, p in ((2, "incumbent"), (3, "a"))]
    data += [(ORIGIN, 0, "incumbent", 40, None, 0.5), (ORIGIN, 0, "a", 40, None, 0.5), (ORIGIN, 0, "a", 7, 1, 0.25), (dt.datetime(1999, 1, 1), 0, "a", 99, 1, 0.1)]
    rows = [*rows[:40], (7, 7 % 3 % 2, (21 % 11) / 11, 0.25)]
    found = ev.recent_resample(spark.createDataFrame(data, SCHEMA), "a", 30, 0.2, task).first()
    if task == "classification":
        expected, count = _plain_resample([*rows, (40, 2, 0.5, 0.5)], 30, 0.2, task)
    else:
        # The row without truth adds weight and no loss.
        expected, count = _plain_resample([*rows, (40, 0.5, 0.5, 0.5)], 30, 0.2, task)
    assert (found["recent_lower_bound"], found["repeats"]) == (pytest.approx(expected, abs=1e-9), count)
