"""Forward messages stand once for each row and class, whatever the number of labels."""

import datetime as dt
import random
from collections import Counter

import pytest

from asofkit.learning import heads
from asofkit.requests import Requests

START = dt.datetime(2000, 1, 1)


def day(n):
    return START + dt.timedelta(days=n)


@pytest.mark.parametrize("limit", [256, 2])
def test_rows_stand_once_for_each_class(spark, monkeypatch, limit):
    monkeypatch.setattr("asofkit.requests.GRID_LIMIT", limit)
    draw = random.Random(3)
    facts = [(draw.choice("abc"), day(draw.randrange(30)), float(i)) for i in range(40)] + [(None, day(1), 40.0), ("a", None, 41.0)]
    labels = [(draw.choice("abc"), day(t), float(draw.randrange(2)), day(t + 4)) for t in range(0, 30, 2)]
    labels += [labels[0], (labels[1][0], labels[1][1], 1.0, None), ("z", day(3), 1.0, day(9))]
    cutoffs = [day(15), day(40)]
    expected = {}
    for cutoff in cutoffs:
        sums = Counter()
        for e, ts, y, available in labels:
            same = sum(1 for other in labels if other[:2] == (e, ts))
            before = [f for f in facts if f[0] == e and f[1] is not None and f[1] < ts]
            for f in before:
                if available is not None and available < cutoff:
                    sums[(f[2], y)] += 1 / (same * len(before))
        expected[cutoff] = sums
    trained = []
    fit = heads._logistic

    def spy(rows, inputs, *rest):
        trained.append([(r["x"], r["label"], r["weight"]) for r in rows.collect()])
        return fit(rows, inputs, *rest)

    monkeypatch.setattr(heads, "_logistic", spy)
    history = spark.createDataFrame(labels, "entity string, ts timestamp_ntz, y double, available_at timestamp_ntz")
    frame = spark.createDataFrame([(e, c) for e in "abcz" for c in cutoffs], "entity string, cutoff timestamp_ntz")
    known = spark.createDataFrame(facts, "entity string, known timestamp_ntz, x double")
    out = {(r["entity"], r["cutoff"]): r for r in heads.forward_messages(Requests(frame, tuple(cutoffs)), history, known, ["x"]).collect()}
    for rows, sums in zip(trained, expected.values(), strict=True):
        assert {(x, y): pytest.approx(w) for x, y, w in rows} == dict(sums)
        assert len(rows) == len(sums)
    assert out[("z", cutoffs[1])]["rows"] == 0
    for e in "abc":
        assert out[(e, cutoffs[0])]["rows"] == sum(1 for f in facts if f[0] == e and f[1] is not None and f[1] < cutoffs[0])
