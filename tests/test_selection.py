"""Scores, resampling, admission and sampling rules on small evidence."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from asofkit.operators import evidence as ev
from asofkit.operators import joins as jn
from asofkit.operators import sampling as sp

O1, O2, O3 = (dt.datetime(2024, m, 1) for m in (1, 2, 3))


def brute_auc(truth, score):
    pos = [s for t, s in zip(truth, score) if t]
    neg = [s for t, s in zip(truth, score) if not t]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


def test_auc_with_ties_matches_pairs(spark):
    rng = random.Random(5)
    data = [(g, rng.randrange(2), round(rng.random(), 1)) for g in ("x", "y") for _ in range(120)]
    frame = spark.createDataFrame(data, "g string, truth int, prediction double")
    for g, auc in ev.roc_auc(frame, ["g"]).select("g", "auc").collect():
        part = [(t, s) for k, t, s in data if k == g]
        assert auc == pytest.approx(brute_auc(*zip(*part)))


def test_pair_errors_and_average_precision(spark, rows):
    data = [("c", 1, 0.9), ("c", 0, 0.8), ("c", 1, 0.8), ("c", 0, 0.1), ("c", 1, 0.05)]
    frame = spark.createDataFrame(data, "g string, truth int, prediction double")
    errors = {(r["truth"], r["prediction"]): r["pair_errors"] for r in rows(ev.pair_errors(frame, ["g"]))}
    assert errors == {(1, 0.9): 0.0, (0, 0.8): 0.0, (1, 0.8): 0.5, (0, 0.1): 0.0, (1, 0.05): 2.0}
    expected = (1 * 1 + 1 * (2 / 3) + 1 * (3 / 5)) / 3
    assert ev.average_precision(frame, ["g"]).first()["average_precision"] == pytest.approx(expected)


def _evidence(spark, better, seeds=(0, 1), origins=(O1, O2, O3), n=60):
    rng = random.Random(9)
    data = []
    for o in origins:
        for e in range(n):
            y = rng.randrange(2)
            for s in seeds:
                base = rng.random()
                data.append((o, s, "incumbent", e, y, 0.3 * y + 0.7 * base))
                data.append((o, s, "other", e, y, better * y + (1 - better) * rng.random()))
    return spark.createDataFrame(data, "origin timestamp_ntz, seed int, policy string, entity int, truth int, prediction double")


@pytest.mark.parametrize("better,reason", [(0.9, "eligible"), (-0.5, "no_recent_improvement")])
def test_admission(spark, better, reason):
    rows = _evidence(spark, better)
    out = ev.admission(ev.paired_scores(rows), ev.gain_lower_bounds(rows, ["other"], 40, 0.05)).first()
    assert (out["reason"], out["selected"]) == (reason, reason == "eligible")


def test_missing_seed_blocks_admission(spark):
    rows = _evidence(spark, 0.9).filter(~((F.col("policy") == "other") & (F.col("seed") == 1) & (F.col("origin") == F.lit(O2))))
    out = ev.admission(ev.paired_scores(rows), ev.gain_lower_bounds(rows, ["other"], 10, 0.05)).first()
    assert out["reason"] == "missing_matched_origin_or_seed"


def test_one_origin_is_not_evidence(spark):
    rows = _evidence(spark, 0.9, origins=(O1,))
    out = ev.admission(ev.paired_scores(rows), ev.gain_lower_bounds(rows, ["other"], 10, 0.05)).first()
    assert out["reason"] == "insufficient_temporal_evidence"


def test_vetoes_need_every_blend(spark):
    rows = _evidence(spark, -0.9)
    scores = ev.paired_scores(ev.blends(rows, [0.5]))
    out = {r["policy"]: r["reason"] for r in ev.vetoes(scores, F.lit(O3)).collect()}
    assert set(out) <= {"other", "other__blend_0.5"} and out.get("other") == "no_recent_improvement"
    assert ev.vetoes(ev.paired_scores(ev.blends(_evidence(spark, 0.9), [0.5])), F.lit(O3)).count() == 0


def test_multipliers_are_poisson():
    w = ev.multipliers(range(300), 599)
    assert w.shape == (300, 599) and abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.03 and w.max() < 12
    assert (ev.multipliers(["7"], 10) == w[7, :10]).all()


@pytest.mark.parametrize("task", ["classification", "regression"])
def test_gain_bounds_equal_plain_resampling(spark, task):
    """Ties, a score that fills many buckets, entities in several origins; every repeat recomputed from its weights."""
    rng, repeats = random.Random(4), 37
    rows = []
    for origin in (O1, O2):
        for e in range(120):
            truth = float(rng.random() < 0.4) if task == "classification" else rng.random()
            scores = {p: 0.5 if rng.random() < 0.6 else round(rng.random() * 0.9 + 0.1 * truth, 1) for p in ("incumbent", "a", "b")}
            rows += [(origin, 0, p, e, truth, s) for p, s in scores.items()]
    frame = spark.createDataFrame(rows, "origin timestamp, seed int, policy string, entity long, truth double, prediction double")
    weights = ev.multipliers(range(120), repeats)
    found = {r.policy: (r.lower_bound, r.repeats) for r in ev.gain_lower_bounds(frame, ["a", "b"], repeats, 0.1, task).collect()}
    for policy in ("a", "b"):
        gains = []
        for k in range(repeats):
            total = 0
            for origin in (O1, O2):
                at = {p: [(weights[e, k], t, s) for o, _, q, e, t, s in rows if o == origin and q == p] for p in ("incumbent", policy)}
                if task == "classification":
                    value = {}
                    for p, some in at.items():
                        pos, neg = [(w, s) for w, t, s in some if t], [(w, s) for w, t, s in some if not t]
                        won = sum(w * v * ((s > z) + 0.5 * (s == z)) for w, s in pos for v, z in neg)
                        value[p] = won / (sum(w for w, _ in pos) * sum(v for v, _ in neg))
                    total += 0.5 * (value[policy] - value["incumbent"])
                else:
                    loss = {p: sum(w * abs(t - s) for w, t, s in some) / sum(w for w, _, _ in some) for p, some in at.items()}
                    total += 0.5 * (loss["incumbent"] - loss[policy])
            gains.append(total)
        gains.sort()
        place = 0.1 * (repeats - 1)
        low = int(place)
        assert found[policy] == (pytest.approx(gains[low] + (place - low) * (gains[low + 1] - gains[low]), abs=1e-9), repeats)


def test_trial_rules(spark, rows):
    data = [("wide", 0.80, 0.81, 0.01, 0.82, 0.01, 900, 4), ("mid", 0.795, 0.805, 0.01, 0.815, 0.01, 300, 2), ("bad", 0.60, 0.61, 0.01, 0.60, 0.01, 50, 1)]
    trials = spark.createDataFrame(data, "config string, objective double, score double, error double, recent_score double, recent_error double, features int, complexity int")
    folds = spark.createDataFrame([(c, f, s + d) for c, s in (("wide", 0.81), ("mid", 0.805), ("bad", 0.61)) for f, d in ((1, -0.01), (2, 0.01))], "config string, fold int, score double")
    out = {r["config"]: r for r in rows(ev.rerank_choice(trials, folds, gain=0.006))}
    assert out["wide"]["walk_forward_best"] and out["mid"]["recommended"] and not out["bad"]["recent_safe"]
    kept = [r["config"] for r in rows(ev.confidence_frontier(trials.select("config", "objective", "error", "features", "complexity")), "place")]
    assert kept == ["wide", "mid"]


def test_nested_samples_and_budgets(spark):
    frame = spark.range(1000).select("id", (F.col("id") % 10 == 0).cast("int").alias("y"))
    small = {r["id"] for r in sp.nested_sample(frame, ["id"], 50, "t").collect()}
    large = {r["id"] for r in sp.nested_sample(frame.repartition(7), ["id"], 200, "t").collect()}
    assert len(small) == 50 and small < large
    budget = dict(sp.stratified_budget(frame, "y", 105, ["id"]).groupBy("y").count().collect())
    assert sum(budget.values()) == 105 and budget[1] in (10, 11)


def test_spaced_cutoffs_include_the_latest(spark):
    cuts = spark.createDataFrame([(dt.datetime(2024, 1, d),) for d in range(1, 11)], "cutoff timestamp_ntz")
    picked = sorted(r[0].day for r in sp.spaced_cutoffs(cuts, 4).collect())
    assert picked == [1, 4, 7, 10]
    assert [r[0].day for r in sp.spaced_cutoffs(cuts, 1).collect()] == [10]


def test_training_support_and_folds(spark):
    rows = spark.createDataFrame([(e, dt.datetime(2024, m, 1)) for m in range(1, 9) for e in range(m)], "entity int, cutoff timestamp_ntz")
    support = sp.training_support(rows, "2024-08-01", 40, 9, 1)
    assert sorted(r["cutoff"].month for r in support.collect()) == [5, 6]
    folds = {r["cutoff"].month: r["fold"] for r in sp.retrospective_folds(rows, 2).collect()}
    assert folds == {5: 0, 6: 0, 7: 1, 8: 1}


def test_recency_weights_average_one(spark):
    rows = spark.createDataFrame([(dt.datetime(2024, 1, d),) for d in (1, 11, 11, 21)], "cutoff timestamp_ntz")
    weights = [r["weight"] for r in sp.recency_weights(rows, 10).collect()]
    assert sum(weights) / 4 == pytest.approx(1.0) and max(weights) / min(weights) == pytest.approx(4.0)


def test_time_split_takes_the_last_rows(spark):
    rows = spark.createDataFrame([(i, dt.datetime(2024, 1, 1 + i // 4)) for i in range(20)], "entity int, cutoff timestamp_ntz")
    out = sp.time_split(rows, "cutoff", 0.35, ["entity"]).groupBy("split").agg(F.count("entity"), F.min("cutoff"), F.max("cutoff")).collect()
    got = {r[0]: r[1:] for r in out}
    assert got["train"][0] == 13 and got["train"][2] <= got["validation"][1]


def _scored(spark, rows):
    return spark.createDataFrame([(e, "c" + str(c), t, p) for e, c, t, p in rows], "entity string, cutoff string, truth int, p double")


def test_uniform_pairs_spread_over_the_product(spark):
    rows = [(f"p{i}", 1, 1, 0.5) for i in range(40)] + [(f"n{i}", 1, 0, 0.5) for i in range(60)]
    frame = _scored(spark, rows)
    seen = []
    for budget in (20, 40, 200, 2400, 9000):
        pairs = {(r.positive, r.negative) for r in jn.cohort_pairs(frame, budget).collect()}
        assert len(pairs) == min(budget, 2400)
        seen.append((len({p for p, _ in pairs}), len({n for _, n in pairs})))
    assert seen[0][1] > 12 and seen[1][1] > 24 and seen[2][1] > 55 and seen[3] == seen[4] == (40, 60)


def test_near_rivals_cross_cells_and_fall_back_to_the_nearest(spark):
    logistic = lambda z: 1 / (1 + math.exp(-z))
    # Whole units lie between cells: rivals at 0.9 below and above the positive are both within one unit.
    rows = [("p0", 1, 1, logistic(0.95)), *[(f"a{i}", 1, 0, logistic(0.1 + i / 1000)) for i in range(70)], *[(f"b{i}", 1, 0, logistic(1.1 + i / 1000)) for i in range(70)]]
    rows += [("far", 1, 0, logistic(9.0)), ("p1", 2, 1, logistic(-6.0)), ("x", 2, 0, logistic(-4.0)), ("y", 2, 0, logistic(-3.0)), ("z", 2, 0, logistic(8.0))]
    frame = _scored(spark, rows)
    placed = frame.withColumn("z", F.log(F.col("p") / (1 - F.col("p"))))
    near = jn._near(jn.hashed_places(placed, ["cutoff", "truth"], ["entity", "cutoff"]), jn._cohorts(frame, 400, "cutoff"), "cutoff", 1).collect()
    first = {r.negative for r in near if r.cutoff == "c1"}
    assert len(first) > 64 and {n[0] for n in first} == {"a", "b"}
    assert {r.negative for r in near if r.cutoff == "c2"} == {"x"}
    mixed = jn.mixed_pairs(frame, 60).collect()
    assert len(set(mixed)) == len(mixed) == 33  # thirty of the first cohort, all three of the second
