"""Scoring and selection over evidence rows ``(origin, seed, policy, entity, truth, prediction)``."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from asofkit.functions.scalars import as_column, count_if, finite, hash_number, ratio, text, when
from asofkit.session import checkpoint
from asofkit.skew import hashed_places, joined, lookup, numbered, percentiles, running_totals, top_rows

INCUMBENT = "incumbent"


# --- metrics ----------------------------------------------------------------


def roc_auc(rows: DataFrame, keys: list[str], truth: str = "truth", score: str = "prediction", weight: Column | None = None, buckets: int = 256):
    """Area under the curve per group; ties count half.

    Rows reduce to one per distinct score, negatives below each score come from
    a bucketed running total, and no group is ever sorted as a whole.
    """
    w = F.lit(1.0) if weight is None else weight
    y = F.col(truth).cast("double")
    cells = rows.groupBy(*keys, F.col(score).alias("_score")).agg(F.sum(y * w).alias("_pos"), F.sum((1 - y) * w).alias("_neg"))
    placed = running_totals(cells, keys, "_score", {"_below": "_neg"}, buckets)
    won = F.sum(F.col("_pos") * (F.col("_below") - F.col("_neg") / 2))
    return placed.groupBy(*keys).agg(
        (won / F.nullif(F.sum("_pos") * F.sum("_neg"), F.lit(0.0))).alias("auc"),
        F.sum("_pos").alias("positives"), F.sum("_neg").alias("negatives"),
    )


def mean_absolute_error(rows: DataFrame, keys: list[str], truth: str = "truth", score: str = "prediction"):
    error = F.abs(finite(truth) - finite(score))
    return rows.groupBy(*keys).agg(
        F.avg(error).alias("mae"), F.coalesce(F.stddev_samp(error) / F.sqrt(F.count(error)), F.lit(0.0)).alias("mae_error"))


def accuracy(rows: DataFrame, keys: list[str], truth: str, predicted: str):
    """Share of hits; a class the model never saw counts as a miss."""
    hit = F.coalesce((as_column(truth) == as_column(predicted)).cast("double"), F.lit(0.0))
    return rows.groupBy(*keys).agg(
        F.avg(hit).alias("accuracy"), F.coalesce(F.stddev_samp(hit) / F.sqrt(F.count(hit)), F.lit(0.0)).alias("accuracy_error"))


def auc_standard_error(scored: DataFrame) -> DataFrame:
    """Hanley-McNeil uncertainty from the area and the class counts."""
    a, p, n = F.col("auc"), F.col("positives"), F.col("negatives")
    q1 = a / F.greatest(F.lit(1e-12), 2 - a)
    q2 = 2 * a * a / F.greatest(F.lit(1e-12), 1 + a)
    variance = (a * (1 - a) + (p - 1) * (q1 - a * a) + (n - 1) * (q2 - a * a)) / (p * n)
    return scored.withColumn("auc_error", F.sqrt(F.greatest(F.lit(0.0), variance)))


def pair_errors(rows: DataFrame, cohort: list[str], score: str = "prediction", truth: str = "truth") -> DataFrame:
    """Misordered negatives per positive, half credit for ties."""
    cells = rows.groupBy(*cohort, F.col(score).alias("_score")).agg(F.sum(1 - F.col(truth)).alias("_neg"))
    above = running_totals(cells, cohort, "_score", {"_above": "_neg"}, ascending=False)
    table = above.select(*cohort, F.col("_score").alias(score), (F.col("_above") - F.col("_neg") / 2).alias("_e"))
    out = lookup(rows, table, [*cohort, score])
    return out.withColumn("pair_errors", F.when(F.col(truth) == 1, F.col("_e")).otherwise(0.0)).drop("_e")


def cohort_summary(rows: DataFrame, mask: Column, cohort: list[str], score: str = "prediction", truth: str = "truth"):
    """How much of a cohort's positives and errors a subset carries."""
    y = F.col(truth)
    return rows.groupBy(*cohort).agg(
        count_if(mask).alias("rows"), F.coalesce(F.sum(when(mask, truth)), F.lit(0)).cast("long").alias("positives"),
        F.avg(when(mask, y.cast("double"))).alias("positive_rate"),
        ratio(F.sum(when(mask, truth)), F.sum(y)).alias("share_of_positives"),
        ratio(F.sum(when(mask, "pair_errors")), F.sum("pair_errors")).alias("share_of_errors"),
        F.avg(when(mask & (y == 1), score)).alias("positive_score"), F.avg(when(mask & (y == 0), score)).alias("negative_score"),
    )


def average_precision(rows: DataFrame, keys: list[str], truth: str = "truth", score: str = "prediction") -> DataFrame:
    cells = rows.groupBy(*keys, F.col(score).alias("_score")).agg(
        F.sum(F.col(truth).cast("double")).alias("_pos"), F.count(F.lit(1)).cast("double").alias("_n"))
    placed = running_totals(cells, keys, "_score", {"_hits": "_pos", "_seen": "_n"}, ascending=False)
    return placed.groupBy(*keys).agg(ratio(F.sum(F.col("_pos") * F.col("_hits") / F.col("_seen")), F.sum("_pos")).alias("average_precision"))


def brier(rows: DataFrame, keys: list[str], truth: str = "truth", score: str = "prediction") -> DataFrame:
    gap = F.col(score) - F.col(truth)
    return rows.groupBy(*keys).agg(F.avg(gap * gap).alias("brier"))


def fold_objective(scores: DataFrame, keys: list[str], score: str, higher: bool = True, penalty: float = 0.25) -> DataFrame:
    """Mean fold score less a fraction of the standard error of that mean."""
    sign = 1.0 if higher else -1.0
    n = F.count(score)
    error = F.stddev_pop(score) / F.sqrt(n)
    return scores.groupBy(*keys).agg(
        F.avg(score).alias("mean_score"), error.alias("score_error"), n.alias("folds"),
        (sign * F.avg(score) - penalty * error).alias("objective"))


def frame_ensemble(predictions: DataFrame, keys: list[str], score: str = "prediction") -> DataFrame:
    return predictions.groupBy(*keys).agg(F.avg(score).alias("prediction"), F.count(F.lit(1)).alias("members"))


def blends(evidence: DataFrame, weights: list[float]) -> DataFrame:
    """Challengers mixed with the incumbent on identical rows, plus the originals."""
    if len(weights) > 4 or len(set(weights)) != len(weights) or not all(0 < w < 1 for w in weights):
        raise ValueError("at most four distinct interior weights")
    keys = ["origin", "seed", "entity"]
    control = evidence.filter(F.col("policy") == INCUMBENT).select(*keys, F.col("prediction").alias("_control"))
    mix = F.array(*[F.struct(F.lit(f"{w:g}").alias("label"), F.lit(float(w)).alias("w")) for w in weights])
    pairs = evidence.filter(F.col("policy") != INCUMBENT)
    pairs = joined(pairs, control, keys).withColumn("_m", F.explode(mix))
    mixed = pairs.select(
        "origin", "seed", F.concat("policy", F.lit("__blend_"), F.col("_m.label")).alias("policy"), "entity", "truth",
        ((1 - F.col("_m.w")) * F.col("_control") + F.col("_m.w") * F.col("prediction")).alias("prediction"))
    return evidence.select(*mixed.columns).unionByName(mixed)


# --- target shapes ---------------------------------------------------------------


def target_domain(labels: DataFrame, target: str = "y") -> DataFrame:
    """Whether training targets are nonnegative, and integer counts with three or more values."""
    y = finite(target)
    per_value = labels.groupBy(y.alias("v")).agg(F.count(F.lit(1)).alias("n")).filter("v IS NOT NULL")
    off = F.max(F.abs(F.col("v") - F.rint("v")))
    nonnegative = F.min("v") >= 0
    return per_value.agg(
        nonnegative.alias("nonnegative"), (nonnegative & (F.count(F.lit(1)) >= 3) & (off <= 1e-10)).alias("integer_counts"))


def project_target(rows: DataFrame, domain: DataFrame, score: str = "prediction") -> DataFrame:
    floor = F.greatest(F.col(score), F.lit(0.0))
    nonnegative, counts = domain.select("nonnegative").scalar(), domain.select("integer_counts").scalar()
    return rows.withColumn("nonnegative", when(nonnegative, floor)).withColumn("integer_counts", when(counts, F.rint(floor)))


# Quantile levels of the positive part.
MIXTURE_LEVELS = (0.05, 0.25, 0.5, 0.75, 0.95)


def mixture_median(probability, quantiles: list) -> Column:
    """Median of a point mass at zero and a positive part given by log quantiles."""
    p = as_column(probability)
    rising, kept = F.lit(0.0), []
    for q in quantiles:
        rising = F.greatest(rising, as_column(q))
        kept.append(rising)
    at = F.greatest(F.lit(0.0), 1 - 0.5 / F.greatest(p, F.lit(1e-12)))
    levels, values = (0.0, *MIXTURE_LEVELS), [F.lit(0.0), *kept]
    out = values[-1]
    for i in reversed(range(len(levels) - 1)):
        step = (at - levels[i]) / (levels[i + 1] - levels[i])
        out = F.when(at <= levels[i + 1], values[i] + step * (values[i + 1] - values[i])).otherwise(out)
    return F.when(p > 0.5, F.expm1(out)).otherwise(0.0)


def target_bins(labels: DataFrame, bins: int, target: str = "y") -> tuple[list[float], DataFrame]:
    """Quantile cutpoints of training targets and each bin's median."""
    names = {f"q{i}": i / bins for i in range(1, bins)}
    row = percentiles(labels, [], target, names).first()
    cuts = sorted(set(row[n] for n in names))
    coded = labels.withColumn("bin", bin_of(target, cuts))
    return cuts, percentiles(coded, ["bin"], target, {"median": 0.5})


def bin_of(value, cuts: list[float]) -> Column:
    """Number of cutpoints strictly below the value."""
    x = as_column(value)
    return sum(((x > F.lit(c)).cast("int") for c in cuts), F.lit(0))


def ordinal_median(probabilities: DataFrame, medians: DataFrame, keys: list[str]) -> DataFrame:
    """Median of the first bin at which the predicted distribution reaches one half."""
    so_far = Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    crossed = probabilities.withColumn("_c", F.sum("probability").over(so_far)).filter(F.col("_c") >= 0.5 - 1e-12)
    first = crossed.groupBy(*keys).agg(F.min("bin").alias("bin"))
    return first.join(F.broadcast(medians), "bin").select(*keys, "bin", F.col("median").alias("prediction"))


def average_ranks(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Add tie-averaged ranks within ``keys``, one running total per column."""
    out = rows
    for c in columns:
        cells = rows.groupBy(*keys, c).agg(F.count(F.lit(1)).alias("_n"))
        placed = running_totals(cells, keys, c, {"_end": "_n"})
        table = placed.select(*keys, c, (F.col("_end") - (F.col("_n") - 1) / 2).alias(f"{c}_rank"))
        out = lookup(out, table, [*keys, c])
    return out


def exposure_scale(rows: DataFrame, candidates: list[str], target: str) -> DataFrame:
    """Rank scale columns by coverage, spread and positive rank correlation.

    Candidates are melted into (column, x, t) rows, so all of them share one
    pass for the percentiles and one per rank.
    """
    cells = F.array(*[F.struct(F.lit(c).alias("column"), finite(c).alias("x")) for c in sorted(candidates)])
    melted = rows.select(finite(target).alias("t"), F.explode(cells).alias("_c")).select("t", "_c.column", "_c.x")
    seen = melted.filter("x IS NOT NULL")
    coverage = melted.groupBy("column").agg(ratio(F.count("x"), F.count(F.lit(1))).alias("coverage"))
    values = seen.groupBy("column", "x").agg(F.count(F.lit(1)).alias("n"))
    shape = values.groupBy("column").agg(F.count(F.lit(1)).alias("distinct"), F.min("x").alias("least"))
    marks = percentiles(values, ["column"], "x", {"low": 0.1, "fill": 0.5, "high": 0.9}, freq="n")
    spread = F.nullif(F.stddev_pop("x_rank") * F.stddev_pop("t_rank"), F.lit(0.0))
    ranked = average_ranks(seen, ["column"], ["x", "t"]).groupBy("column").agg(
        (F.covar_pop("x_rank", "t_rank") / spread).alias("correlation"))
    out = coverage.join(ranked, "column", "left").join(marks, "column", "left").join(shape, "column", "left")
    fit = (
        (F.col("coverage") >= 0.95) & (F.col("least") >= 0) & (F.col("distinct") >= 16)
        & ((F.col("high") + 1) / (F.col("low") + 1) >= 4) & (F.col("correlation") > 0)
    )
    out = out.withColumn("eligible", F.coalesce(fit, F.lit(False)))
    order = [F.col("eligible").desc(), F.col("correlation").desc(), F.col("column")]
    return numbered(out, [], order).select("column", "correlation", "coverage", "low", "fill", "high", "distinct", "eligible", "place")


def reliability(rows: DataFrame, base: str, extra: str, numbers: list[str], texts: list[str]) -> DataFrame:
    """Covariates that say how far two predictions may be trusted on a row."""
    n = F.lit(float(max(1, len(numbers))))
    coverage = sum((finite(c).isNotNull().cast("double") for c in numbers), F.lit(0.0)) / n
    counts = [c for c in numbers if any(k in c.lower() for k in ("count", "support", "nunique"))]
    logs = [F.log1p(F.least(F.greatest(F.coalesce(finite(c), F.lit(0.0)), F.lit(0.0)), F.lit(1e12))) for c in counts]
    support = sum(logs, F.lit(0.0)) / F.lit(float(max(1, len(counts))))
    lengths = [F.least(F.length(F.coalesce(text(c), F.lit(""))), F.lit(2048)) / 2048 for c in texts]
    gap = as_column(extra) - as_column(base)
    return rows.select(
        "*", F.abs(gap).alias("disagreement"), gap.alias("signed_disagreement"), coverage.alias("numeric_coverage"),
        support.alias("historical_support"), (sum(lengths, F.lit(0.0)) / F.lit(float(max(1, len(texts))))).alias("text_coverage"))


# --- paired uncertainty -------------------------------------------------------------


def _poisson_bounds(most: int = 12) -> tuple[float, ...]:
    """The distribution function of Poisson(1); the count is how many of its values a uniform number reaches."""
    total, term, bounds = 0.0, math.exp(-1.0), []
    for k in range(most):
        total += term
        bounds.append(total)
        term /= k + 1
    return tuple(bounds)


POISSON_BOUNDS = _poisson_bounds()


def _paired(evidence: DataFrame, policies: list[str], seed: int) -> DataFrame:
    """Incumbent and challenger predictions on identical rows of one seed."""
    keys = ["origin", "entity"]
    rows = evidence.filter(F.col("seed") == seed)
    a = rows.filter(F.col("policy") == INCUMBENT).select(*keys, "truth", F.col("prediction").alias("control"))
    b = rows.filter(F.col("policy").isin(list(policies))).select(*keys, "policy", F.col("prediction").alias("candidate"))
    return joined(a, b, keys)


BUCKETS = 64
HOT_PARTS = 64


# Rows, and hashes, that a task holds as arrays at a time.
CHUNK = 256
HASHES = 16384
MD5_TURNS = [t for turns in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for t in turns * 4]
MD5_SINES = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]


def _md5_block(words: list) -> list[np.ndarray]:
    """The four digest words of many messages of one block each: ``words`` are arrays over the messages or, where all agree, numbers."""
    start = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
    size = next(w.size for w in words if isinstance(w, np.ndarray))
    a, b, c, d = (np.full(size, v, np.uint32) for v in start)
    for i in range(64):
        if i < 16:
            f, g = d ^ (b & (c ^ d)), i
        elif i < 32:
            f, g = c ^ (d & (b ^ c)), (5 * i + 1) % 16
        elif i < 48:
            f, g = b ^ c ^ d, (3 * i + 5) % 16
        else:
            f, g = c ^ (b | ~d), 7 * i % 16
        f += a
        if isinstance(words[g], np.ndarray):
            f += words[g]
            f += np.uint32(MD5_SINES[i])
        else:
            f += np.uint32((MD5_SINES[i] + words[g]) % 2**32)
        turned = f << np.uint32(MD5_TURNS[i])
        f >>= np.uint32(32 - MD5_TURNS[i])
        turned |= f
        turned += b
        a, d, c, b = d, c, b, turned
    return [x + np.uint32(v) for x, v in zip((a, b, c, d), start)]


def hash_words(firsts: list[str], seconds: list[str], count: int = 4) -> np.ndarray:
    """The first ``count`` big-endian words of the MD5 digest of each ``first|second``, as an array (firsts, seconds, count)."""
    left, right = [x.encode() for x in firsts], [x.encode() for x in seconds]
    out = np.empty((len(left), len(right), count), np.uint32)
    lengths = [np.array([len(x) for x in side], int) for side in (left, right)]
    for m in np.unique(lengths[0]):
        for n in np.unique(lengths[1]):
            rows, columns = np.flatnonzero(lengths[0] == m), np.flatnonzero(lengths[1] == n)
            size = int(m + n + 1)
            if size > 55:
                # Longer than one block: one by one.
                for i in rows:
                    for j in columns:
                        out[i, j] = np.frombuffer(hashlib.md5(left[i] + b"|" + right[j]).digest(), ">u4")[:count]
                continue
            tails = np.frombuffer(b"".join(right[j] for j in columns), np.uint8).reshape(len(columns), n)
            step = max(1, HASHES // len(columns))
            for k in range(0, len(rows), step):
                some = rows[k:k + step]
                text = np.zeros((len(some), len(columns), 64), np.uint8)
                text[:, :, :m] = np.frombuffer(b"".join(left[i] for i in some), np.uint8).reshape(len(some), 1, m)
                text[:, :, m], text[:, :, size] = ord("|"), 0x80
                text[:, :, m + 1:size] = tails[None]
                used = text.reshape(-1, 64).view("<u4").T
                words = [np.ascontiguousarray(used[i]) if i <= size // 4 else 8 * size if i == 14 else 0 for i in range(16)]
                for w, digest in enumerate(_md5_block(words)[:count]):
                    out[some[:, None], columns, w] = digest.byteswap().reshape(len(some), len(columns))
    return out


def multipliers(entities, repeats: int) -> np.ndarray:
    """Poisson(1) counts (entities, repeats) from the entities' content: four numbers of each MD5 digest."""
    blocks = -(-repeats // 4)
    units = hash_words([str(e) for e in entities], [str(k) for k in range(blocks)]).reshape(len(entities), 4 * blocks)[:, :repeats]
    counts = np.zeros(units.shape, np.uint8)
    for bound in POISSON_BOUNDS:
        least = math.ceil(bound * 2**32)
        if least < 2**32:
            counts += units >= np.uint32(least)
    return counts.astype(np.float64)


def _stored_counts(cells, repeats: int) -> np.ndarray:
    """Counts (rows, repeats) from their stored bytes, one or four for each repeat."""
    out = np.zeros((len(cells), repeats), np.uint32)
    for i, cell in enumerate(cells):
        out[i] = np.frombuffer(cell, np.uint8 if len(cell) == repeats else "<u4")
    return out


def _weights_of(pdf, repeats: int) -> np.ndarray:
    """Float weights (rows, repeats): the stored counts where there are any, else the multipliers of the entities."""
    return _stored_counts(pdf["counts"], repeats).astype(np.float64) if "counts" in pdf.columns else multipliers(pdf["entity"], repeats)


def _partitions(frame: DataFrame) -> int:
    return int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _resampled_areas(rows: DataFrame, keys: list[str], repeats: int) -> DataFrame:
    """(keys, repeat, value): the area under the curve of each repeat, null without both classes.

    A group's rows (entity, truth, score) are dealt to value buckets. A task multiplies its bucket's rows with their
    multiplier arrays and returns three arrays over repeats: positives, negatives, and pairs won inside; a last step
    adds the negatives of lower buckets. A score that fills whole buckets is one of its own, split over tasks by
    entity, as only its sums count. So rows are shuffled once, whatever the number of repeats. Weights are the rows' stored
    ``counts`` where they have any, else the multipliers of their entities.
    """
    steps = F.array(*[F.lit(i / BUCKETS) for i in range(1, BUCKETS)])
    borders = rows.agg(F.percentile_approx("score", steps, F.lit(10_000)).alias("c")).scalar()
    known = rows.withColumn("_c", F.coalesce(borders, F.array().cast("array<double>")))
    score = F.col("score")
    known = known.withColumn("_b", 2 * F.size(F.filter("_c", lambda c: c <= score)))
    # A border that occurs twice is a score that fills a bucket.
    hot = F.size(F.filter("_c", lambda c: c == score)) > 1
    part = F.when(hot, F.pmod(F.xxhash64("entity"), F.lit(HOT_PARTS))).otherwise(0).cast("int")
    stored = [c for c in ("counts",) if c in rows.columns]
    dealt = known.select(*keys, "entity", "truth", "score", *stored, F.when(hot, F.col("_b") - 1).otherwise(F.col("_b")).alias("_b"), part.alias("_p"), hot.alias("_hot"))
    names = [f.name for f in rows.schema.fields if f.name in keys]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name in keys)
    arrays = "pos array<double>, neg array<double>, won array<double>"

    def inside(pdf):
        pdf = pdf.sort_values("score", kind="stable")
        truth, score = pdf["truth"].to_numpy(float), pdf["score"].to_numpy(float)
        pos, neg, won = np.zeros(repeats), np.zeros(repeats), np.zeros(repeats)
        # Sums of the score that the rows so far end in, and the negatives below it.
        tied, below, last = [np.zeros(repeats), np.zeros(repeats)], np.zeros(repeats), None
        for k in range(0, len(pdf), CHUNK):
            weights = _weights_of(pdf.iloc[k:k + CHUNK], repeats)
            y, at = truth[k:k + CHUNK, None], score[k:k + CHUNK]
            p, n = weights * y, weights * (1 - y)
            pos, neg = pos + p.sum(0), neg + n.sum(0)
            if pdf["_hot"].iloc[0]:
                continue
            # Equal scores count half of each other's negatives.
            first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
            p, n = np.add.reduceat(p, first), np.add.reduceat(n, first)
            if last is not None and at[0] == last:
                p[0] += tied[0]
                n[0] += tied[1]
            elif last is not None:
                won, below = won + tied[0] * (below + tied[1] / 2), below + tied[1]
            upto = below + np.cumsum(n, 0)
            won = won + (p[:-1] * (upto[:-1] - n[:-1] / 2)).sum(0)
            below, tied, last = upto[-1] - n[-1], [p[-1], n[-1]], at[-1]
        won = won + tied[0] * (below + tied[1] / 2)
        out = pdf.iloc[:1][[*names, "_b", "_hot"]].copy()
        out["pos"], out["neg"], out["won"] = [pos.tolist()], [neg.tolist()], [won.tolist()]
        return out[[*names, "_b", "_hot", "pos", "neg", "won"]]

    def across(pdf):
        below, pairs, positives = np.zeros(repeats), np.zeros(repeats), np.zeros(repeats)
        for _, bucket in pdf.groupby("_b", sort=True):
            pos, neg, won = (np.stack(bucket[c]).sum(0) for c in ("pos", "neg", "won"))
            pairs += won + pos * below + (pos * neg / 2 if bucket["_hot"].iloc[0] else 0)
            below, positives = below + neg, positives + pos
        both = positives * below
        value = np.divide(pairs, both, out=np.full(repeats, np.nan), where=both > 0)
        out = pdf.iloc[:1][names].copy()
        out["value"] = [[None if np.isnan(v) else float(v) for v in value]]
        return out

    # Few bytes, much work: a given number of partitions is not merged by size.
    dealt = dealt.repartition(_partitions(rows), *keys, "_b", "_p", "_hot")
    parts = dealt.groupBy(*keys, "_b", "_p", "_hot").applyInPandas(inside, f"{kinds}, _b int, _hot boolean, {arrays}")
    found = parts.groupBy(*keys).applyInPandas(across, f"{kinds}, value array<double>")
    return found.select(*keys, F.posexplode("value").alias("repeat", "value"))


def _resampled_means(rows: DataFrame, keys: list[str], repeats: int) -> DataFrame:
    """(keys, repeat, value): the weighted mean of ``loss`` of each repeat, from one pair of arrays for each part of a group."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name in keys)
    names = [f.name for f in rows.schema.fields if f.name in keys]

    def inside(pdf):
        top, weight, loss = np.zeros(repeats), np.zeros(repeats), pdf["loss"].to_numpy(float)
        for k in range(0, len(pdf), CHUNK):
            weights = _weights_of(pdf.iloc[k:k + CHUNK], repeats)
            top, weight = top + (weights * loss[k:k + CHUNK, None]).sum(0), weight + weights.sum(0)
        out = pdf.iloc[:1][names].copy()
        out["top"], out["weight"] = [top.tolist()], [weight.tolist()]
        return out

    stored = [c for c in ("counts",) if c in rows.columns]
    dealt = rows.select(*keys, "entity", "loss", *stored, F.pmod(F.xxhash64("entity"), F.lit(HOT_PARTS)).alias("_p"))
    dealt = dealt.repartition(_partitions(rows), *keys, "_p")
    parts = dealt.groupBy(*keys, "_p").applyInPandas(inside, f"{kinds}, top array<double>, weight array<double>")
    each = parts.select(*keys, F.posexplode(F.arrays_zip("top", "weight")).alias("repeat", "v"))
    return each.groupBy(*keys, "repeat").agg(ratio(F.sum("v.top"), F.sum("v.weight")).alias("value"))


SHARED = -2


def _controls(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Control rows of the pairs, once for all policies where each is paired with the same rows of an origin (side ``SHARED``,
    no policy), else once for each policy; and per origin the policies of the shared ones (``_cover``)."""
    cells = rows.groupBy("origin", "entity", "truth", F.col("control").alias("score")).agg(F.sort_array(F.collect_list("policy")).alias("_own"))
    covers = cells.groupBy("origin").agg(F.min("_own").alias("_cover"), (F.min("_own") == F.max("_own")).alias("_same"))
    known = cells.join(F.broadcast(covers), "origin")
    policies = F.when(F.col("_same"), F.array(F.lit(""))).otherwise(F.col("_own"))
    control = known.select(
        F.explode(policies).alias("policy"), "origin", "entity", "truth", F.when(F.col("_same"), F.lit(SHARED)).otherwise(-1).alias("side"), "score")
    return control, covers.select("origin", "_cover")


def gain_lower_bounds(
    evidence: DataFrame, policies: list[str], repeats: int, alpha: float, task: str = "classification", seed: int = 0
) -> DataFrame:
    """Lower quantile of the recent-weighted paired gain under entity resampling.

    One Poisson(1) multiplier per entity is shared by all origins, so repeated
    entities stay dependent.  A repeat counts only when every origin is scored.
    All challengers and repeats are resampled in one pass over the rows.
    """
    rows = _paired(evidence, policies, seed)
    if task == "regression":
        loss = F.abs(F.col("truth") - F.col("control")) - F.abs(F.col("truth") - F.col("candidate"))
        gains = _resampled_means(rows.withColumn("loss", loss), ["policy", "origin"], repeats).withColumnRenamed("value", "gain")
    else:
        rows = checkpoint(rows)
        control, covers = _controls(rows)
        both = rows.select("policy", "origin", "entity", "truth", F.lit(1).alias("side"), F.col("candidate").alias("score")).unionByName(control)
        areas = _resampled_areas(both, ["policy", "origin", "side"], repeats)
        # A shared control stands for each policy it was paired with.
        policies = F.when(F.col("side") == SHARED, F.array_distinct("_cover")).otherwise(F.array("policy"))
        areas = areas.join(F.broadcast(covers), "origin", "left").select(
            F.explode(policies).alias("policy"), "origin", "repeat", F.when(F.col("side") > 0, F.col("value")).otherwise(-F.col("value")).alias("value"))
        gains = areas.groupBy("policy", "origin", "repeat").agg(F.when(F.count("value") == 2, F.sum("value")).alias("gain"))
    origins = evidence.filter(F.col("policy") == INCUMBENT).groupBy("origin").agg(F.count(F.lit(1)).alias("_rows"))
    plan = origins.agg(F.struct(F.max("origin").alias("last"), F.count(F.lit(1)).alias("n")).alias("p")).scalar()
    gains = gains.withColumn("_plan", plan)
    older = 0.5 / F.greatest(F.lit(1), F.col("_plan.n") - 1)
    weight = F.when(F.col("origin") == F.col("_plan.last"), 0.5).otherwise(older)
    per_repeat = gains.groupBy("policy", "repeat").agg(
        F.sum(weight * F.col("gain")).alias("g"), F.count("gain").alias("scored"), F.max("_plan.n").alias("n")).filter("scored = n")
    return per_repeat.groupBy("policy").agg(F.percentile("g", F.lit(alpha)).alias("lower_bound"), F.count(F.lit(1)).alias("repeats"))


# Draws in one record of a task, and places in one block of counts.
DRAWS = 512
PLACES = 4096


def _draw_counts(spark, n: int, repeats: int) -> DataFrame:
    """(place, counts): how often each of ``n`` places comes up in each repeat, when every repeat draws ``n`` places by hash.

    Records of draws are hashed for all repeats and dealt to blocks of places as four bytes a draw; a block counts its own.
    """
    chunks = -(-n // DRAWS)
    numbers = [str(r) for r in range(repeats)]

    def hit(batches):
        for pdf in batches:
            for chunk in pdf["id"]:
                draws = [str(d) for d in range(chunk * DRAWS, min((chunk + 1) * DRAWS, n))]
                places = hash_words(numbers, draws, 1)[:, :, 0].astype(np.int64) % n
                blocks = (places // PLACES).ravel()
                packed = (np.arange(repeats)[:, None] * PLACES + places % PLACES).astype("<u4").ravel()
                order = np.argsort(blocks, kind="stable")
                blocks, packed = blocks[order], packed[order]
                first = np.flatnonzero(np.append(True, blocks[1:] != blocks[:-1]))
                ends = np.append(first[1:], len(blocks))
                yield pd.DataFrame({"block": blocks[first], "hits": [packed[i:j].tobytes() for i, j in zip(first, ends)]})

    def count(pdf):
        hits = np.frombuffer(b"".join(pdf["hits"]), "<u4")
        block = int(pdf["block"].iloc[0])
        table = np.bincount(hits, minlength=PLACES * repeats).reshape(repeats, PLACES).T
        table = np.ascontiguousarray(table[:min(PLACES, n - block * PLACES)])
        small = table.max(1) < 256
        cells = [row.astype(np.uint8 if s else "<u4").tobytes() for row, s in zip(table, small)]
        return pd.DataFrame({"place": block * PLACES + np.arange(len(cells)), "counts": cells})

    drawn = spark.range(0, chunks, 1, max(1, min(chunks, 4096))).mapInPandas(hit, "block long, hits binary")
    return drawn.groupBy("block").applyInPandas(count, "place long, counts binary")


def recent_resample(evidence: DataFrame, policy: str, repeats: int, alpha: float, task: str = "classification", seed: int = 0):
    """The newest origin only, entities drawn with replacement.

    A draw is never a row: an entity carries how often each repeat drew it.
    """
    newest = evidence.agg(F.max("origin").alias("origin"))
    rows = checkpoint(_paired(evidence.join(F.broadcast(newest), "origin"), [policy], seed).select("entity", "truth", "control", "candidate"))
    entities = hashed_places(rows.select("entity").distinct(), [], ["entity"], "place").withColumn("place", F.col("place") - 1)
    entities = checkpoint(entities.select("entity", "place"))
    counts = _draw_counts(rows.sparkSession, entities.count(), repeats)
    weighted = checkpoint(joined(joined(rows, entities, "entity"), counts, "place"))
    if task == "regression":
        loss = F.abs(F.col("truth") - F.col("control")) - F.abs(F.col("truth") - F.col("candidate"))
        sums = weighted.select(F.lit(0).alias("side"), "entity", "counts", loss.alias("_loss"))
        # A row without a loss counts as weight alone.
        gains = _resampled_means(sums.withColumn("loss", F.coalesce("_loss", F.lit(0.0))), ["side"], repeats)
        known = _resampled_means(sums.withColumn("loss", F.col("_loss").isNotNull().cast("double")), ["side"], repeats)
        gains = gains.withColumnRenamed("value", "gain").join(known.filter("value > 0").select("repeat"), "repeat")
    else:
        sides = F.array(F.struct(F.lit(-1).alias("side"), F.col("control").alias("score")), F.struct(F.lit(1).alias("side"), F.col("candidate").alias("score")))
        both = weighted.filter("truth IS NOT NULL").withColumn("_s", F.explode(sides)).select("entity", "truth", "counts", "_s.side", "_s.score")
        # A missing score is the lowest, as in an ascending order; all that are no numbers are equal and the highest.
        score = F.when(F.isnan("score"), float("inf")).otherwise(F.coalesce("score", F.lit(float("-inf"))))
        areas = _resampled_areas(both.withColumn("score", score), ["side"], repeats)
        gains = areas.groupBy("repeat").agg(F.when(F.count("value") == 2, F.sum(F.col("side") * F.col("value"))).alias("gain"))
    gains = gains.filter("gain IS NOT NULL")
    return gains.agg(F.percentile("gain", F.lit(alpha)).alias("recent_lower_bound"), F.count(F.lit(1)).alias("repeats")).select(
        F.lit(policy).alias("policy"), "recent_lower_bound", "repeats")


def paired_scores(evidence: DataFrame, task: str = "classification") -> DataFrame:
    """Score, incumbent score, gain and loss cap per (origin, seed, policy)."""
    keys = ["origin", "seed", "policy"]
    scored = roc_auc(evidence, keys).select(*keys, F.col("auc").alias("score")) if task == "classification" else (
        mean_absolute_error(evidence, keys).select(*keys, F.col("mae").alias("score")))
    control = scored.filter(F.col("policy") == INCUMBENT).select("origin", "seed", F.col("score").alias("control"))
    out = scored.join(control, ["origin", "seed"], "left")
    sign = 1.0 if task == "classification" else -1.0
    cap = F.lit(0.005) if task == "classification" else 0.01 * F.col("control")
    return out.withColumn("gain", sign * (F.col("score") - F.col("control"))).withColumn("loss_cap", cap)


def admission(scores: DataFrame, bounds: DataFrame, least_origins: int = 2, least_seeds: int = 2, seed: int = 0) -> DataFrame:
    """Reason code per challenger, and which one is selected."""
    primary = F.col("seed") == seed
    control = scores.filter(F.col("policy") == INCUMBENT).groupBy("origin").agg(
        F.count(F.lit(1)).alias("_seeds"), F.max(primary.cast("int")).alias("_primary"))
    plan = control.agg(F.struct(
        F.max("origin").alias("last"), F.count(F.lit(1)).alias("n"), F.sum("_seeds").alias("pairs"),
        F.min("_seeds").alias("fewest"), F.min("_primary").alias("primary")).alias("p")).scalar()
    rows = scores.filter((F.col("policy") != INCUMBENT) & F.col("control").isNotNull()).withColumn("_plan", plan)
    recent = F.col("origin") == F.col("_plan.last")
    out = rows.groupBy("policy").agg(
        F.first("_plan").alias("_plan"), F.count("gain").alias("_pairs"), F.max(when(recent & primary, "gain")).alias("recent_gain"),
        F.min(when(recent, "gain")).alias("worst_recent_seed"),
        F.max(F.when(~recent & primary & (F.col("gain") < -F.col("loss_cap")), 1).otherwise(0)).alias("_older"),
    ).join(bounds.select("policy", "lower_bound"), "policy", "left")
    ready = (F.col("_plan.fewest") >= least_seeds) & (F.col("_plan.primary") == 1)
    reason = (
        F.when(F.col("_plan.n") < least_origins, "insufficient_temporal_evidence")
        .when(~ready | (F.col("_pairs") < F.col("_plan.pairs")), "missing_matched_origin_or_seed")
        .when(F.col("recent_gain") <= 0, "no_recent_improvement").when(F.col("worst_recent_seed") <= 0, "recent_gain_not_seed_stable")
        .when(F.col("_older") == 1, "older_origin_regression")
        .when(F.col("lower_bound").isNull() | (F.col("lower_bound") <= 0), "no_confident_temporal_improvement").otherwise("eligible"))
    eligible = F.col("reason") == "eligible"
    ranked = numbered(out.withColumn("reason", reason), [], [eligible.desc(), F.desc("recent_gain"), F.col("policy")])
    return ranked.select("policy", "recent_gain", "worst_recent_seed", "lower_bound", "reason", ((F.col("place") == 1) & eligible).alias("selected"))


def vetoes(scores: DataFrame, last_origin, seed: int = 0) -> DataFrame:
    """Challengers that no uncomputed fit can save, with their witness.

    ``last_origin`` comes from the declared experiment, not from what has been
    observed so far.  A base policy is out when it and all its blends are.
    """
    recent, primary = F.col("origin") == last_origin, F.col("seed") == seed
    reason = (
        F.when(recent & (F.col("gain") <= 0), F.when(primary, "no_recent_improvement").otherwise("recent_gain_not_seed_stable"))
        .when(~recent & primary & (F.col("gain") < -F.col("loss_cap")), "older_origin_regression"))
    order = F.when(recent & primary, 0).when(recent, 1).otherwise(2)
    challengers = scores.filter((F.col("policy") != INCUMBENT) & F.col("gain").isNotNull()).withColumn("reason", reason)
    first = top_rows(
        challengers.filter("reason IS NOT NULL"), ["policy"],
        [order, F.when(recent, F.col("seed")).otherwise(0), F.col("origin")], 1).drop("_rank")
    base = F.split("policy", "__blend_")[0]
    menu = challengers.select("policy").distinct().withColumn("base", base).groupBy("base").agg(F.count(F.lit(1)).alias("_menu"))
    found = first.withColumn("base", base)
    whole = found.groupBy("base").agg(F.count(F.lit(1)).alias("_found")).join(menu, "base").filter("_found = _menu")
    return found.join(whole.select("base"), "base").select("base", "policy", "reason", "origin", "seed", "gain")


# --- trials ------------------------------------------------------------------------------


def trial_loss(metric: str, score) -> Column:
    return 1 - as_column(score) if metric == "roc_auc" else as_column(score)


def small_finalist(trials: DataFrame, incumbent: str, metric: str = "roc_auc", cap: float = 0.01) -> DataFrame:
    """The narrowest trial within a relative loss of the newest fold's best, unanimous over seeds.

    ``trials`` holds (config, seed, features, complexity, recent_score), one row
    per fitted configuration and seed.
    """
    everything = Window.partitionBy(F.lit(1))
    rows = trials.withColumn("loss", trial_loss(metric, "recent_score")).withColumns({
        "_best": F.min("loss").over(Window.partitionBy("seed")),
        "_width": F.min(when(F.col("config") == incumbent, "features")).over(everything)})
    judged = rows.withColumn("_ok", F.col("loss") <= F.col("_best") * (1 + cap) + 1e-12)
    per_config = judged.groupBy("config").agg(
        F.min("features").alias("features"), F.min("complexity").alias("complexity"), F.min(F.col("_ok").cast("int")).alias("_all"),
        F.avg("loss").alias("mean_loss"), F.first("_width").alias("_width"))
    eligible = (F.col("config") != incumbent) & (F.col("features") < F.col("_width")) & (F.col("_all") == 1)
    ranked = numbered(per_config.withColumn("eligible", eligible), [], [F.desc("eligible"), "features", "complexity", "config"])
    return ranked.select("config", "features", "complexity", "mean_loss", "eligible", ((F.col("place") == 1) & F.col("eligible")).alias("chosen"))


def confidence_frontier(trials: DataFrame, margin: float = 0.01, multiplier: float = 1.0, top: int | None = None) -> DataFrame:
    """Trials whose shortfall to the leader is inside a margin or the joint error.

    ``trials`` holds (config, objective, error, features, complexity).
    """
    order = [F.desc("objective"), F.col("features"), F.col("complexity"), F.col("config")]
    once = top_rows(trials, ["config"], order, 1).drop("_rank")
    lead = Window.partitionBy(F.lit(1)).orderBy(*order)
    rows = once.withColumn("_lead", F.first(F.struct("objective", "error")).over(lead))
    allowed = F.greatest(F.lit(margin), multiplier * F.sqrt(F.pow("_lead.error", F.lit(2)) + F.pow("error", F.lit(2))))
    kept = rows.filter(F.col("_lead.objective") - F.col("objective") <= allowed)
    ranked = numbered(kept, [], order)
    return (ranked if top is None else ranked.filter(F.col("place") <= top)).select("config", "objective", "error", "features", "complexity", "place")


def negligible_gains(trials: DataFrame, gain: float = 0.002, growth: float = 2.0, multiplier: float = 1.0) -> DataFrame:
    """Flag trials that grow much over a simpler earlier trial and gain little.

    ``trials`` holds (number, config, score, objective, error, features, complexity);
    a trial is compared with the best earlier one that is no wider or deeper.
    """
    # A trials table holds one row per configuration that was ever fitted, a
    # list the caller enumerated, so the earlier ones fit in one array.
    fields = ("number", "score", "objective", "error", "features", "complexity")
    earlier = Window.partitionBy(F.lit(1)).orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    seen = F.collect_list(F.struct(*[F.col(c).alias(f"p_{c}") for c in fields])).over(earlier)
    simpler = F.filter("_seen", lambda p: (p["p_features"] <= F.col("features")) & (p["p_complexity"] <= F.col("complexity")))
    ranked = F.transform(simpler, lambda p: F.struct(p["p_objective"].alias("o"), (-p["p_number"]).alias("k"), p.alias("p")))
    out = trials.withColumn("_seen", seen).withColumn("p", F.array_max(ranked)["p"])
    threshold = F.greatest(F.lit(gain), multiplier * F.sqrt(F.col("error") * F.col("error") + F.col("p.p_error") * F.col("p.p_error")))
    won = F.col("score") - F.col("p.p_score")
    grew = F.col("features") / F.greatest(F.lit(1), F.col("p.p_features"))
    flag = F.coalesce((grew >= growth) & (won <= threshold), F.lit(False))
    return out.select("number", "config", won.alias("gain"), grew.alias("growth"), threshold.alias("threshold"), flag.alias("negligible"))


def rerank_choice(trials: DataFrame, folds: DataFrame, gain: float = 0.002, veto: float = 0.01, cap: float = 0.01,
                  multiplier: float = 1.0, growth: float = 2.0) -> DataFrame:
    """Walk-forward best, recent-safe best and the recommended smaller tie.

    ``trials`` holds (config, objective, score, error, recent_score,
    recent_error, features, complexity); ``folds`` holds (config, fold, score).
    """
    order = [F.desc("objective"), F.col("features"), F.col("complexity"), F.col("config")]
    everything = Window.partitionBy(F.lit(1))
    fold_scores = folds.groupBy("config").agg(F.map_from_entries(F.collect_list(F.struct("fold", "score"))).alias("_folds"))
    rows = trials.join(fold_scores, "config", "left").withColumns({
        "_walk": F.first("config").over(everything.orderBy(*order)),
        "_lead": F.first(F.struct("recent_score", "recent_error")).over(everything.orderBy(F.desc("recent_score"), *order[1:]))})
    needed = F.greatest(F.lit(max(gain, veto)), multiplier * F.sqrt(F.pow("_lead.recent_error", F.lit(2)) + F.pow("recent_error", F.lit(2))))
    rows = rows.withColumn("recent_safe", ~(F.col("_lead.recent_score") - F.col("recent_score") > needed))
    safe = everything.orderBy(F.desc("recent_safe"), *order)
    rows = rows.withColumn("_safe", F.first(F.struct("config", "score", "features", "_folds")).over(safe))
    gaps = F.transform(
        F.filter(F.map_entries("_folds"), lambda e: F.col("_safe._folds")[e["key"]].isNotNull()),
        lambda e: F.col("_safe._folds")[e["key"]] - e["value"])
    n = F.size(gaps).cast("double")
    mean = F.aggregate(gaps, F.lit(0.0), lambda a, x: a + x) / n
    square = F.aggregate(gaps, F.lit(0.0), lambda a, x: a + x * x) / n
    paired = F.when(n >= 2, F.sqrt(F.greatest(square - mean * mean, F.lit(0.0))) / F.sqrt(n))
    tolerance = F.least(F.greatest(F.lit(gain), multiplier * paired), F.lit(cap))
    tie = (
        F.col("recent_safe") & (F.col("_safe.score") - F.col("score") <= tolerance + 1e-12)
        & (F.col("features") * growth <= F.col("_safe.features")))
    rows = rows.withColumn("practical_tie", F.coalesce(tie, F.lit(False)))
    ranked = numbered(rows, [], [F.desc("practical_tie"), F.col("features"), F.col("complexity"), F.desc("objective"), F.col("config")])
    any_tie = F.max(F.col("practical_tie").cast("int")).over(everything) == 1
    best = F.col("config") == F.col("_safe.config")
    return ranked.select(
        "config", (F.col("config") == F.col("_walk")).alias("walk_forward_best"), "recent_safe", best.alias("recent_safe_best"), "practical_tie",
        F.when(any_tie, (F.col("place") == 1) & F.col("practical_tie")).otherwise(best).alias("recommended"))


# --- episodes ------------------------------------------------------------------------------


def candidate_rows(episodes: DataFrame) -> DataFrame:
    """Flatten episodes to candidates with a 0-100 relevance inside each episode.

    ``episodes`` holds (episode, database, task_type, stage, observations) where
    an observation is (candidate, status, objective, predicted, features).
    """
    rows = episodes.select("episode", "database", "task_type", "stage", F.explode("observations").alias("o")).select(
        "episode", "database", "task_type", "stage", "o.*")
    done = F.col("status") == "completed"
    span = rows.groupBy("episode").agg(F.min(when(done, "objective")).alias("_low"), F.max(when(done, "objective")).alias("_high"))
    out = rows.join(span, "episode")
    width = F.col("_high") - F.col("_low")
    relevance = F.when(~done, 0.0).when(width <= 1e-12, 1.0).otherwise(1 + 99 * (F.col("objective") - F.col("_low")) / width)
    return out.withColumn("relevance", relevance).drop("_low", "_high")


def corpus_summary(episodes: DataFrame) -> DataFrame:
    rows = episodes.select("database", "episode", "stage", F.size("observations").alias("n"))
    return rows.groupBy("stage").agg(
        F.count(F.lit(1)).alias("episodes"), F.count_distinct("database").alias("databases"), F.sum("n").alias("candidates"))


def evaluate_ranker(candidates: DataFrame, top: int = 3, tolerance: float = 0.01) -> DataFrame:
    """Regret and top-k recall of a ranker, per episode.

    ``candidates`` is the output of ``candidate_rows``; ``predicted`` orders them.
    """
    done = F.col("status") == "completed"
    order = Window.partitionBy("episode").orderBy(F.desc("predicted"), "candidate")
    placed = candidates.withColumn("_place", F.row_number().over(order))
    best = F.max_by("candidate", when(done, F.struct(F.col("objective"), F.col("candidate"))))
    stats = placed.groupBy("episode", "database", "task_type", "stage").agg(
        F.count(F.lit(1)).alias("candidates"), best.alias("best"), F.max(when(done, "objective")).alias("_high"),
        F.min(when(done, "objective")).alias("_low"), F.max(F.when(F.col("_place") == 1, F.col("candidate"))).alias("selected"),
        F.max(F.when((F.col("_place") == 1) & done, F.col("objective"))).alias("_got"),
        F.collect_list(F.when(F.col("_place") <= top, F.col("candidate"))).alias("_top"))
    width = F.col("_high") - F.col("_low")
    raw = F.col("_high") - F.col("_got")
    regret = F.when(F.col("_got").isNull(), 1.0).when(width > 1e-12, raw / width).otherwise(0.0)
    return stats.filter("_high IS NOT NULL").select(
        "episode", "database", "task_type", "stage", "candidates", "best", "selected", raw.alias("raw_regret"),
        regret.alias("normalized_regret"), (regret <= tolerance).alias("within_tolerance"),
        F.array_contains("_top", F.col("best")).alias("top_k_recall"), F.col("_got").isNull().alias("selected_failed"))


def ranker_summary(records: DataFrame) -> DataFrame:
    return records.groupBy("task_type").agg(
        F.count(F.lit(1)).alias("episodes"), F.avg("normalized_regret").alias("mean_regret"),
        F.avg(F.col("within_tolerance").cast("double")).alias("within_tolerance"),
        F.avg(F.col("top_k_recall").cast("double")).alias("top_k_recall"), F.avg(F.col("selected_failed").cast("double")).alias("failed"))
