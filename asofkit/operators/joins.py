"""Point-in-time joins: paths, lookups, as-of state, memberships, alignment, pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from asofkit.catalog import key_value, names_of, quoted
from asofkit.functions.scalars import as_column, content_rank, finite, hash_number, logit, sigmoid, stamp
from asofkit.requests import Requests, visible
from asofkit.session import checkpoint
from asofkit.skew import hashed_places, joined, lookup, running_totals, top_rows

KEYS = ["entity", "cutoff"]


def dimension(
    rows: DataFrame, table: DataFrame, fk: str, key: str, columns: list[str], time: str | None = None,
    inclusive: bool = True,
) -> DataFrame:
    """Look up a unique-key dimension, hiding rows dated after the cutoff.

    The grain of ``rows`` is kept because the key is unique; a dimension row
    that is not yet visible reads as missing, as in an outer join whose ON
    clause holds the clock.
    """
    picked = [as_column(key).alias(fk), *[as_column(c) for c in columns if c != fk]]
    if time is None:
        return lookup(rows, table.select(*picked), [fk])
    clock = as_column(time).alias("_dim_time")
    out = lookup(rows, table.select(*picked, clock), [fk])
    cutoff = F.col("cutoff")
    seen = F.col("_dim_time") <= cutoff if inclusive else F.col("_dim_time") < cutoff
    return out.withColumns({c: F.when(seen, F.col(c)) for c in columns}).drop("_dim_time")


def path_facts(hops: list[dict], until=None) -> DataFrame:
    """Join a foreign-key path once, before any cutoff is applied.

    Each hop is ``{"frame", "time", "key", "fk"}`` from the root's child down to
    the fact, keys as names or ordered tuples of names; ``fk`` of the first hop is the entity (a struct where
    it has several columns).  A fact is visible when
    every hop is, so the latest clock along the path (``known``) decides.  One
    join serves all cutoffs.  ``until`` is the last cutoff that will be asked:
    as a literal it reaches every hop's scan, which the joint clock cannot.
    """
    if until is not None:
        hops = [
            {**h, "frame": h["frame"].filter(as_column(h["time"]) <= stamp(until))} if h.get("time") else h for h in hops
        ]
    first, *rest = hops
    current = first["frame"].withColumn("entity", key_value(first["fk"]))
    known = [as_column(first["time"])] if first.get("time") else []
    parent = first
    for hop in rest:
        child = hop["frame"]
        pairs = zip(names_of(hop["fk"]), names_of(parent["key"]), strict=True)
        current = joined(child, current, [child[quoted(a)] == current[quoted(b)] for a, b in pairs])
        if hop.get("time"):
            known.append(as_column(hop["time"]))
        parent = hop
    clock = known[0] if len(known) == 1 else F.greatest(*known)
    out = current.withColumn("known", clock)
    return out.withColumn("ts", as_column(parent["time"])) if parent.get("time") else out


def latest_mature(
    history: DataFrame, requests: Requests, payload: list[str], available: str = "available_at",
    time: str = "ts", strict: bool = True, ties: tuple = (),
) -> DataFrame:
    """Newest observable row per (entity, cutoff): one aggregate, no sort.

    ``max_by`` keeps a single row per key and task, so a busy entity is reduced
    before it is shuffled.
    """
    rows = visible(history, requests, None, available=available, available_strict=strict)
    order = F.struct(F.col(available), F.col(time), *[as_column(t) for t in ties])
    bundle = F.struct(*[F.col(c) for c in payload], F.col(available), F.col(time))
    return (
        rows.groupBy(*KEYS).agg(F.max_by(bundle, order).alias("_r"))
        .select(*KEYS, *[F.col("_r")[c].alias(c) for c in dict.fromkeys([*payload, available, time])])
    )


def snapshot(requests: Requests, features: DataFrame) -> DataFrame:
    """Attach features fitted elsewhere at exactly the request's cutoff."""
    taken = set(requests.frame.columns) - set(KEYS)
    clash = taken & set(features.columns)
    missing = set(KEYS) - set(features.columns)
    if clash or missing:
        raise ValueError(f"provider columns clash {sorted(clash)} or miss keys {sorted(missing)}")
    return joined(requests.frame, features, KEYS, "left")


def snapshot_violations(features: DataFrame) -> DataFrame:
    """Keys that occur more than once in a provider's output."""
    return features.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")


def first_seen(facts: DataFrame, neighbor: str, known: str = "known") -> DataFrame:
    """Each (entity, neighbor) pair with the moment it is first known; a pair stays visible from then on."""
    return facts.filter(F.col(neighbor).isNotNull()).groupBy("entity", F.col(neighbor).alias("neighbor")).agg(F.min(known).alias("_first"))


def memberships(facts: DataFrame, requests: Requests, neighbor: str, limit: int | None, known: str = "known") -> DataFrame:
    """Distinct neighbours per request, at most ``limit`` by content hash, all of them without a limit.

    A pair stays visible once it is known, so facts reduce to each pair's first
    appearance before any cutoff is applied and no later distinct is needed.
    """
    seen = visible(first_seen(facts, neighbor, known), requests, "_first").select(*KEYS, "neighbor")
    if limit is None:
        return seen
    return top_rows(seen, KEYS, [content_rank("neighbor"), F.col("neighbor")], limit).drop("_rank")


def content_key(frame: DataFrame, columns: list[str], name: str = "content_key") -> DataFrame:
    """Stable identity for rows without a primary key."""
    return frame.withColumn(name, content_rank(*columns))


def member_payload(members: DataFrame, table: DataFrame, key: str, columns: list[str]) -> DataFrame:
    payload = table.select(F.col(key).alias("neighbor"), *[F.col(c) for c in columns])
    return lookup(members, payload, ["neighbor"])


def without_own(
    contributions: DataFrame, group: list[str], scope: list[str], totals: dict[str, str], root: str = "entity"
) -> DataFrame:
    """Group totals minus the root's own part, per (root, group).

    ``contributions`` may hold many rows per root and group; they are reduced to
    one before the group totals are formed, and no pair of roots is ever built.
    """
    own = contributions.groupBy(*scope, root, *group).agg(
        *[F.sum(c).alias(f"own_{n}") for n, c in totals.items()]
    )
    whole = own.groupBy(*scope, *group).agg(*[F.sum(f"own_{n}").alias(f"all_{n}") for n in totals])
    both = lookup(own, whole, [*scope, *group])
    return both.withColumns({f"others_{n}": F.col(f"all_{n}") - F.col(f"own_{n}") for n in totals})


def cohort_rows(rows: DataFrame, cohort: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the requested roots, kept before any aggregation.

    The semi join is salted, so a root with many rows is spread over tasks and
    the aggregation that follows combines before it shuffles.
    """
    return lookup(rows, cohort.select(*keys).distinct(), keys, "left_semi")


def reachable(tables: list[tuple[DataFrame, str | None, str | None]], cohort: DataFrame, key: str) -> list[DataFrame]:
    """Scope a path of tables to the rows a root cohort can reach.

    Each entry is (frame, foreign key to the table before, own key).  Statistics
    over other roots must not be built on the scoped rows.
    """
    kept, parent, parent_key = [], cohort, key
    for frame, fk, own in tables:
        owners = parent.select(F.col(parent_key).alias(fk))
        frame = cohort_rows(frame, owners, [fk])
        kept.append(frame)
        parent, parent_key = frame, own
    return kept


def available_roots(examples: DataFrame, roots: DataFrame, key: str, root_key: str, time: str, root_time: str):
    """Examples whose root exists at their timestamp."""
    known = roots.filter(F.col(root_key).isNotNull()).select(
        F.col(root_key).alias(key), F.col(root_time).alias("_root_time")
    )
    dated = lookup(examples, known, [key], "inner")
    return dated.filter(F.col("_root_time") <= F.col(time)).drop("_root_time")


def alignment_report(requests: DataFrame, predictions: DataFrame, keys: list[str]) -> DataFrame:
    """Population differences between requests and keyed predictions."""
    asked = requests.groupBy(*keys).agg(F.count(F.lit(1)).alias("asked"))
    given = predictions.groupBy(*keys).agg(F.count(F.lit(1)).alias("given"))
    both = asked.join(given, keys, "full_outer")
    return both.agg(
        F.coalesce(F.sum("asked"), F.lit(0)).alias("request_rows"),
        F.coalesce(F.sum("given"), F.lit(0)).alias("prediction_rows"),
        F.count(F.when(F.col("given").isNull(), 1)).alias("missing_keys"),
        F.count(F.when(F.col("asked").isNull(), 1)).alias("unexpected_keys"),
        F.count(F.when(F.col("given") > 1, 1)).alias("duplicated_keys"),
    )


def align_predictions(requests: DataFrame, predictions: DataFrame, keys: list[str]) -> DataFrame:
    """Predictions in request grain; a caller's duplicate requests each get a row."""
    return requests.join(predictions, keys, "left")


# --- pairs of examples ----------------------------------------------------


def nearest_negative(examples: DataFrame, coordinates: list[str], count: int, score: str, cohort: str = "cutoff"):
    """Nearest negative for the ``count`` worst positives of each cohort.

    The positives are a top-k report of bounded size, so they are broadcast;
    every negative is compared with them where it lies and only the best
    candidate per positive leaves the task.
    """
    logged = [F.log1p(F.coalesce(finite(c), F.lit(0.0))) for c in coordinates]
    spots = F.array(*logged)
    positives = top_rows(
        examples.filter("truth = 1"), [cohort], [F.col(score).desc(), F.col("entity")], count, "place"
    ).select(cohort, F.col("entity").alias("positive"), spots.alias("_p"), "place")
    negatives = examples.filter("truth = 0").select(cohort, F.col("entity").alias("negative"), spots.alias("_n"))
    pairs = negatives.join(F.broadcast(positives), [cohort])
    squares = F.zip_with("_p", "_n", lambda a, b: (a - b) * (a - b))
    distance = F.sqrt(F.aggregate(squares, F.lit(0.0), lambda acc, x: acc + x))
    scored = pairs.withColumn("distance", F.round(distance, 9))
    return scored.groupBy(cohort, "positive", "place").agg(
        F.min("distance").alias("log_distance"),
        F.min_by("negative", F.struct("distance", "negative")).alias("negative"),
    )


def quota(cohorts: DataFrame, cohort: str, maximum: int) -> DataFrame:
    """Split a global budget over cohorts; the earliest ones take the remainder."""
    order = Window.orderBy(cohort)
    n = F.count(F.lit(1)).over(Window.partitionBy())
    place = F.row_number().over(order) - 1
    base = F.floor(F.lit(maximum) / n)
    return cohorts.withColumn("quota", (base + (place < F.lit(maximum) % n).cast("int")).cast("long"))


def _cohorts(examples: DataFrame, maximum: int, cohort: str) -> DataFrame:
    """(cohort, quota, _pos, _neg) of cohorts with both classes."""
    sizes = examples.groupBy(cohort).agg(
        F.sum("truth").cast("long").alias("_pos"), F.sum(1 - F.col("truth")).cast("long").alias("_neg")
    ).filter("_pos > 0 and _neg > 0")
    return quota(sizes, cohort, maximum)


def _numbered(cohorts: DataFrame, cohort: str, most) -> DataFrame:
    """One row for each number below ``most`` with the place of its positive and how often it has come up before."""
    each = cohorts.withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), most - 1)))
    return each.withColumn("_pp", F.pmod("_i", "_pos") + 1).withColumn("_round", F.floor(F.col("_i") / F.col("_pos")))


def _uniform(placed: DataFrame, cohorts: DataFrame, cohort: str) -> DataFrame:
    """(cohort, quota, _i, positive, negative): the first pairs of a permutation of each cohort's product.

    Pair ``i`` has the positive at place ``i mod P``. Its negative is ``i div P`` places behind one that the
    positive's own hash picks among all N, wrapping around: every pair comes up once before any comes
    again, and from the first pairs on the negatives spread over the whole class.
    """
    draws = _numbered(cohorts, cohort, F.least(F.col("quota"), F.col("_pos") * F.col("_neg")))
    pos = placed.filter("truth = 1").select(cohort, F.col("place").alias("_pp"), F.col("entity").alias("positive"))
    neg = placed.filter("truth = 0").select(cohort, F.col("place").alias("_np"), F.col("entity").alias("negative"))
    start = hash_number("positive", cohort, F.lit("pair"))
    drawn = draws.join(pos, [cohort, "_pp"]).withColumn("_np", F.pmod(start + F.col("_round"), F.col("_neg")) + 1)
    return drawn.join(neg, [cohort, "_np"]).select(cohort, "quota", "_i", "positive", "negative")


def cohort_pairs(examples: DataFrame, maximum: int, cohort: str = "cutoff") -> DataFrame:
    """Distinct positive/negative pairs inside each cohort under one global budget, spread over both classes.

    They are generated by index; the full product is never formed, and all of it comes out where the budget covers it.
    """
    placed = checkpoint(hashed_places(examples.select(cohort, "entity", "truth"), [cohort, "truth"], ["entity", cohort]))
    return _uniform(placed, _cohorts(placed, maximum, cohort), cohort).select(cohort, "positive", "negative")


def _near(placed: DataFrame, cohorts: DataFrame, cohort: str, rounds: int) -> DataFrame:
    """(cohort, quota, _i, positive, negative): ``rounds`` x quota draws of a rival within one unit of log-odds.

    Negatives are ranked by score. How many lie below a positive's interval and up to its end is counted
    exactly, from running totals of negatives per score, and a draw takes a hashed rank between. Where the interval is
    empty the nearer of the two neighbouring ranks is taken.
    """
    neg = placed.filter("truth = 0").select(cohort, F.col("entity").alias("negative"), "z")
    pos = placed.filter("truth = 1").select(cohort, F.col("place").alias("_pp"), F.col("entity").alias("positive"), "z")
    # Three marks for each positive: the ends of its interval and its own score.
    ends = F.array(*[F.struct(F.lit(k).alias("k"), (F.col("z") + step).alias("at")) for k, step in enumerate((-1, 1, 0))])
    marks = pos.withColumn("_m", F.explode(ends)).select(cohort, "_pp", "positive", "z", "_m.k", "_m.at")
    zero = marks.select(cohort, F.col("at").alias("z"), F.lit(0).cast("long").alias("n"))
    cells = neg.select(cohort, "z", F.lit(1).cast("long").alias("n")).unionByName(zero).groupBy(cohort, "z").agg(F.sum("n").alias("n"))
    totals = running_totals(cells, [cohort], "z", {"upto": "n"}).withColumn("below", F.col("upto") - F.col("n"))
    totals = checkpoint(totals.select(cohort, "z", "upto", "below"))
    ranked = hashed_places(neg, [cohort, "z"], ["negative", cohort], "_tie").join(totals.select(cohort, "z", "below"), [cohort, "z"])
    ranked = ranked.select(cohort, "negative", F.col("z").alias("zn"), (F.col("below") + F.col("_tie") - 1).alias("_rank"))
    known = marks.join(totals.select(cohort, F.col("z").alias("at"), "upto", "below"), [cohort, "at"])
    pos = known.groupBy(cohort, "_pp", "positive", "z").agg(
        F.max(F.when(F.col("k") == 0, F.col("below"))).alias("_from"), F.max(F.when(F.col("k") == 1, F.col("upto"))).alias("_to"),
        F.max(F.when(F.col("k") == 2, F.col("below"))).alias("_under"))
    drawn = _numbered(cohorts, cohort, F.col("quota") * rounds).join(pos, [cohort, "_pp"])
    inside = F.col("_from") + F.pmod(hash_number("positive", cohort, "_round", F.lit("near")), F.col("_to") - F.col("_from"))
    beside = F.filter(F.array(F.col("_under") - 1, F.col("_under")), lambda r: (r >= 0) & (r < F.col("_neg")))
    drawn = drawn.withColumn("_rank", F.explode(F.when(F.col("_to") > F.col("_from"), F.array(inside)).otherwise(beside)))
    gap = F.round(F.abs(F.col("zn") - F.col("z")), 9)
    best = F.min(F.struct(gap.alias("gap"), "negative")).alias("_best")
    found = drawn.join(ranked, [cohort, "_rank"]).groupBy(cohort, "quota", "_i", "positive").agg(best)
    return found.select(cohort, "quota", "_i", "positive", F.col("_best.negative").alias("negative"))


def mixed_pairs(examples: DataFrame, maximum: int, cohort: str = "cutoff", score: str = "p") -> DataFrame:
    """Half uniform pairs and half near rivals, without repeats, under one global budget.

    Each cohort takes the first half of its uniform pairs, then new pairs among four times its quota of near draws, and
    fills what is short with further uniform pairs.
    """
    z = logit(F.least(F.greatest(F.col(score), F.lit(1e-6)), F.lit(1 - 1e-6)))
    placed = checkpoint(hashed_places(examples.select(cohort, "entity", "truth", z.alias("z")), [cohort, "truth"], ["entity", cohort]))
    cohorts = checkpoint(_cohorts(placed, maximum, cohort))
    i, q = F.col("_i"), F.col("quota")
    uniform = _uniform(placed, cohorts, cohort).withColumn("_turn", F.when(i < F.floor(q / 2), i).otherwise(5 * q + i))
    near = _near(placed, cohorts, cohort, 4).withColumn("_turn", q + i)
    first = uniform.unionByName(near).groupBy(cohort, "quota", "positive", "negative").agg(F.min("_turn").alias("_turn"))
    # At most six times the budget's rows stand here.
    place = F.row_number().over(Window.partitionBy(cohort).orderBy("_turn"))
    return first.withColumn("_place", place).filter(F.col("_place") <= q).select(cohort, "positive", "negative")


def pair_gradient(pairs: DataFrame, scores: DataFrame, cohort: str = "cutoff", score: str = "p") -> DataFrame:
    """Summed logistic pair gradient per row: up for positives, down for negatives."""
    z = logit(F.least(F.greatest(F.col(score), F.lit(1e-6)), F.lit(1 - 1e-6)))
    known = scores.select(cohort, "entity", z.alias("z"))
    a = known.select(cohort, F.col("entity").alias("positive"), F.col("z").alias("zp"))
    b = known.select(cohort, F.col("entity").alias("negative"), F.col("z").alias("zn"))
    error = sigmoid(F.col("zn") - F.col("zp"))
    scored = pairs.join(a, [cohort, "positive"]).join(b, [cohort, "negative"]).withColumn("_e", error)
    sides = F.array(
        F.struct(F.col("positive").alias("entity"), F.col("_e").alias("g")),
        F.struct(F.col("negative").alias("entity"), (-F.col("_e")).alias("g")),
    )
    return (
        scored.select(cohort, F.explode(sides).alias("_s")).groupBy(cohort, F.col("_s.entity").alias("entity"))
        .agg(F.sum("_s.g").alias("gradient"), F.count(F.lit(1)).alias("pairs"))
    )
