"""Requests ``(entity, cutoff)`` and the point-in-time expansion of events.

An event contributes to every cutoff at which it is visible.  When the distinct
cutoffs are few (checked, never assumed) each event row is exploded over that
short literal list and aggregated map-side, so no event is shuffled before it has
been partially reduced and a hot entity cannot overload one task.  With many
distinct cutoffs the same result comes from an equi-join on the entity in which
both sides carry a salt.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from asofkit.catalog import column
from asofkit.functions.scalars import minus_seconds, row_salt, stamp
from asofkit.skew import copies, joined, totals_at

GRID_LIMIT = 256
SALTS = 16


def _moment(value) -> dt.datetime:
    return value if isinstance(value, dt.datetime) else dt.datetime.fromisoformat(str(value))


@dataclass(frozen=True)
class Requests:
    frame: DataFrame
    cutoffs: tuple[dt.datetime, ...] | None
    phase: dt.datetime | None = None

    @classmethod
    def of(cls, frame: DataFrame, phase=None, cutoffs=None) -> Requests:
        """Wrap a frame with ``entity`` and ``cutoff`` columns.

        Without declared cutoffs at most ``GRID_LIMIT + 1`` distinct values are
        fetched, only to learn whether the short list applies.
        """
        if cutoffs is None:
            rows = frame.select("cutoff").distinct().limit(GRID_LIMIT + 1).collect()
            cutoffs = [r[0] for r in rows] if len(rows) <= GRID_LIMIT else None
        if cutoffs is not None:
            cutoffs = tuple(sorted({_moment(c) for c in cutoffs}))
            cutoffs = cutoffs if len(cutoffs) <= GRID_LIMIT else None
        return cls(frame, cutoffs, _moment(phase) if phase is not None else None)

    @classmethod
    def every(cls, entities: DataFrame, key: str, cutoffs, phase=None) -> Requests:
        """Every entity at every listed cutoff."""
        moments = [_moment(c) for c in cutoffs]
        frame = entities.select(F.col(key).alias("entity")).withColumn(
            "cutoff", F.explode(F.array(*[stamp(c) for c in moments]))
        )
        return cls.of(frame, phase=phase, cutoffs=moments)

    def ceiling(self, cutoff: Column | None = None) -> Column:
        """Knowledge clock: the query, never past the phase boundary."""
        cutoff = F.col("cutoff") if cutoff is None else cutoff
        return cutoff if self.phase is None else F.least(cutoff, stamp(self.phase))

    def latest(self) -> dt.datetime | None:
        """Last moment any request can see, when the cutoffs are listed."""
        if self.cutoffs is None:
            return None
        return self.cutoffs[-1] if self.phase is None else min(self.cutoffs[-1], self.phase)

    def keys(self) -> DataFrame:
        return self.frame.select("entity", "cutoff").distinct()

    def grid(self, spark) -> DataFrame | None:
        """The distinct cutoffs as a table that is safe to broadcast."""
        if self.cutoffs is None:
            return None
        return spark.createDataFrame([(c,) for c in self.cutoffs], "cutoff timestamp_ntz")

    def align(self, block: DataFrame, zero=(), defaults=None) -> DataFrame:
        """One output row per request; counts are zero-filled, means stay null."""
        out = joined(self.frame, block, ["entity", "cutoff"], "left")
        fill = {**{c: 0 for c in zero}, **(defaults or {})}
        columns = [F.coalesce(F.col(c), F.lit(fill[c])).alias(c) if c in fill else F.col(c) for c in out.columns]
        return out.select(*columns) if fill else out


def within(
    requests: Requests,
    time: str = "ts",
    *,
    boundary: str = "strict",
    lookback_days: float | None = None,
    lookback_open: bool = False,
    available: str | None = None,
    available_strict: bool = False,
) -> Column:
    """The visibility predicate of a row against its ``cutoff`` column."""
    ceiling = requests.ceiling()
    tests = []
    if time is not None:
        t = F.col(time)
        tests.append(
            {"strict": t < ceiling, "inclusive": t <= ceiling, "exact": t == F.col("cutoff")}[boundary]
        )
        if lookback_days is not None:
            lower = minus_seconds("cutoff", lookback_days * 86_400)
            tests.append(t > lower if lookback_open else t >= lower)
    if available is not None:
        a = F.col(available)
        tests.append(a < ceiling if available_strict else a <= ceiling)
    return reduce(lambda a, b: a & b, tests)


def visible(events: DataFrame, requests: Requests, time: str = "ts", **rule) -> DataFrame:
    """Event rows repeated for each cutoff at which they are visible.

    The column ``entity`` must be present; ``cutoff`` is added.
    """
    condition = within(requests, time, **rule)
    if requests.cutoffs is not None:
        events = _static_bounds(events, requests, time, rule)
        grid = F.array(*[stamp(c) for c in requests.cutoffs])
        return events.withColumn("cutoff", F.explode(grid)).filter(condition)
    asked = copies(requests.keys(), SALTS)
    salted = events.withColumn("_salt", row_salt(SALTS, *[column(c) for c in _hashable(events)]))
    return salted.join(asked, ["entity", "_salt"]).filter(condition).drop("_salt")


def _hashable(frame: DataFrame) -> list[str]:
    return [f.name for f in frame.schema.fields if f.dataType.typeName() != "map"]


def _static_bounds(events, requests, time, rule):
    """Literal outer bounds, which reach the scan (a cutoff column cannot)."""
    if time is None:
        return events
    latest, earliest = requests.cutoffs[-1], requests.cutoffs[0]
    if requests.phase is not None and rule.get("boundary", "strict") != "exact":
        latest = min(latest, requests.phase)
    strict = rule.get("boundary", "strict") == "strict"
    upper = F.col(time) < stamp(latest) if strict else F.col(time) <= stamp(latest)
    events = events.filter(upper)
    lookback = rule.get("lookback_days")
    if lookback is not None:
        events = events.filter(F.col(time) >= stamp(earliest - dt.timedelta(days=lookback)))
    return events


def population_totals(
    events: DataFrame, requests: Requests, groups: DataFrame, keys: list[str], time: str, measures: dict[str, Column]
) -> DataFrame:
    """Sums over the events of all entities, asked for or not, that are visible at each (keys, cutoff) of ``groups``.

    Takes any number of distinct cutoffs. Columns: keys, cutoff and the measures.
    """
    points = groups.select(*keys, "cutoff").distinct()
    if requests.phase is None:
        return totals_at(events, points, keys, time, "cutoff", measures)
    points = points.withColumn("_seen", requests.ceiling())
    totals = totals_at(events, points, keys, time, "_seen", measures)
    return joined(points, totals, [*keys, "_seen"]).drop("_seen")


def by_cutoff(frame: DataFrame, requests: Requests) -> DataFrame:
    """A one-row-per-cutoff table, broadcast only when that count is bounded."""
    return F.broadcast(frame) if requests.cutoffs is not None else frame
