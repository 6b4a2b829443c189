"""Frozen feature programs: learn choices once, replay them at any cutoff.

The cutoff is a column of the request, so replaying a plan needs no rewriting of
date literals; only vocabularies, cutpoints, windows and bindings are stored.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from asofkit.catalog import Catalog
from asofkit.functions.scalars import count_if, hash_number, minus_seconds, stamp
from asofkit.operators import families as fam
from asofkit.operators.joins import path_facts
from asofkit.plans.paths import path_hops
from asofkit.requests import Requests, visible
from asofkit.sources.io import phase_snapshot

KEYS = ["entity", "cutoff"]
FAMILIES = ("base", "cdf", "conditional", "sequence")


def blueprint(catalog: Catalog) -> dict:
    """Declared structure of the sources: roles, edges and column types."""
    return {
        "tables": catalog.describe(),
        "columns": {n: {f.name: f.dataType.simpleString() for f in t.frame.schema.fields} for n, t in sorted(catalog.tables.items())},
    }


def binding_changes(expected: dict, catalog: Catalog) -> list[tuple[str, str, str, str]]:
    """Columns whose declared type differs from the plan's: (table, column, was, now)."""
    now = blueprint(catalog)["columns"]
    out = []
    for table in sorted({*expected["columns"], *now}):
        was, has = expected["columns"].get(table, {}), now.get(table, {})
        for c in sorted({*was, *has}):
            if was.get(c) != has.get(c):
                out.append((table, c, was.get(c, ""), has.get(c, "")))
    return out


@dataclass(frozen=True)
class FeaturePlan:
    steps: tuple[tuple[str, str], ...]
    numeric: tuple[str, ...]
    categories: dict[str, tuple]
    cutpoints: dict[str, tuple[float, ...]]
    periods: tuple[int, ...]
    families: tuple[str, ...] = FAMILIES
    lookback_days: int = fam.LOOKBACK_DAYS
    sources: dict | None = None

    # --- fitting and storage ---------------------------------------------------

    @classmethod
    def fit(cls, catalog: Catalog, steps, cutoff, numeric, categorical, periods=(30, 365), top=2, **options) -> FeaturePlan:
        """Learn vocabularies and cutpoints on rows before the training cutoff."""
        facts = path_facts(path_hops(catalog, steps), until=cutoff).filter(F.col("known") < stamp(cutoff))
        cuts = fam.cutpoints(facts, list(numeric), steps=3)
        words = {c: tuple(fam.frequent_values(facts, c, top=top, threshold=top)) for c in categorical}
        return cls(
            tuple(map(tuple, steps)), tuple(numeric), words, {k: tuple(v) for k, v in cuts.items()}, tuple(periods),
            sources=blueprint(catalog), **options)

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @classmethod
    def from_json(cls, payload: str) -> FeaturePlan:
        raw = json.loads(payload)
        return cls(
            tuple(tuple(s) for s in raw["steps"]), tuple(raw["numeric"]), {k: tuple(v) for k, v in raw["categories"].items()},
            {k: tuple(v) for k, v in raw["cutpoints"].items()}, tuple(raw["periods"]), tuple(raw["families"]),
            raw["lookback_days"], raw["sources"])

    def fingerprint(self) -> str:
        return hashlib.sha256(self.to_json().encode()).hexdigest()

    def with_families(self, *families: str) -> FeaturePlan:
        return replace(self, families=families)

    def verify(self, catalog: Catalog) -> None:
        changes = binding_changes(self.sources, catalog) if self.sources else []
        if changes:
            raise ValueError(f"sources differ from the frozen plan: {changes[:5]}")

    # --- replay -------------------------------------------------------------------

    def aggregates(self) -> list:
        out = [F.count(F.lit(1)).alias("rows")]
        if "base" in self.families:
            for c in self.numeric:
                out += fam.base_numeric(c)
        if "cdf" in self.families:
            for c, cuts in self.cutpoints.items():
                out += fam.cdf(c, list(cuts))
        if "conditional" in self.families:
            for c, values in self.categories.items():
                out += [count_if(F.col(c) == F.lit(v)).alias(f"{c}_v{i}_count") for i, v in enumerate(values)]
        if "sequence" in self.families:
            out += [count_if(fam.since("ts", p)).alias(f"rows_{p}d") for p in self.periods]
        return out

    def transform(self, catalog: Catalog, requests: Requests) -> DataFrame:
        """One row per request; discovery is off and bindings are checked first."""
        self.verify(catalog)
        facts = path_facts(path_hops(catalog, self.steps), until=requests.latest())
        rows = visible(facts, requests, "known").filter(F.col("ts") >= minus_seconds("cutoff", self.lookback_days * 86_400))
        block = rows.groupBy(*KEYS).agg(*self.aggregates())
        zero = [c for c in block.columns if c == "rows" or c.startswith("rows_") or "_v" in c and c.endswith("_count")]
        return requests.align(block, zero=zero)


def batched(plan: FeaturePlan, catalog: Catalog, requests: Requests, batches: int) -> DataFrame:
    """The same frame built in entity batches; only memory differs, never a value."""
    out = None
    for i in range(batches):
        part = Requests(requests.frame.filter(F.pmod(hash_number("entity"), F.lit(batches)) == i), requests.cutoffs, requests.phase)
        frame = plan.transform(catalog, part)
        out = frame if out is None else out.unionByName(frame)
    return out


def phase_folds(plan: FeaturePlan, catalog: Catalog, held: DataFrame, folds: list[dict]) -> DataFrame:
    """Held-out cohorts of each fold under that fold's frozen knowledge.

    A fold is {"fold", "boundary", "cutoffs"}; tables are censored at the
    boundary and the query clock keeps running for windows and ages.
    """
    out = None
    for f in folds:
        asked = held.filter(F.col("cutoff").isin([stamp(c) for c in f["cutoffs"]]))
        requests = Requests.of(asked.select(*KEYS), phase=f["boundary"], cutoffs=f["cutoffs"])
        frame = plan.transform(phase_snapshot(catalog, f["boundary"]), requests).withColumn("fold", F.lit(f["fold"]).cast("long"))
        out = frame if out is None else out.unionByName(frame)
    return out
