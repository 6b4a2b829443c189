"""Recursive keyed reduction over any declared catalog.

A program is a tree of table *occurrences* under a root. A table may occur several times, under several
parents or again below itself, so the tree is finite over a cyclic schema too. An edge either reduces the
child's rows to one row per foreign key, or looks up the one row that a foreign key names. The fold goes from
the leaves to the root: the rows of an occurrence, already joined with what their own children gave, are summarised
and meet their parent at its grain, so siblings cannot multiply each other.

Every column carries the aggregate that made it. What is still a table's own value is summarised by the functions
the program names for it; what has been aggregated goes on by the one continuation of its kind (``families.CONTINUATION``:
maxima by max, counts and sums by sum, means by mean). Looked-up values stay own values.

Clocks: a row counts at a cutoff when its table's event clock (and availability) lets it through; rows of
tables without a clock count at all cutoffs and are kept once, not per cutoff, until a dated child
meets them. With listed cutoffs nothing is joined to the requests before the root; with many, the requests'
(entity, cutoff) pairs go down the tree by the same keys. A dated leaf then meets its parent as states that hold between
two cutoffs (``_states``), so what it shuffles grows with its rows and not with the cutoffs. A key with a null part refers to nothing. A parent without
children has nulls.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from asofkit.catalog import Catalog, Relationship, Table, complete, key_value, quoted
from asofkit.functions.scalars import stamp
from asofkit.operators.families import CONTINUATION
from asofkit.requests import SALTS, Requests, visible, within
from asofkit.skew import copies, joined

KEYS = ["entity", "cutoff"]
ROWS = "*"  # the program's name for the number of rows
FUNCTIONS = {"count": F.count, "sum": F.sum, "min": F.min, "max": F.max, "avg": F.avg}
#: Distinct cutoffs up to which a leaf is folded into states; they stand in the plan as one array.
SLOT_LIMIT = 4096
STRIDE = 64
#: A program: for each table the functions of its columns; ROWS takes only "count".
Program = dict[str, dict[str, tuple[str, ...]]]


@dataclass(frozen=True)
class Occurrence:
    """One place of a table in the tree; ``label`` tells it from its siblings and names its features."""

    table: str
    label: str
    edge: Relationship | None = None
    children: tuple[Occurrence, ...] = ()

    def walks(self):
        """The tables on the way to each occurrence, this one first."""
        yield (self.table,)
        for child in self.children:
            for walk in child.walks():
                yield (self.table, *walk)


def _children(catalog: Catalog, table: str, came: Relationship | None, lookups: bool) -> list[Relationship]:
    """Edges that leave a table, but for the one that only leads back over the edge it was reached by."""
    back = came and replace(came, parent=came.child, child=came.parent, parent_key=came.child_key, child_key=came.parent_key, reduce=not came.reduce)
    return [e for e in catalog.relationships if e.parent == table and (e.reduce or lookups) and not (back and e == back and not e.reduce)]


def _labelled(edges: list[Relationship]) -> list[tuple[str, Relationship]]:
    """Edges with names that tell them apart: the child's, and its key where the child has several."""
    names = [e.child for e in edges]
    return [(e.child if names.count(e.child) == 1 else "_".join([e.child, *(e.child_key if e.reduce else e.parent_key)]), e) for e in edges]


def occurrences(catalog: Catalog, root: str, depth: int, repeats: int = 1, lookups: bool = True) -> Occurrence:
    """The tree of all walks of up to ``depth`` edges on which no table occurs more than ``repeats`` times."""
    def grow(table, label, edge, seen):
        children = ()
        if len(seen) <= depth:
            edges = [e for e in _children(catalog, table, edge, lookups) if seen.count(e.child) < repeats]
            children = tuple(grow(e.child, name, e, (*seen, e.child)) for name, e in _labelled(edges))
        return Occurrence(table, label, edge, children)

    return grow(root, root, None, (root,))


def along(catalog: Catalog, *walks: tuple[str, ...]) -> Occurrence:
    """The tree of the given walks, each a tuple of tables from the root on, of any length and with any repeats.

    Between two tables the child's reduction is taken where there is one, else the lookup.
    """
    def grow(table, label, edge, tails):
        edges = _children(catalog, table, edge, True)
        wanted: dict[str, list] = {}
        for tail in tails:
            if tail:
                wanted.setdefault(tail[0], []).append(tail[1:])
        chosen = []
        for child, rest in wanted.items():
            leading = sorted((e for e in edges if e.child == child), key=lambda e: not e.reduce)
            if not leading:
                raise ValueError(f"no declared edge leads from {table} to {child}")
            chosen.append((leading[0], rest))
        labels = _labelled([e for e, _ in chosen])
        return Occurrence(table, label, edge, tuple(grow(e.child, name, e, rest) for (name, e), (_, rest) in zip(labels, chosen, strict=True)))

    root = walks[0][0]
    return grow(root, root, None, [walk[1:] for walk in walks])


@dataclass(frozen=True)
class _Rows:
    """An occurrence's rows: a frame, its features {name: kind or functions} in columns behind ``path``, and whether rows stand at cutoffs."""

    frame: DataFrame
    path: str
    features: dict
    dated: bool


def _at_cutoffs(frame: DataFrame, key, path: str, asked: Requests) -> DataFrame:
    """Undated rows at each cutoff: the listed ones, or those at which their key is asked for."""
    if asked.cutoffs is not None:
        return frame.withColumn("cutoff", F.explode(F.array(*[stamp(c) for c in asked.cutoffs])))
    pairs = copies(asked.keys(), SALTS)
    salted = frame.withColumn("entity", key_value(key, path)).withColumn("_salt", F.floor(F.rand(0) * SALTS).cast("int"))
    return salted.join(pairs, ["entity", "_salt"]).drop("entity", "_salt")


def _rows(table: Table, key: tuple[str, ...], path: str, asked: Requests) -> tuple[DataFrame, bool]:
    """The table's rows with a complete key, columns named after their place in the tree."""
    frame = table.projected().select(*[F.col(quoted(c)).alias(f"{path}{c}") for c in (*table.structural, *table.payload_columns)])
    frame = frame.filter(complete(key, path))
    if table.time or table.available_at:
        rule = {"boundary": table.boundary} if table.time else {}
        if table.available_at:
            rule["available"] = quoted(f"{path}{table.available_at}")
        seen = visible(frame.withColumn("entity", key_value(key, path)), asked, quoted(f"{path}{table.time}") if table.time else None, **rule)
        return seen.drop("entity"), True
    if asked.cutoffs is None:
        return _at_cutoffs(frame, key, path, asked), True
    return frame, False


def _summaries(rows: _Rows, name: str, program: dict) -> tuple[list, dict]:
    """Aggregates of a child's features under the names its parent sees, and their kinds."""
    aggs, kinds = [], {}

    def add(column, label, kind):
        aggs.append(column.alias(label))
        kinds[label] = kind

    if "count" in program.get(ROWS, ()):
        add(F.count(F.lit(1)), f"{name}_rows", "count")
    for feature, made in rows.features.items():
        column = quoted(f"{rows.path}{feature}")
        if isinstance(made, tuple):
            for function in made:
                add(FUNCTIONS[function](column), f"{name}_{feature}_{function}", function)
        else:
            add(CONTINUATION[made](column), f"{name}_{feature}_{made}", made)
    return aggs, kinds


def _is_leaf(table: Table, place: Occurrence, program: dict) -> bool:
    """Whether an occurrence is dated, has no children, is reduced and gives something."""
    dated = table.time or table.available_at
    return bool(dated and place.edge.reduce and not place.children and any(program.values()) and not (table.time and table.boundary == "exact"))


def _missed(moment: Column, cutoffs: list, strict: bool) -> Column:
    """How many of the sorted cutoffs come too early to see a moment."""
    def early(c):
        return c <= moment if strict else c < moment

    heads = F.size(F.filter(F.array(*[stamp(c) for c in cutoffs[::STRIDE]]), early))
    near = F.slice(F.array(*[stamp(c) for c in cutoffs]), (heads - 1) * STRIDE + 1, F.lit(STRIDE))
    return F.when(heads > 0, (heads - 1) * STRIDE + F.size(F.filter(near, early))).otherwise(F.lit(0))


def _states(table: Table, edge: Relationship, label: str, asked: Requests, program: dict, cutoffs: list) -> tuple[DataFrame, dict]:
    """A dated leaf's summaries as states: one row per link and cutoff at which it changes, with the time it holds for.

    A row that a cutoff sees is seen by all later ones. So rows are aggregated by the first cutoff that sees them, and running
    aggregates over those, at most one for each cutoff and link, give every cutoff's value.
    """
    def at(name: str) -> str:
        return quoted(f"/{name}")

    frame = table.projected().select(*[F.col(quoted(c)).alias(f"/{c}") for c in (*table.structural, *table.payload_columns)])
    rule, missed = {}, []
    if table.time:
        rule["boundary"] = table.boundary
        missed.append(_missed(F.col(at(table.time)), cutoffs, table.boundary == "strict"))
    if table.available_at:
        rule["available"] = at(table.available_at)
        missed.append(_missed(F.col(at(table.available_at)), cutoffs, False))
    slot = F.greatest(*missed) if len(missed) > 1 else missed[0]
    seen = frame.filter(complete(edge.child_key, "/")).withColumn("cutoff", stamp(cutoffs[-1]))
    seen = seen.filter(within(asked, at(table.time) if table.time else None, **rule))

    parts, kinds, direct, values = [], {}, [], []
    by_slot = Window.partitionBy("_link").orderBy("_slot")
    running = by_slot.rowsBetween(Window.unboundedPreceding, 0)

    def total(column: Column, onward=F.sum) -> Column:
        parts.append(column.alias(f"_p{len(parts)}"))
        return onward(f"_p{len(parts) - 1}").over(running)

    wanted = [(f"{label}_rows", "count", F.lit(1))] if "count" in program.get(ROWS, ()) else []
    wanted += [(f"{label}_{c}_{f}", f, F.col(at(c))) for c, functions in program.items() if c != ROWS for f in functions]
    for name, function, column in wanted:
        kinds[name] = function
        direct.append(FUNCTIONS[function](column).alias(name))
        if function == "avg":
            values.append(total(F.sum(column)) / F.nullif(total(F.count(column)), F.lit(0)))
        else:
            values.append(total(FUNCTIONS[function](column), {"min": F.min, "max": F.max}.get(function, F.sum)))
    types = seen.agg(*direct).schema
    changes = seen.groupBy(key_value(edge.child_key, "/").alias("_link"), slot.alias("_slot")).agg(*parts)
    grid = F.array(*[stamp(c) for c in cutoffs])
    until = F.lead("_slot").over(by_slot)
    states = changes.select(
        "_link", F.element_at(grid, F.col("_slot") + 1).alias("_from"), F.when(until.isNotNull(), F.element_at(grid, until + 1)).alias("_until"),
        *[v.cast(f.dataType).alias(f.name) for v, f in zip(values, types, strict=True)])
    return states, kinds


def _fold(catalog: Catalog, place: Occurrence, key: tuple[str, ...], path: str, asked: Requests, program: Program, cutoffs: list | None) -> _Rows:
    """The rows of an occurrence with all that its descendants give; ``cutoffs``, if known, are all of many cutoffs."""
    table = catalog[place.table]
    frame, dated = _rows(table, key, path, asked)
    features = {c: tuple(functions) for c, functions in program.get(table.name, {}).items() if c != ROWS}
    for n, child in enumerate(place.children):
        edge, below = child.edge, f"{path}{n}/"
        if cutoffs and _is_leaf(catalog[child.table], child, program.get(child.table, {})):
            states, kinds = _states(catalog[child.table], edge, child.label, asked, program.get(child.table, {}), cutoffs)
            states = states.select("_link", "_from", "_until", *[F.col(quoted(c)).alias(f"{path}{c}") for c in kinds])
            link = F.when(complete(edge.parent_key, path), key_value(edge.parent_key, path))
            holds = (link == states["_link"]) & (F.col("cutoff") >= states["_from"]) & (states["_until"].isNull() | (F.col("cutoff") < states["_until"]))
            frame = joined(frame, states, holds, "left").drop("_link", "_from", "_until")
            features |= kinds
            continue
        if asked.cutoffs is not None:
            question = asked
        else:
            pairs = frame.filter(complete(edge.parent_key, path)).select(key_value(edge.parent_key, path).alias("entity"), "cutoff").distinct()
            question = Requests(pairs, None, asked.phase)
        rows = _fold(catalog, child, edge.child_key, below, question, program, cutoffs)
        if rows.dated and not dated:
            frame, dated = _at_cutoffs(frame, key, path, asked), True
        link = [key_value(edge.child_key, below).alias("_link"), *([F.col("cutoff")] if rows.dated else [])]
        if edge.reduce:
            aggs, kinds = _summaries(rows, child.label, program.get(child.table, {}))
            if not aggs:
                continue
            block = rows.frame.groupBy(*link).agg(*aggs)
        else:
            # One row for each key: its values go on as they are, under the child's name.
            kinds = {f"{child.label}_{c}": made for c, made in rows.features.items()}
            block = rows.frame.select(*link, *[F.col(quoted(f"{below}{c}")).alias(new) for c, new in zip(rows.features, kinds, strict=True)])
        on = ["_link", "cutoff"] if rows.dated else ["_link"]
        block = block.select(*on, *[F.col(quoted(c)).alias(f"{path}{c}") for c in kinds])
        frame = frame.withColumn("_link", F.when(complete(edge.parent_key, path), key_value(edge.parent_key, path)))
        # A reduction grows with its parent; a table that is looked up may be small.
        frame = (joined(frame, block, on, "left") if edge.reduce else frame.join(block, on, "left")).drop("_link")
        features |= kinds
    return _Rows(frame, path, features, dated)


def reduce_tree(catalog: Catalog, tree: Occurrence, requests: Requests, program: Program) -> DataFrame:
    """(entity, cutoff) of the requests with the root's columns and all features that reach it.

    The entity is the root's key, a struct of fields k0, k1, ... where it has several columns. A feature's name begins with
    the labels of the occurrences it came through and ends with the functions that made it, innermost first.
    """
    key = catalog[tree.table].key
    cutoffs = None
    if requests.cutoffs is None:
        found = requests.frame.select("cutoff").filter("cutoff IS NOT NULL").distinct().limit(SLOT_LIMIT + 1).collect()
        cutoffs = sorted(r[0] for r in found) if len(found) <= SLOT_LIMIT else None
    rows = _fold(catalog, tree, key, "/", requests, program, cutoffs)
    columns = [F.col(quoted(f"/{c}")).alias(c) for c in rows.features]
    block = rows.frame.select(key_value(key, "/").alias("entity"), *(["cutoff"] if rows.dated else []), *columns)
    return requests.frame.join(block, KEYS if rows.dated else ["entity"], "left")
