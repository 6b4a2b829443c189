"""Declared tables, clocks and foreign keys.

A table is a lazy DataFrame plus its roles; nothing is read when it is declared.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CLOCK_BOUNDARIES = ("strict", "inclusive", "exact")


def quoted(name: str) -> str:
    """Back-tick a column name so spaces, dots and quotes survive."""
    return "`" + name.replace("`", "``") + "`"


def column(name: str):
    return F.col(quoted(name))


def names_of(key) -> tuple[str, ...]:
    """A key of one column may be declared by its name alone, one of several as an ordered tuple."""
    return (key,) if isinstance(key, str) else tuple(key)


def key_value(key, qualifier: str = ""):
    """One value for a key: its column, or a struct whose fields have the same names on both sides of a join."""
    parts = [column(f"{qualifier}{c}") for c in names_of(key)]
    return parts[0] if len(parts) == 1 else F.struct(*[p.alias(f"k{i}") for i, p in enumerate(parts)])


def complete(key, qualifier: str = ""):
    """Whether no part of a key is null; a key with a null part refers to nothing."""
    tests = [column(f"{qualifier}{c}").isNotNull() for c in names_of(key)]
    return reduce(lambda a, b: a & b, tests)


@dataclass(frozen=True)
class Relationship:
    """Edge from a parent table to a child row set.

    ``reduce`` aggregates the child; otherwise the edge is a keyed lookup.
    """

    parent: str
    child: str
    parent_key: tuple[str, ...]
    child_key: tuple[str, ...]
    reduce: bool = True


@dataclass(frozen=True)
class Table:
    name: str
    frame: DataFrame = field(repr=False, compare=False)
    key: tuple[str, ...] = ()
    time: str | None = None
    available_at: str | None = None
    foreign_keys: tuple[tuple[str | tuple[str, ...], str], ...] = ()
    context_keys: tuple[str, ...] = ()
    boundary: str = "strict"
    predicates: tuple[str, ...] = ()
    payload: tuple[str, ...] | None = None

    def __post_init__(self):
        if self.boundary not in CLOCK_BOUNDARIES:
            raise ValueError(f"boundary must be one of {CLOCK_BOUNDARIES}")
        names = self.frame.columns
        if len(set(names)) != len(names):
            raise ValueError(f"{self.name}: column names must be unique")
        missing = [c for c in self.structural if c not in names]
        if missing:
            raise ValueError(f"{self.name}: declared columns not found: {missing}")

    @property
    def structural(self) -> tuple[str, ...]:
        """Keys, clocks, foreign keys and peer-group keys, without repeats."""
        found = [*self.key, *(c for fk, _ in self.foreign_keys for c in names_of(fk)), *self.context_keys]
        found += [c for c in (self.time, self.available_at) if c]
        return tuple(dict.fromkeys(found))

    @property
    def payload_columns(self) -> tuple[str, ...]:
        wanted = self.payload if self.payload is not None else self.frame.columns
        return tuple(c for c in wanted if c in self.frame.columns and c not in self.structural)

    def missing_payload(self) -> tuple[str, ...]:
        return tuple(c for c in self.payload or () if c not in self.frame.columns)

    def projected(self) -> DataFrame:
        """Structural columns always survive the payload projection."""
        frame = self.frame
        for predicate in self.predicates:
            frame = frame.filter(F.expr(predicate))
        return frame.select(*(column(c) for c in (*self.structural, *self.payload_columns)))

    def with_frame(self, frame: DataFrame) -> Table:
        return replace(self, frame=frame)

    def numeric_payload(self) -> tuple[str, ...]:
        types = {f.name: f.dataType for f in self.frame.schema.fields}
        return tuple(c for c in self.payload_columns if isinstance(types[c], T.NumericType))


@dataclass(frozen=True)
class Catalog:
    tables: dict[str, Table]

    def __getitem__(self, name: str) -> Table:
        return self.tables[name]

    @property
    def relationships(self) -> tuple[Relationship, ...]:
        """One reducing edge and one lookup edge per declared foreign key."""
        edges = []
        for name in sorted(self.tables):
            for fk, parent in sorted((names_of(fk), p) for fk, p in self.tables[name].foreign_keys):
                if parent not in self.tables or not self.tables[parent].key:
                    continue
                parent_key = self.tables[parent].key
                if len(parent_key) != len(fk):
                    raise ValueError(f"{name}: foreign key {fk} does not fit the key {parent_key} of {parent}")
                edges.append(Relationship(parent, name, parent_key, fk, True))
                edges.append(Relationship(name, parent, fk, parent_key, False))
        return tuple(edges)

    def describe(self) -> list[dict]:
        """The declared roles as plain rows (what a sidecar file would hold)."""
        return [
            {
                "table": name,
                "key": ",".join(t.key),
                "time": t.time or "",
                "available_at": t.available_at or "",
                "foreign_keys": ",".join(f"{'+'.join(names_of(fk))}->{p}" for fk, p in t.foreign_keys),
            }
            for name, t in sorted(self.tables.items())
        ]

    def with_column_metadata(self, name: str) -> DataFrame:
        """Store the roles in the frame's own schema, next to the data."""
        table = self.tables[name]
        parents = [(names_of(fk), p) for fk, p in table.foreign_keys]
        out = []
        for f in table.frame.schema.fields:
            meta = {}
            if f.name in table.key:
                meta.update(role="key", place=table.key.index(f.name))
            elif f.name == table.time:
                meta["role"] = "event_time"
            elif f.name == table.available_at:
                meta["role"] = "available_at"
            # A column can be part of the key and of several foreign keys.
            parts = [f"{n}:{fk.index(f.name)}:{p}" for n, (fk, p) in enumerate(parents) if f.name in fk]
            if parts:
                meta["references"] = parts
            out.append(column(f.name).alias(f.name, metadata=meta))
        return table.frame.select(*out)


def table_from_metadata(name: str, frame: DataFrame) -> Table:
    """Rebuild a declaration from the roles stored in a schema."""
    roles: dict[str, list] = {"key": [], "event_time": [], "available_at": []}
    foreign: dict[int, tuple[str, list]] = {}
    for f in frame.schema.fields:
        meta = f.metadata or {}
        if meta.get("role") in roles:
            roles[meta["role"]].append((meta.get("place", 0), f.name))
        for part in meta.get("references", ()):
            number, place, parent = part.split(":", 2)
            foreign.setdefault(int(number), (parent, []))[1].append((int(place), f.name))
    keys = [(tuple(c for _, c in sorted(parts)), parent) for _, (parent, parts) in sorted(foreign.items())]
    return Table(
        name,
        frame,
        key=tuple(c for _, c in sorted(roles["key"])),
        time=next((c for _, c in roles["event_time"]), None),
        available_at=next((c for _, c in roles["available_at"]), None),
        foreign_keys=tuple((fk[0] if len(fk) == 1 else fk, parent) for fk, parent in keys),
    )
