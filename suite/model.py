"""The driver tables as a declared catalog."""

from __future__ import annotations

from asofkit import Catalog, Table


def catalog(t) -> Catalog:
    tables = [
        Table("region", t.region, ("r_regionkey",)),
        Table("nation", t.nation, ("n_nationkey",), foreign_keys=(("n_regionkey", "region"),)),
        Table("customer", t.customer, ("c_custkey",), foreign_keys=(("c_nationkey", "nation"),)),
        Table("supplier", t.supplier, ("s_suppkey",), foreign_keys=(("s_nationkey", "nation"),)),
        Table("part", t.part, ("p_partkey",)),
        Table(
            "orders", t.orders, ("o_orderkey",), time="o_orderdate",
            foreign_keys=(("o_custkey", "customer"),),
        ),
        Table(
            "lineitem", t.lineitem, time="l_shipdate",
            foreign_keys=(("l_orderkey", "orders"), ("l_partkey", "part"), ("l_suppkey", "supplier")),
        ),
        Table("events", t.events, ("event_id",), time="ts", foreign_keys=(("user_id", "customer"),)),
    ]
    return Catalog({x.name: x for x in tables})
