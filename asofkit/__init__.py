"""Point-in-time relational features on Spark DataFrames."""

from asofkit.catalog import Catalog, Relationship, Table
from asofkit.requests import Requests

__all__ = ["Catalog", "Relationship", "Requests", "Table"]
