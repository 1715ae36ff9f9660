"""The data dictionary as tables: what a catalog holds, and readers of a database's own dictionary views.

The views are small (a row for each table, column or constraint); they are built
from schemas only, so nothing is read from the tables themselves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..catalog import Catalog
from .tables import FETCH_ROWS

SCHEMAS = {
    "ALL_USERS": "username string",
    "ALL_TABLES": "owner string, table_name string",
    "ALL_VIEWS": "owner string, view_name string",
    "ALL_TAB_COLUMNS": "owner string, table_name string, column_name string, column_id int, data_type string, nullable string, data_default string",
    "ALL_SYNONYMS": "owner string, synonym_name string, table_owner string, table_name string",
    "ALL_TYPES": "owner string, type_name string, typecode string, upper_bound int",
    "ALL_CONSTRAINTS": "owner string, table_name string, constraint_name string, constraint_type string, search_condition string, r_table_name string",
    "ALL_CONS_COLUMNS": "owner string, table_name string, constraint_name string, column_name string, position int",
    "ALL_SEQUENCES": "sequence_owner string, sequence_name string, min_value long, increment_by long, last_number long",
}


def rows(catalog: Catalog, view: str) -> list[tuple]:
    """The rows of one dictionary view."""
    names = sorted(set(catalog.tables) | (set(catalog.loaders) - set(catalog.views)))
    names = [k for k in names if k[1] not in SCHEMAS]
    kinds = catalog.types.items()
    if view == "ALL_USERS":
        return [(s,) for s in sorted({catalog.schema, *catalog.schemas, *(s for s, _ in names), *(s for s, _ in catalog.views)})]
    if view == "ALL_TABLES":
        return [k for k in names if k not in catalog.views]
    if view == "ALL_VIEWS":
        return sorted(catalog.views)
    if view == "ALL_TAB_COLUMNS":
        return [
            (s, t, f.name.upper(), i + 1, f.dataType.simpleString(), "Y" if f.nullable and f.name.lower() not in catalog.required.get((s, t), ()) else "N", catalog.defaults.get((s, t), {}).get(f.name.lower()))
            for s, t in sorted({*names, *catalog.views})
            for i, f in enumerate(catalog.relation(s, t).schema)
        ]
    if view == "ALL_SYNONYMS":
        return [(x.owner, x.name, x.schema, x.target) for x in catalog.synonyms]
    if view == "ALL_TYPES":
        return [(s, n, "COLLECTION" if hasattr(k, "element") else "OBJECT", getattr(k, "limit", None)) for (s, n), k in sorted(kinds, key=lambda x: x[0])]
    if view == "ALL_CONSTRAINTS":
        return [(s, t, c.name, c.kind, c.condition or None, c.target.upper() if c.target else None) for (s, t), cs in sorted(catalog.constraints.items()) for c in cs]
    if view == "ALL_CONS_COLUMNS":
        return [(s, t, c.name, col.upper(), i + 1) for (s, t), cs in sorted(catalog.constraints.items()) for c in cs for i, col in enumerate(c.columns)]
    if view == "ALL_SEQUENCES":
        return [(s, n, q.start, q.step, q.next) for (s, n), q in sorted(catalog.sequences.items())]
    raise LookupError(f"no dictionary view {view}")


def view(spark: SparkSession, catalog: Catalog, name: str) -> DataFrame:
    return spark.createDataFrame(rows(catalog, name), SCHEMAS[name])


def add_dictionary(spark: SparkSession, catalog: Catalog) -> None:
    """Let queries name the dictionary views; each shows the catalog at the time a query first names it."""
    for name in SCHEMAS:
        catalog.add_loader(name, lambda name=name: view(spark, catalog, name))


def read_dictionary(spark: SparkSession, url: str, name: str, owner: str, user: str, password: str) -> DataFrame:
    """One dictionary view of a database, its rows restricted to an owner by the database itself."""
    if name not in SCHEMAS:
        raise LookupError(f"no dictionary view {name}")
    text = owner.replace("'", "''")
    key = "username" if name == "ALL_USERS" else "sequence_owner" if name == "ALL_SEQUENCES" else "owner"
    options = {"url": url, "query": f"SELECT * FROM {name} WHERE {key} = '{text}'", "user": user, "password": password, "fetchsize": str(FETCH_ROWS)}
    return spark.read.format("jdbc").options(**options).load()
