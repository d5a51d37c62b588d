"""A model over the tables of the Spark session catalog.

The reference discovers personal data through the warehouse's
INFORMATION_SCHEMA.  Here the session catalog plays that role: every table of
the chosen databases becomes part of a model that discovery, erasure and the
reports accept.  Only metadata (table and column names) is listed on the
driver; the data stays in the tables.

Name mapping: a Spark catalog is the reference's database, a Spark database
its schema, so a table is addressed as ``<database>.<table>``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


class CatalogModel:
    """``names()`` / ``location()`` / ``model[name]`` over catalog tables."""

    def __init__(self, spark: SparkSession, databases: list[str], catalog: str | None = None):
        self.spark = spark
        self.catalog = catalog or spark.catalog.currentCatalog()
        self._names: list[str] = []
        for db in databases:
            for t in spark.catalog.listTables(db):
                if t.tableType in ("MANAGED", "EXTERNAL") or not t.isTemporary:
                    self._names.append(f"{db}.{t.name}")

    def names(self) -> list[str]:
        return list(self._names)

    def location(self, name: str) -> tuple[str, str]:
        db = name.split(".")[0]
        return self.catalog.upper(), db.upper()

    @staticmethod
    def label(name: str) -> str:
        """Table name as reported (the catalog's upper-case form)."""
        return name.split(".")[-1].upper()

    def __getitem__(self, name: str) -> DataFrame:
        return self.spark.table(name)

    def scope(self) -> list[str]:
        """The (catalog) database names this model covers, for the
        ``databases`` argument of discovery and erasure."""
        return sorted({self.location(n)[0] for n in self._names})
