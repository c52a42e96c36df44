"""Registration of queries beside the SQL that DuckDB must answer alike."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

#: The newest state of every ticket id, in DuckDB.
NEWEST_SQL = """t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY import_id DESC, derniere_modification DESC NULLS LAST,
 date_resolution DESC NULLS LAST, nombre_suivis DESC NULLS LAST, statut DESC NULLS LAST) AS rn FROM tickets) WHERE rn = 1)"""


class Registre:
    """Queries and oracles of a module."""

    def __init__(self):
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def __call__(self, sql: str | None = None, name: str | None = None, newest: bool = True) -> Callable[[Query], Query]:
        def add(f: Query) -> Query:
            key = name or f.__name__
            self.queries[key] = f
            if sql is not None:
                if newest:
                    rest = sql.strip()
                    self.oracles[key] = f"WITH RECURSIVE {NEWEST_SQL}" + (", " + rest[5:] if rest[:5].upper() == "WITH " else " " + rest)
                else:
                    self.oracles[key] = sql
            return f

        return add
