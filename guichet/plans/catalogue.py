"""All core queries by name, and the SQL they are held against."""

from __future__ import annotations

from guichet.plans import donnees, donnees_sql, flux, fouille, imports, stock, textes

QUERIES = dict(donnees.QUERIES)
ORACLES: dict[str, str] = dict(donnees_sql.ORACLES)
for _module in (stock, imports, flux, fouille, textes):
    QUERIES |= _module.query.queries
    ORACLES |= _module.query.oracles
