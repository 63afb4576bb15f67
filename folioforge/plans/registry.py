"""All queries over the driver's tables, each with its DuckDB SQL where there is one."""

from __future__ import annotations

from folioforge.plans import layouts, ledger, papers, readers, records, scalars, texts, verification

QUERIES: dict = {}
ORACLE: dict = {}
for _part in (ledger, scalars, papers, records, verification, texts, layouts, readers):
    QUERIES |= _part.QUERIES
    ORACLE |= _part.ORACLE
