"""The queries of this subpackage, by name, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from folioforge.llm import chunkdedup, jaccardjoin, neardedup, neighbours, packing, pieces, quality, sharding, suffixdedup, toxicity

QUERIES: dict = {}
ORACLE: dict = {}
for _part in (packing, chunkdedup, jaccardjoin, toxicity, suffixdedup, neighbours, sharding, pieces, quality, neardedup):
    QUERIES |= _part.QUERIES
    ORACLE |= _part.ORACLE
