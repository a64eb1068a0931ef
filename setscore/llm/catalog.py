"""Registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from setscore.llm import contamination, graph_search, langid, licenses, line_quality, merkle, mixing, pii, prefix_trie, secrets, sharding, simhash, warc

_MODULES = (contamination, langid, licenses, line_quality, mixing, pii, secrets, sharding, simhash, warc, graph_search, merkle, prefix_trie)

QUERIES = {name: fn for m in _MODULES for name, fn in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in _MODULES for name, sql in getattr(m, "ORACLE_SQL", {}).items()}
