"""Registry of the library's queries: name -> function of (spark, sf_dir), and name -> DuckDB SQL."""

from __future__ import annotations

from siltmark.plans import crdt, documents, formats, history, keyspace, kv, search, swarm, trees

QUERIES, ORACLES = {}, {}
for _module in (kv, keyspace, crdt, history, search, swarm, trees, documents, formats):
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
