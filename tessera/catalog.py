"""All registered queries and their SQL, by name."""

from __future__ import annotations

from tessera.plans import relational_queries, rle_queries, similarity_queries, source_queries

QUERIES = relational_queries.QUERIES | rle_queries.QUERIES | similarity_queries.QUERIES | source_queries.QUERIES
ORACLES = relational_queries.ORACLES | rle_queries.ORACLES | similarity_queries.ORACLES | source_queries.ORACLES
