"""Registry of the queries and their DuckDB SQL."""

from recordloom.plans import business, more, people, scalars, sources, wholetables

QUERIES: dict = {}
SQL: dict = {}
for module in (scalars, wholetables, business, people, sources, more):
    QUERIES |= module.QUERIES
    SQL |= module.SQL
