"""End-to-end analyses composed from the operators, plus the registry of
named queries and their DuckDB oracle SQL."""
