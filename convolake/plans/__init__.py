"""Query plans: how the driver tables stand in for the platform's tables
(``views``), the DuckDB twins used as correctness oracle (``oracle``) and
the registry of named queries (``catalog``)."""
