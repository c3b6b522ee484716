"""Query registry: each entry is one operator from the blueprint run over the
driver tables (``queries``) plus, where SQL can express it, an independent
DuckDB formulation (``oracles``) used as the correctness gate."""
