"""DuckDB oracle SQL for the driver's correctness gate (not used by the operators)."""
