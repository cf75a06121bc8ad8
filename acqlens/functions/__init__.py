"""Shared column expressions (exact rounding, month arithmetic, null ordering)."""
