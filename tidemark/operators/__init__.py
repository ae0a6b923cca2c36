"""Operators over long tables keyed by (symbol, date) or (run_id, date)."""
