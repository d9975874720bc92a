"""Fit/apply operators. ``fit`` runs one aggregate for all columns; ``apply`` adds columns by expressions and lookup joins."""
