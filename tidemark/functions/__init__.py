"""Cursor values and column expressions."""
