"""Reusable DataFrame steps: selection, keyed picks, upserts, rankings."""
