"""Composed queries over the driver tables, each next to its oracle SQL."""
