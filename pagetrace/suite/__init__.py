"""Registered queries with their oracle SQL, grouped by subject."""
