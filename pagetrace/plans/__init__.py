"""Composed dataflows built from the operators."""
