"""Joins, roll-ups and ordered operators over scene tables."""
