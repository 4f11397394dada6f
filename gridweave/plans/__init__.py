"""Queries over the planning scene."""
