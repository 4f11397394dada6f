"""Scene tables and the reference dimensions."""
