"""Column functions of the catalogue."""
