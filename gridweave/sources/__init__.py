"""Grids from and to arrays, Arrow, tables and files."""

from gridweave.sources.arrays import from_arrow, from_numpy, from_table, to_arrow, to_numpy, write_region
from gridweave.sources.tables import from_array_column, from_counts

__all__ = ["from_array_column", "from_arrow", "from_counts", "from_numpy", "from_table", "to_arrow", "to_numpy", "write_region"]
