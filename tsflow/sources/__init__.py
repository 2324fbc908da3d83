"""Readers with declared schemas, the result sink, and fixtures derived from the driver tables."""

from tsflow.sources.readers import read_table, read_points, read_cycles, write_result  # noqa: F401
from tsflow.sources import fixtures  # noqa: F401
