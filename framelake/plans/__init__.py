"""Registered queries, by name, and their SQL twins."""

from . import catalogue, exporting, ingestion, maintenance, rasters, reports, searching, streams, values, vectors
from .register import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "catalogue", "exporting", "ingestion", "maintenance", "rasters", "reports", "searching", "streams", "values", "vectors"]
