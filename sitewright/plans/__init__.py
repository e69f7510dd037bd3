"""Queries over the fixture tables, by area; importing this registers them."""

from . import grids, live, more, sites, stores, streams
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "grids", "live", "more", "sites", "stores", "streams"]
