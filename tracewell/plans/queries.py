"""All registered queries and their SQL: the modules imported here add theirs to the catalogue."""

from . import grid_queries, learned_queries, lineage_queries, stream_queries
from .catalogue import FLAGSHIP, QUERIES, SQL

__all__ = ["FLAGSHIP", "QUERIES", "SQL", "grid_queries", "learned_queries", "lineage_queries", "stream_queries"]
