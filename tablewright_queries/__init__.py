"""The registered queries, by subject."""

from tablewright_queries import charts, cleaning, files, functions, profiles, relations, streams, tables
from tablewright_queries.registry import REGISTRY

__all__ = ["REGISTRY", "charts", "cleaning", "files", "functions", "profiles", "relations", "streams", "tables"]
