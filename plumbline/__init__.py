"""plumbline: search-style querying and corpus processing expressed as Spark plans."""

__version__ = "0.1.0"

from .errors import QueryError

__all__ = ["QueryError"]
