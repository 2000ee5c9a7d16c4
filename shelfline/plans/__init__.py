"""Named queries over the star-schema tables, each with its SQL counterpart where SQL can say it."""

from .registry import ORACLES, QUERIES, load_all

__all__ = ["ORACLES", "QUERIES", "load_all"]
