"""Named end-to-end queries with their reference SQL."""

from . import documents, market, portfolio, records, sources, streams, tags, trips  # noqa: F401
from .registry import catalog

__all__ = ["catalog"]
