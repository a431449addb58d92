"""Queries of the reference's operators; importing this package registers all of them."""

from . import audits, counting, files, genome, graphs, labels, models, spine, starting, summary  # noqa: F401
from .registry import QUERIES, SQL  # noqa: F401
