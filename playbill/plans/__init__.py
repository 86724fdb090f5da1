"""Named queries over the driver tables, each with its SQL oracle."""

from playbill.plans import (  # noqa: F401
    catalogue,
    cleaning,
    crawled,
    documents,
    failures,
    flows,
    landing,
    streams,
)
from playbill.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
