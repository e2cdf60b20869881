"""Named queries over the benchmark tables, each with an equivalent SQL text where one exists."""

from geostrata.queries import (  # noqa: F401  (importing registers the queries)
    cleaning,
    evaluation,
    inference,
    mapping,
    models,
    panels,
    profiling,
    quality,
    sources,
    spatial,
)
from geostrata.queries.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
