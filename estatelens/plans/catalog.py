"""All registered queries; importing the modules fills the registry."""

from . import (  # noqa: F401
    aggregate_queries,
    filter_queries,
    join_queries,
    model_queries,
    scalar_queries,
    source_queries,
    spatial_queries,
)
from .registry import CHECKS, QUERIES  # noqa: F401
