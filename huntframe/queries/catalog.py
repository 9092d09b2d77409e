"""All registered queries; importing this module fills the registry."""

from huntframe.queries import (  # noqa: F401
    aggregates, detections, jobs, joins, networks, polygons, predicates, scalars, seasons, sequences, sketches, stages, streams,
)
from huntframe.queries.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
