"""Import every module that registers queries."""

from archgraph.plans import corrections, documents, extraction, graphs, resolution, scalars, scans, streams  # noqa: F401
from archgraph.plans.registry import ORACLES, QUERIES  # noqa: F401
