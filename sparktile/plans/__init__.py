from .catalog import ORACLES, QUERIES
from . import annotation_queries, job_queries, metric_queries, run_queries, tile_queries, transform_queries  # noqa: F401

__all__ = ["QUERIES", "ORACLES"]
