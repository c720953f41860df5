"""All registered queries."""

from assay.plans import (  # noqa: F401
    q_grids,
    q_groups,
    q_joins,
    q_metrics,
    q_models,
    q_prompts,
    q_quality,
    q_sampling,
    q_scalars,
    q_scans,
    q_streams,
)
from assay.plans.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
