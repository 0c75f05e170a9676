"""Registered queries: each module registers its own when it is imported."""

from skylattice.plans import evaluation, features, imagery, ingestion, rasters, retrieval, scalars, streams  # noqa: F401
