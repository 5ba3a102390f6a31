"""Queries over the driver's tables; each module registers its own."""

from . import drifting, encoding, evaluating, featuring, learning, preparing, profiling, resampling, scaling, series, sourcing  # noqa: F401
