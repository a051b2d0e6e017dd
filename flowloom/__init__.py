"""flowloom: packet tables to flows, flow features, labelled datasets and scores on Spark."""

from flowloom.profiles import (
    BUILD_STATS,
    PROCESSOR_DIRECTIONS,
    PROCESSOR_IMAGES,
    PROCESSOR_LENGTHS,
    PROCESSOR_STATS,
    UNIFIED,
    FlowProfile,
)
from flowloom.session import configure, staged

__all__ = [
    "BUILD_STATS",
    "PROCESSOR_DIRECTIONS",
    "PROCESSOR_IMAGES",
    "PROCESSOR_LENGTHS",
    "PROCESSOR_STATS",
    "UNIFIED",
    "FlowProfile",
    "configure",
    "staged",
]
