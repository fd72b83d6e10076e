"""Every operator as a query over the given tables."""

from pressmill.workload import cleaning, enrich, ingest, live, outputs, tracking
from pressmill.workload.base import REGISTERED

__all__ = ["REGISTERED", "cleaning", "enrich", "ingest", "live", "outputs", "tracking"]
