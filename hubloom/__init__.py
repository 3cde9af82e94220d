"""Demand planning and hub placement as Spark DataFrame jobs."""

from hubloom.config import NetworkConfig, RETAIL_NETWORK, STAR_NETWORK
from hubloom.plans.planning import Planning

__all__ = ["NetworkConfig", "Planning", "RETAIL_NETWORK", "STAR_NETWORK"]
