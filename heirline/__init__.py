"""Lineage, integrity and risk analytics on a catalog of artifacts, as Spark jobs."""

from heirline.graph import LineageGraph
from heirline.plans.scratch import Scratch
from heirline.sources.ingest import InvalidCatalog

__all__ = ["InvalidCatalog", "LineageGraph", "Scratch"]
