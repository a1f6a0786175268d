from heirline.sources.catalog import catalog_edges, catalog_nodes, catalog_seeds, part_blocks
from heirline.sources.demo import demo_catalog
from heirline.sources.ingest import (
    InvalidCatalog,
    apply_edits,
    clean_edges,
    clean_nodes,
    clean_seeds,
    invalid_edges,
    invalid_nodes,
    missing_seeds,
    problems,
)
from heirline.sources.synthetic import synthetic_dag

__all__ = [
    "InvalidCatalog",
    "apply_edits",
    "catalog_edges",
    "catalog_nodes",
    "catalog_seeds",
    "clean_edges",
    "clean_nodes",
    "clean_seeds",
    "demo_catalog",
    "invalid_edges",
    "invalid_nodes",
    "missing_seeds",
    "part_blocks",
    "problems",
    "synthetic_dag",
]
