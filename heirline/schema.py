"""Table layouts and the fixed values every operator shares."""

from __future__ import annotations

from pyspark.sql import types as T

# Fixed values of the data model: artifact types, defaults, risk bounds, ranking
# of types in impact reports, and diffusion defaults.
ARTIFACT_TYPES = ("dataset", "model", "tool", "product")
DEFAULT_CREATOR = "unknown"
DEFAULT_WEIGHT = 0.9
RISK_LEVELS = (("CRITICAL", 0.75), ("HIGH", 0.50), ("MEDIUM", 0.25), ("LOW", 0.0))
SAFE_LEVEL = "SAFE"
TYPE_RANK = {"product": 0, "model": 1, "tool": 2, "dataset": 3}
OTHER_RANK = 9
DIFFUSION_DAMPING = 0.85
DIFFUSION_ROUNDS = 15
DIFFUSION_TOLERANCE = 1e-6
REPORT_IMPACTED = 20
REPORT_ANCESTORS = 10
TOP_RISKS = 5

NODES = T.StructType(
    [
        T.StructField("node_id", T.StringType(), False),
        T.StructField("node_type", T.StringType(), False),
        T.StructField("content", T.MapType(T.StringType(), T.StringType())),
        T.StructField("creator", T.StringType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("seq", T.LongType()),
    ]
)

EDGES = T.StructType(
    [
        T.StructField("src", T.StringType(), False),
        T.StructField("dst", T.StringType(), False),
        T.StructField("weight", T.DoubleType()),
        T.StructField("seq", T.LongType()),
    ]
)

EDITS = T.StructType(
    [
        T.StructField("node_id", T.StringType(), False),
        T.StructField("key", T.StringType(), False),
        T.StructField("value", T.StringType()),
        T.StructField("seq", T.LongType()),
    ]
)
