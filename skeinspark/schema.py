"""Shape of a graph snapshot: columns, their defaults and the closed vocabularies."""

from __future__ import annotations

from pyspark.sql import types as T

#: Core columns of a node and what an absent one holds.
NODE_DEFAULTS: dict[str, tuple[T.DataType, object]] = {
    "type": (T.StringType(), None), "id": (T.StringType(), None), "label": (T.StringType(), None), "text": (T.StringType(), None), "canonical_key": (T.StringType(), None),
    "activation": (T.DoubleType(), 0.0), "base_activation": (T.DoubleType(), 0.0), "salience": (T.DoubleType(), 0.0), "confidence": (T.DoubleType(), 1.0),
    "stability": (T.DoubleType(), 0.5), "volatility": (T.DoubleType(), 0.5), "utility": (T.DoubleType(), 0.0),
    "created_at": (T.StringType(), None), "updated_at": (T.StringType(), None), "last_activated_at": (T.StringType(), None), "last_used_at": (T.StringType(), None),
    "usage_count": (T.LongType(), 0), "evidence_count": (T.LongType(), 0), "status": (T.StringType(), "active"),
}
EDGE_DEFAULTS: dict[str, tuple[T.DataType, object]] = {
    "from_id": (T.StringType(), None), "to_id": (T.StringType(), None), "type": (T.StringType(), None), "id": (T.StringType(), None),
    "weight": (T.DoubleType(), 1.0), "confidence": (T.DoubleType(), 1.0), "polarity": (T.IntegerType(), 1), "origin": (T.StringType(), "deterministic"),
    "co_activation_count": (T.LongType(), 0), "last_fired_at": (T.StringType(), None), "created_at": (T.StringType(), None), "updated_at": (T.StringType(), None),
}

#: Statuses that count as live, and those that don't.
ACTIVE = ("candidate", "latent", "active", "reinforced", "mature", "promoted", "confirmed")
INACTIVE = ("archived", "deleted", "rejected", "dismissed")
#: Node types that keep the books of a graph, and edge types that analytics write.
BOOKKEEPING = ("Community", "CompilationRun", "GraphDelta", "ArtifactCacheEntry", "RetrievalTrace")
ANALYTIC_EDGES = ("BELONGS_TO_COMMUNITY", "BRIDGES_COMMUNITY")
EPOCH = "2024-01-01T00:00:00+00:00"
