"""The engine's tables."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _I, _B, _D, _TS = T.StringType(), T.IntegerType(), T.BooleanType(), T.DoubleType(), T.TimestampNTZType()
_STRINGS, _VECTOR = T.ArrayType(_S), T.ArrayType(T.FloatType())


def _table(**cols: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in cols.items()])


EVENTS = _table(id=_S, aggregate_id=_S, event_type=_S, ts=_TS, payload=_S, schema_version=_S)
EMBEDDINGS = _table(node_id=_S, vector=_VECTOR, version=_I, dim=_I)
CAUSAL_RESULTS = _table(id=_S, treatment=_S, outcome=_S, ate=_D, n_samples=T.LongType(), status=_S)
CONSTRAINTS = _table(id=_S, node_id=_S, constraint_type=_S, priority=_I, data=_table(type=_S, depends_on=_STRINGS, priority=_I))
TOMBSTONES = _table(node_id=_S, event_id=_S, deleted_at=_TS, reason=_S)
MEMORIES = _table(id=_S, project=_S, content=_S, tags=_STRINGS, created_at=_TS, updated_at=_TS, forgotten=_B)
MEMORY_VECTORS = _table(memory_id=_S, vector=_VECTOR, dim=_I, project=_S)
MEMORY_VERSIONS = _table(id=_S, memory_id=_S, content=_S, valid_from=_TS, valid_to=_TS)
#: The append-only form of memories and versions: op is create, update or forget.
MEMORY_LOG = _table(op=_S, id=_S, project=_S, content=_S, tags=_STRINGS, ts=_TS)

TABLES = {
    "events": EVENTS, "embeddings": EMBEDDINGS, "causal_results": CAUSAL_RESULTS, "constraints": CONSTRAINTS, "tombstones": TOMBSTONES,
    "memories": MEMORIES, "memory_vectors": MEMORY_VECTORS, "memory_versions": MEMORY_VERSIONS, "memory_log": MEMORY_LOG,
}
#: Columns that tables are laid out by, for partition pruning.
PARTITIONS = {"memories": ["project"], "memory_vectors": ["project"], "memory_log": ["project"]}
