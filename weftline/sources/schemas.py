"""Column types of raw records and canonical tables.

Unsigned 64-bit counters are read as ``decimal(20,0)``; dense ids and counts
become ``bigint`` at once, hash ids stay decimals.
"""

from __future__ import annotations

from pyspark.sql import types as T


_KINDS = {"string": T.StringType(), "boolean": T.BooleanType(), "int": T.IntegerType(), "bigint": T.LongType(), "double": T.DoubleType(), "decimal(20,0)": T.DecimalType(20, 0), "decimal(38,0)": T.DecimalType(38, 0)}


def _struct(spec: str) -> T.StructType:
    """Columns from ``name kind, ...``; no session is needed."""
    return T.StructType([T.StructField(name, _KINDS[kind]) for name, kind in (part.split() for part in spec.split(", "))])


RAW_RECORD = _struct(
    "record string, snapshot string, name string, module string, kind string, has_value boolean, "
    "type_expr_nodes decimal(20,0), value_expr_nodes decimal(20,0), type_const_unique bigint, value_const_unique bigint, "
    "source_start_line bigint, source_start_column bigint, source_end_line bigint, source_end_column bigint, "
    "src string, dst string, edge_type string, multiplicity decimal(20,0), status string, decl_count bigint, edge_count bigint, "
    "warning_count bigint, error string, duration_seconds double, return_code int, parse_error_count bigint"
)

COMPLEXITY_RECORD = _struct(
    "record string, snapshot string, name string, module string, has_value boolean, "
    "type_expr_tree_occurrences decimal(38,0), type_expr_unique_ptr_nodes bigint, type_expr_dag_arcs bigint, type_expr_max_depth bigint, "
    "value_expr_tree_occurrences decimal(38,0), value_expr_unique_ptr_nodes bigint, value_expr_dag_arcs bigint, value_expr_max_depth bigint"
)

USAGE_KEY = ["snapshot_id", "module", "parent_decl", "target_module", "target_decl", "start_line", "start_character", "end_line", "end_character"]
USAGE = _struct(
    "snapshot_id string, module string, parent_decl string, target_module string, target_decl string, "
    "start_line bigint, start_character bigint, end_line bigint, end_character bigint"
)

EDGE = _struct("snapshot_id string, src_id bigint, dst_id bigint, edge_type string, multiplicity bigint")
CORE_NODE = _struct("graph_id string, node_id decimal(20,0), native_id string, label string, node_type string, domain string, is_generated boolean, size_source bigint, size_semantic bigint")
CORE_LINK = _struct("graph_id string, src_id decimal(20,0), dst_id decimal(20,0), relation string, multiplicity bigint")

RAW_CALL = _struct(
    "caller_module string, caller_class string, caller_name string, caller_descriptor string, instruction_ordinal bigint, "
    "invoke_kind string, declared_owner string, declared_name string, declared_descriptor string, source_line string, "
    "bootstrap_owner string, bootstrap_name string, resolution_hint string"
)
RAW_CLASS = _struct("module_name string, class_name string, super_name string, interfaces string")
