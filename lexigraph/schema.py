"""The five tables of a knowledge graph, the verdict and usage tables, and their domains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, LongType, MapType, StringType, StructField, StructType

_TYPES = {"string": StringType(), "int": IntegerType(), "long": LongType(), "double": DoubleType(), "boolean": BooleanType(), "array<string>": ArrayType(StringType()), "map<string,string>": MapType(StringType(), StringType())}


def _struct(spec: str) -> StructType:
    """A schema from "name type, ..." (made without a session)."""
    parts = [p.split(" ") for p in spec.split(", ")]
    return StructType([StructField(p[0], _TYPES[p[1]], "not" not in p) for p in parts])


CONCEPT = _struct("id string not null, name string not null, definition string, bounded_context string, aliases array<string>, status string not null")
ARTIFACT = _struct("id string not null, kind string not null, layer string not null, source string not null, ref string not null, title string, body string, attrs map<string,string>")
MENTION = _struct("id string not null, artifact_id string not null, term string not null, normalized string not null, span int")
EDGE = _struct("id string not null, src_id string not null, dst_id string not null, type string not null, source string not null, confidence double not null, evidence array<string>, status string not null")
SOURCE_FILE = _struct("path string not null, mtime long not null")
#: Files that a reader other than the one of symbols has read.
READ_FILE = _struct("reader string not null, path string not null, mtime long not null")
USAGE_EVENT = _struct("ts long not null, tool string not null, q string, hit boolean, chars int, ms long")
VERDICT_CONCEPT = _struct("cluster string not null, keep boolean, name string, definition string, bounded_context string, aliases array<string>, confidence double")
VERDICT_RULE = _struct("id int not null, keep boolean, refined string")
#: Nested code-graph exports, as DDL.
CODE_GRAPH = (
    "repo string, source string, "
    "communities array<struct<label:string, members:array<struct<kind:string, name:string, file:string>>>>, "
    "calls array<struct<`from`:string, `to`:string>>"
)

LAYERS = ("code", "design", "product", "evidence", "config")
ARTIFACT_KINDS = ("code_symbol", "file", "frame", "component", "issue", "pr", "commit", "feature", "doc", "rule", "config")
EDGE_TYPES = ("implements", "describes", "depicts", "constrains", "changed", "references", "belongs_to", "relates", "calls", "imports")
EDGE_SOURCES = ("deterministic", "inferred", "human")
EDGE_STATUSES = ("proposed", "confirmed", "rejected")
CONCEPT_STATUSES = ("candidate", "confirmed")
#: What an unknown value reads back as.
DEFAULTS = {"kind": "file", "layer": "code", "concept_status": "candidate"}


def known_or_default(column: Column, domain: tuple[str, ...], default: str) -> Column:
    return F.when(column.isin(*domain), column).otherwise(F.lit(default))


def key(*parts) -> Column:
    """A deterministic id from a natural key; nulls and empty strings differ."""
    own = [F.coalesce(F.concat(F.lit("="), (F.col(p) if isinstance(p, str) else p).cast("string")), F.lit("~")) for p in parts]
    return F.sha2(F.concat_ws("\x01", *own), 256)


def conform(df: DataFrame, schema: StructType) -> DataFrame:
    """df with the schema's columns, absent ones as null, in its order and types."""
    return df.select(*(F.col(f.name).cast(f.dataType).alias(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields))
