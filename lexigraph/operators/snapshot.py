"""A graph as numbered versions over shared Parquet files: a write adds what changed, readers always find a version.

A table is a base, in buckets by the hash of its key, and deltas over it. A delta holds, for the keys it
speaks of, all their rows, or that they are gone; the last delta that speaks of a key counts. So a version that
touches few keys writes about as much, whatever the size of the table. A small table is written whole. When a table's deltas outgrow a share of
its base, or are many, the buckets they touch are written anew; other buckets stay where they are. No file is
ever replaced: a version is a manifest of files, published under the next number or refused if that is taken
(`Moved`), in which case the work is done again on the newer version (`update`).

A graph knows the version it was read from and, for each table replaced since, the keys that may differ where
the caller knows them (`with_changes`); otherwise they are found by comparing digests of the rows by key.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from . import manifest as M
from .scratch import stored

TABLES = {"concepts": S.CONCEPT, "artifacts": S.ARTIFACT, "mentions": S.MENTION, "edges": S.EDGE, "files": S.SOURCE_FILE, "reads": S.READ_FILE}
KEYS = {"concepts": ["id"], "artifacts": ["id"], "mentions": ["id"], "edges": ["src_id", "dst_id", "type"], "files": ["path"], "reads": ["reader", "path"]}
SCHEMA_VERSION = 4
#: Buckets of a new root, the share of a base's bytes that its deltas may have, and how many there may be.
BUCKETS, SHARE, MOST_DELTAS = 16, 0.25, 16
#: A changed table whose base is smaller than this many bytes is written whole.
LEAST_BYTES = 4 << 20


class Moved(Exception):
    """Another version was published after the one this graph was read from."""


@dataclass(frozen=True)
class Graph:
    concepts: DataFrame
    artifacts: DataFrame
    mentions: DataFrame
    edges: DataFrame
    files: DataFrame
    reads: DataFrame
    version: int | None = None
    #: Tables replaced since that version, with the keys that may differ, or None where they are not known.
    changes: Mapping[str, DataFrame | None] = field(default_factory=dict)

    def with_tables(self, **tables: DataFrame) -> Graph:
        """The graph with these tables, of which it is not known what changed."""
        return replace(self, **tables, changes={**self.changes, **dict.fromkeys(tables)})

    def with_changes(self, name: str, table: DataFrame, keys: DataFrame) -> Graph:
        """The graph with a table that differs at most at these keys (more columns are not looked at)."""
        keys = keys.select(*KEYS[name])
        before = self.changes.get(name, False)
        known = keys if before is False else None if before is None else before.union(keys)
        return replace(self, **{name: table}, changes={**self.changes, name: known})


def empty(spark: SparkSession) -> Graph:
    return Graph(**{name: spark.createDataFrame([], s) for name, s in TABLES.items()})


def _bucket(name: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(*KEYS[name]), F.lit(buckets)).cast("int")


def _write_base(df: DataFrame, name: str, path: str, buckets: int) -> None:
    """Rows by bucket, edges by type within it."""
    by = ["_bucket", "type"] if name == "edges" else ["_bucket"]
    df.withColumn("_bucket", _bucket(name, buckets)).repartition("_bucket").write.partitionBy(*by).parquet(path)


def _made(spark: SparkSession, root: str, name: str, folder: str) -> dict:
    """The entry of a base that one write made: the buckets that have rows."""
    buckets = [n.split("=", 1)[1] for n in M.names_in(spark, f"{root}/data/{name}/{folder}") if n.startswith("_bucket=")]
    return {"buckets": dict.fromkeys(buckets, folder), "deltas": []}


def _base(spark: SparkSession, root: str, name: str, entry: dict) -> DataFrame:
    paths = [f"{root}/data/{name}/{folder}/_bucket={b}" for b, folder in entry["buckets"].items()]
    reader = spark.read.schema(TABLES[name]).option("basePath", f"{root}/data/{name}")
    return S.conform(reader.parquet(*paths), TABLES[name]) if paths else spark.createDataFrame([], TABLES[name])


def _deltas(spark: SparkSession, root: str, name: str, entry: dict) -> tuple[DataFrame, DataFrame]:
    """The keys that deltas speak of, each with the last that does, and the rows of those."""
    every = None
    schema = spark.createDataFrame([], TABLES[name]).withColumn("_gone", F.lit(False)).schema
    for i, folder in enumerate(entry["deltas"]):
        one = spark.read.schema(schema).parquet(f"{root}/data/{name}/{folder}").withColumn("_at", F.lit(i))
        every = one if every is None else every.unionByName(one)
    last = every.groupBy(*KEYS[name]).agg(F.max("_at").alias("_at"))
    rows = every.where("not _gone")
    return last, (rows.join(last, [*KEYS[name], "_at"], "left_semi") if len(entry["deltas"]) > 1 else rows)


def _table(spark: SparkSession, root: str, name: str, entry: dict) -> DataFrame:
    """A table of a version. Its base is not shuffled where the deltas' keys are few enough to be broadcast."""
    base = _base(spark, root, name, entry)
    if not entry["deltas"]:
        return base
    last, rows = _deltas(spark, root, name, entry)
    return base.join(last.select(*KEYS[name]), KEYS[name], "left_anti").unionByName(S.conform(rows, TABLES[name])).select(*base.columns)


def _digests(df: DataFrame, name: str) -> DataFrame:
    """The number and the sum of hashes of the rows of each key."""
    maps = {f.name for f in TABLES[name].fields if f.dataType.typeName() == "map"}
    rest = [F.array_sort(F.map_entries(c)) if c in maps else F.col(c) for c in df.columns if c not in KEYS[name]]
    return df.groupBy(*KEYS[name]).agg(F.count("*").alias("n"), F.sum(F.xxhash64(*rest).cast("decimal(38,0)") if rest else F.lit(0)).alias("digest"))


def _changed_keys(new: DataFrame, old: DataFrame, name: str) -> DataFrame:
    a, b = _digests(new, name), _digests(old, name).withColumnsRenamed({"n": "old_n", "digest": "old_digest"})
    return a.join(b, KEYS[name], "full").where(~(F.col("n").eqNullSafe(F.col("old_n")) & F.col("digest").eqNullSafe(F.col("old_digest")))).select(*KEYS[name])


def _write_delta(new: DataFrame, keys: DataFrame, name: str, path: str) -> None:
    """The rows of the keys as they are now; a key without a row is gone."""
    keys = stored(keys.distinct(), f"keys-{name}")
    rows = new.join(keys, KEYS[name], "left_semi").withColumn("_gone", F.lit(False))
    held = keys.join(rows, KEYS[name], "left")
    held.select(*new.columns, F.coalesce("_gone", F.lit(True)).alias("_gone")).write.parquet(path)


def _rebased(spark: SparkSession, root: str, name: str, entry: dict, folder: str, buckets: int) -> dict:
    """The table with the buckets that its deltas touch written anew, without deltas."""
    last, _ = _deltas(spark, root, name, entry)
    touched = [r[0] for r in last.select(_bucket(name, buckets).alias("b")).distinct().collect()]  # at most as many as buckets
    part = {**entry, "buckets": {b: f for b, f in entry["buckets"].items() if int(b) in touched}}
    _write_base(_table(spark, root, name, part), name, f"{root}/data/{name}/{folder}", buckets)
    kept = {b: f for b, f in entry["buckets"].items() if int(b) not in touched}
    return {"buckets": kept | _made(spark, root, name, folder)["buckets"], "deltas": []}


def _bytes(spark: SparkSession, root: str, name: str, entry: dict) -> tuple[int, int]:
    size = lambda f: M.bytes_in(spark, f"{root}/data/{name}/{f}")
    return sum(size(f"{f}/_bucket={b}") for b, f in entry["buckets"].items()), sum(map(size, entry["deltas"]))


def _versions(spark: SparkSession, root: str) -> list[int]:
    return [int(n[:-5]) for n in M.names_in(spark, f"{root}/versions") if n.endswith(".json") and not n.startswith(".")]


def _manifest(root: str, version: int) -> str:
    return f"{root}/versions/{version:010d}.json"


def write(graph: Graph, root: str, buckets: int = BUCKETS, share: float = SHARE, most_deltas: int = MOST_DELTAS, least: int = LEAST_BYTES) -> int:
    """Publishes the graph as the next version and gives its number; tables that did not change are not touched.

    Raises Moved, and publishes nothing, if the graph was not read from the last version of this root.
    """
    spark = graph.edges.sparkSession
    at = max(_versions(spark, root), default=None)
    if graph.version != at:
        raise Moved(f"the graph is of version {graph.version}, the last one is {at}")
    head = M.load(spark, _manifest(root, at)) if at is not None else {"buckets": buckets, "tables": {}}
    buckets, tables = head["buckets"], {}
    folder = f"_at={(at or 0) + 1:010d}-{uuid.uuid4().hex[:12]}"
    for name, s in TABLES.items():
        entry = head["tables"].get(name)
        if entry is not None and name not in graph.changes:
            tables[name] = entry
            continue
        new, path = S.conform(getattr(graph, name), s), f"{root}/data/{name}/{folder}"
        if entry is None or _bytes(spark, root, name, entry)[0] < least:
            _write_base(new, name, path, buckets)
            tables[name] = _made(spark, root, name, folder)
            continue
        keys = graph.changes[name]
        _write_delta(new, _changed_keys(new, _table(spark, root, name, entry), name) if keys is None else keys, name, path)
        entry = {**entry, "deltas": [*entry["deltas"], folder]}
        base, deltas = _bytes(spark, root, name, entry)
        due = deltas > share * base or len(entry["deltas"]) > most_deltas
        tables[name] = _rebased(spark, root, name, entry, f"{folder}-base", buckets) if due else entry
    content = {"version": (at or 0) + 1, "schema": SCHEMA_VERSION, "buckets": buckets, "tables": tables}
    if not M.publish(spark, _manifest(root, content["version"]), content):
        raise Moved(f"version {content['version']} was published meanwhile")
    return content["version"]


def _known(graph: Graph) -> Graph:
    """The graph with values outside the domains read as their defaults."""
    known = lambda c, domain, name: S.known_or_default(F.col(c), domain, S.DEFAULTS[name]).alias(c)
    artifacts = graph.artifacts.withColumns({"kind": known("kind", S.ARTIFACT_KINDS, "kind"), "layer": known("layer", S.LAYERS, "layer")})
    return replace(graph, artifacts=artifacts, concepts=graph.concepts.withColumn("status", known("status", S.CONCEPT_STATUSES, "concept_status")))


def read(spark: SparkSession, root: str, version: int | None = None) -> Graph:
    """The last version under a root, or an older one; FileNotFoundError where there is none."""
    version = max(_versions(spark, root), default=None) if version is None else version
    if version is None:
        raise FileNotFoundError(f"no version of a graph in {root}")
    tables = M.load(spark, _manifest(root, version))["tables"]
    none = {"buckets": {}, "deltas": []}  # a table that the version's schema did not have
    return _known(Graph(**{name: _table(spark, root, name, tables.get(name, none)) for name in TABLES}, version=version))


def update(spark: SparkSession, root: str, change: Callable[[Graph], Graph], tries: int = 10) -> Graph:
    """The graph under root after a change to its last version, made again where another writer was first."""
    for _ in range(tries):
        graph = read(spark, root) if _versions(spark, root) else empty(spark)
        try:
            return read(spark, root, write(change(graph), root))
        except Moved:
            continue
    raise Moved(f"another writer was first {tries} times")


def expire(spark: SparkSession, root: str, keep: int = 2) -> None:
    """Removes all but the last `keep` versions and the files that none of those has; run it while nobody writes."""
    versions = sorted(_versions(spark, root))
    held = [M.load(spark, _manifest(root, v))["tables"] for v in versions[-keep:]]
    for name in TABLES:
        entries = [t[name] for t in held if name in t]
        folders = {f for e in entries for f in [*e["buckets"].values(), *e["deltas"]]}
        used = {(b, f) for e in entries for b, f in e["buckets"].items()}
        for folder in M.names_in(spark, f"{root}/data/{name}"):
            if folder not in folders:
                M.remove(spark, f"{root}/data/{name}/{folder}")
                continue
            for bucket in M.names_in(spark, f"{root}/data/{name}/{folder}"):
                if bucket.startswith("_bucket=") and (bucket.split("=", 1)[1], folder) not in used:
                    M.remove(spark, f"{root}/data/{name}/{folder}/{bucket}")
    for v in versions[:-keep]:
        M.remove(spark, _manifest(root, v))
