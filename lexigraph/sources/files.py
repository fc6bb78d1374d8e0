"""Source and document files, URL lists, usage logs, code graphs and verdicts as tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import forward_slashes, utrim
from ..operators.code import LANGUAGES, with_language
from ..schema import CODE_GRAPH, USAGE_EVENT

#: Names of folders and files that are not read (fixed values).
IGNORED = ("node_modules", ".git", "dist", "build", ".next", "out", "target", "vendor", "__pycache__", ".venv", ".idea", ".gradle")
IGNORED_DOCS = ("node_modules", ".git", "dist", "build", "target", "vendor", ".next", "out", ".gradle", ".claude")
MOST_BYTES, MOST_DOC_BYTES = 1_000_000, 2_000_000
#: Up to so many changed files are read by their paths.
MOST_NAMED = 10_000


def _allowed(path: Column, names: tuple[str, ...]) -> Column:
    return ~F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(n) for n in names]))


@dataclass(frozen=True)
class Tree:
    """A folder of files that is listed first and read by path: content of files that are not asked for is not opened."""

    spark: SparkSession
    root: str
    ignored: tuple[str, ...] = IGNORED
    most: int = MOST_BYTES
    names: str = "*"

    def _raw(self) -> DataFrame:
        return self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", self.names).load(self.root)

    def _rows(self, raw: DataFrame, *more: Column) -> DataFrame:
        full = F.regexp_replace("path", "^[a-z]+:/+", "/")
        base = "/" + self.root.split(":", 1)[-1].strip("/") + "/"
        rows = raw.where(F.col("length") <= self.most).select(F.replace(full, F.lit(base), F.lit("")).alias("path"), F.unix_millis("modificationTime").alias("mtime"), *more)
        return rows.where(_allowed(F.col("path"), self.ignored))

    def listing(self) -> DataFrame:
        """path, mtime, lang, and where the file lies; no file is opened."""
        return with_language(self._rows(self._raw(), F.col("_metadata.file_path").alias("file_path")))

    def contents(self, listed: DataFrame, named: int = MOST_NAMED) -> DataFrame:
        """listed (rows of the listing) with content.

        Up to `named` files are chosen by their paths when the folder is listed for the read; of more, all that are as
        young as the oldest of them are, and the others of those are left out afterwards.
        """
        few = [r[0] for r in listed.select("file_path").limit(named + 1).collect()]
        if len(few) <= named:
            raw = self._raw().where(F.col("_metadata.file_path").isin(few))
        else:
            oldest = listed.agg(F.min("mtime")).first()[0]
            raw = self._raw().where(F.col("_metadata.file_modification_time") >= F.timestamp_millis(F.lit(oldest)))
        rows = self._rows(raw, F.col("content").cast("string").alias("content"))
        return listed.select("path", "mtime", "lang").join(rows.select("path", "content"), "path")


def source_tree(spark: SparkSession, root: str) -> Tree:
    """Source files of known languages up to a size; other names are not listed."""
    return Tree(spark, root, IGNORED, MOST_BYTES, "*{" + ",".join(LANGUAGES) + "}")


def source_files(spark: SparkSession, root: str) -> DataFrame:
    """path, mtime, content, lang of source files of known languages up to a size."""
    tree = source_tree(spark, root)
    return with_language(tree._rows(tree._raw(), F.col("content").cast("string").alias("content"))).where("lang is not null")


def document_files(spark: SparkSession, root: str) -> DataFrame:
    """ref, name, content of Markdown files."""
    tree = Tree(spark, root, IGNORED_DOCS, MOST_DOC_BYTES, "*.{[mM][dD],[mM][aA][rR][kK][dD][oO][wW][nN],[mM][dD][xX]}")
    rows = tree._rows(tree._raw(), F.col("content").cast("string").alias("content"))
    return rows.select(F.col("path").alias("ref"), F.substring_index("path", "/", -1).alias("name"), "content")


def url_list(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Distinct URLs of one or several files with one a line; # begins a comment line."""
    return spark.read.text(path).select(utrim("value").alias("url")).where("url <> '' and not startswith(url, '#')").distinct()


def usage_log(spark: SparkSession, path: str) -> DataFrame:
    """The usage log's events; lines that do not parse are dropped."""
    return spark.read.schema(USAGE_EVENT).option("mode", "DROPMALFORMED").json(path).where("ts is not null and tool is not null")


def append_usage(events: DataFrame, path: str) -> None:
    events.select(*USAGE_EVENT.fieldNames()).write.mode("append").json(path)


def code_graph_export(spark: SparkSession, path: str) -> DataFrame:
    """Nested code-graph exports, one JSON document a file; unknown keys are passed over."""
    return spark.read.schema(CODE_GRAPH).option("multiLine", "true").json(path)


def symbol_index(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """files, symbols and modules of an external symbol index that was exported as Parquet; modules may be absent."""
    from pyspark.errors import AnalysisException

    files, symbols = spark.read.parquet(f"{root}/files"), spark.read.parquet(f"{root}/symbols")
    try:
        modules = spark.read.parquet(f"{root}/modules")
    except AnalysisException:
        modules = spark.createDataFrame([], "name string, path string")
    return files.withColumn("path", forward_slashes("path")), symbols, modules
