"""Code ingest: resolved code graphs, symbol indexes, and approximate symbols and mentions of source text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..schema import key
from .scopes import declarations, tokens

#: Languages by file extension, case counts (fixed values).
LANGUAGES = {
    ".ts": "typescript", ".tsx": "tsx", ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript",
    ".py": "python", ".go": "go", ".rs": "rust", ".java": "java", ".kt": "kotlin", ".kts": "kotlin", ".rb": "ruby", ".php": "php",
    ".swift": "swift", ".scala": "scala", ".cs": "c_sharp", ".c": "c", ".h": "c", ".cpp": "cpp", ".cc": "cpp", ".hpp": "cpp", ".lua": "lua",
}
#: Extensions of these are known but not parsed.
SKIPPED = ("tsx",)

_NAME = r"([A-Za-z_$][\w$]*)"
_C_LIKE = rf"^[ \t]*(?:[\w<>,*&\[\]]+[ \t]+)+\*?{_NAME}[ \t]*\([^;{{}}]*\)[ \t]*(?:const[ \t]*)?\{{"
_TYPES = r"(?:class|interface|struct|enum|trait|object|protocol|record)"
#: Patterns of declarations: an approximation of what a parser finds.
DECLARATIONS = {
    "python": (rf"^[ \t]*(?:async[ \t]+)?def[ \t]+{_NAME}", rf"^[ \t]*class[ \t]+{_NAME}"),
    "go": (rf"^func[ \t]+(?:\([^)]*\)[ \t]*)?{_NAME}", rf"^type[ \t]+{_NAME}"),
    "rust": (rf"\bfn[ \t]+{_NAME}", rf"\b(?:struct|enum|trait|type)[ \t]+{_NAME}"),
    "kotlin": (rf"\bfun[ \t]+(?:<[^>]*>[ \t]*)?(?:[\w.]+\.)?{_NAME}", rf"\b{_TYPES}[ \t]+{_NAME}"),
    "scala": (rf"\bdef[ \t]+{_NAME}", rf"\b{_TYPES}[ \t]+{_NAME}"),
    "swift": (rf"\bfunc[ \t]+{_NAME}", rf"\b{_TYPES}[ \t]+{_NAME}"),
    "ruby": (rf"^[ \t]*def[ \t]+(?:self\.)?{_NAME}", rf"^[ \t]*(?:class|module)[ \t]+{_NAME}"),
    "php": (rf"\bfunction[ \t]+&?{_NAME}", rf"\b{_TYPES}[ \t]+{_NAME}"),
    "lua": (rf"\bfunction[ \t]+(?:[\w.]+[.:])?{_NAME}",),
    "javascript": (rf"\bfunction\*?[ \t]+{_NAME}", rf"\bclass[ \t]+{_NAME}", rf"\b(?:const|let|var)[ \t]+{_NAME}[ \t]*=[ \t]*(?:async[ \t]*)?(?:function\b|\([^)]*\)[ \t]*=>|\w+[ \t]*=>)"),
    "typescript": (rf"\bfunction\*?[ \t]+{_NAME}", rf"\b(?:class|interface|enum|type)[ \t]+{_NAME}", rf"\b(?:const|let|var)[ \t]+{_NAME}[^=\n]*=[ \t]*(?:async[ \t]*)?(?:function\b|\([^)]*\)[^=\n]*=>)"),
    "java": (rf"\b{_TYPES}[ \t]+{_NAME}", _C_LIKE),
    "c_sharp": (rf"\b{_TYPES}[ \t]+{_NAME}", _C_LIKE),
    "c": (rf"\b(?:struct|enum)[ \t]+{_NAME}[ \t]*\{{", _C_LIKE),
    "cpp": (rf"\b(?:class|struct|enum)[ \t]+{_NAME}", _C_LIKE),
}
_KEYWORDS = ("if", "for", "while", "switch", "return", "else", "catch", "new", "do", "try")


def with_language(files: DataFrame, path: str = "path") -> DataFrame:
    """files with lang by extension; null where it is not known."""
    table = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return files.withColumn("lang", F.try_element_at(table, F.regexp_extract(path, r"(\.[^./]*)$", 1)))


def _readable(files: DataFrame) -> DataFrame:
    return files.select("path", "lang", "content").where(F.col("lang").isNotNull() & ~F.col("lang").isin(*SKIPPED))


def find_symbols(files: DataFrame) -> DataFrame:
    """path, name, line, owner of declarations in source text (path, lang, content), each name once for a scope of a file."""
    return declarations(_readable(files), DECLARATIONS, _KEYWORDS).where(T.is_symbol_name("name"))


def find_mentions(files: DataFrame) -> DataFrame:
    """path, node, term, normalized, span of identifiers, comments and strings; of one normalised term of a node type in a file the last stays."""
    found = tokens(_readable(files))
    found = found.withColumn("term", F.when(F.col("node") == "identifier", F.col("term")).otherwise(T.clean_literal("term")))
    found = found.withColumn("normalized", T.mention_term("term")).where("normalized is not null")
    last = found.groupBy("path", "node", "normalized").agg(F.max(F.struct("at", "term", "span")).alias("x"))
    return last.select("path", "node", "normalized", "x.term", "x.span")


def symbol_graph(symbols: DataFrame, confidence: float = 0.6) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Artifacts, clusters as concept names, and implements edges (by concept name) of path, name, owner; of owners of one name the least."""
    own = symbols.groupBy(F.concat("path", F.lit("#"), "name").alias("ref"), "name", T.cluster_label("path").alias("cluster")).agg(F.min("owner").alias("owner"))
    attrs = F.map_concat(F.create_map(F.lit("via"), F.lit("pattern")), F.when(F.col("owner").isNotNull(), F.create_map(F.lit("owner"), F.col("owner"))).otherwise(F.create_map().cast("map<string,string>")))
    artifacts = own.select(key(F.lit("code"), "ref").alias("id"), F.lit("code_symbol").alias("kind"), F.lit("code").alias("layer"), F.lit("code").alias("source"), "ref", F.col("name").alias("title"), attrs.alias("attrs"))
    edges = own.select(key(F.lit("code"), "ref").alias("src_id"), F.col("cluster").alias("concept"), F.lit("implements").alias("type"), F.lit("inferred").alias("source"), F.lit(confidence).alias("confidence"), F.lit("proposed").alias("status"))
    return artifacts, own.select(F.col("cluster").alias("name")).distinct(), edges


def code_graph(exports: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Artifacts, concept names and edges of nested code-graph exports.

    Members give file and symbol artifacts and implements edges (0.7); calls are confirmed
    (1.0), and their ends become symbols if no member is; known attributes stay.
    """
    source = F.coalesce("source", F.lit("codegraph"))
    member = exports.select(source.alias("source"), F.explode("communities").alias("c")).select("source", F.col("c.label").alias("label"), F.explode("c.members").alias("m"))
    member = member.select("source", "label", F.col("m.kind").alias("symbol_kind"), F.col("m.name").alias("name"), T.forward_slashes("m.file").alias("file"), F.concat(T.forward_slashes("m.file"), F.lit("#"), F.col("m.name")).alias("ref"))
    call = exports.select(source.alias("source"), F.explode("calls").alias("c")).select("source", F.col("c.from").alias("from"), F.col("c.to").alias("to")).where("`from` is not null and `to` is not null")
    ends = call.select("source", F.col("from").alias("ref")).union(call.select("source", "to"))
    art = lambda kind, ref, title, kind_of: (key("source", ref).alias("id"), F.lit(kind).alias("kind"), F.lit("code").alias("layer"), "source", F.col(ref).alias("ref"), title.alias("title"), F.lit(None).cast("string").alias("body"), kind_of.alias("symbol_kind"))
    none = F.lit(None).cast("string")
    rows = member.select(*art("file", "file", F.col("file"), none)).union(member.select(*art("code_symbol", "ref", F.col("name"), F.col("symbol_kind")))).union(ends.select(*art("code_symbol", "ref", T.symbol_of("ref"), none)))
    artifacts = rows.groupBy("id", "kind", "layer", "source", "ref").agg(F.max("title").alias("title"), F.max("body").alias("body"), F.max("symbol_kind").alias("symbol_kind"))
    attrs = F.when(F.col("symbol_kind").isNotNull(), F.create_map(F.lit("symbolKind"), F.col("symbol_kind"))).otherwise(F.create_map().cast("map<string,string>"))
    artifacts = artifacts.withColumn("attrs", attrs).drop("symbol_kind")
    implements = member.select(key("source", "ref").alias("src_id"), F.col("label").alias("dst"), F.lit("implements").alias("type"), F.lit("inferred").alias("source"), F.lit(0.7).alias("confidence"), F.lit("proposed").alias("status"))
    calls = call.select(key("source", "from").alias("src_id"), key("source", "to").alias("dst"), F.lit("calls").alias("type"), F.lit("deterministic").alias("source"), F.lit(1.0).alias("confidence"), F.lit("confirmed").alias("status"))
    return artifacts, member.select(F.col("label").alias("name")).distinct(), implements.union(calls).distinct()


def longest_prefix_module(symbols: DataFrame, modules: DataFrame) -> DataFrame:
    """symbols (file) with the module whose path is the longest prefix of the file, else its first segment.

    Every prefix of a file that has the length of some module path is an equi-join key; the
    lengths are a property of the module list. Blank module paths are passed over.
    """
    own = modules.where(~T.is_blank("path")).groupBy("path").agg(F.min("name").alias("module"))
    sizes = sorted(r["n"] for r in own.select(F.length("path").alias("n")).distinct().collect())
    rows = symbols.withColumn("_row", F.monotonically_increasing_id()) if "_row" not in symbols.columns else symbols
    files = rows.select("file").distinct()
    prefixes = F.array_distinct(F.filter(F.transform(F.array(*[F.lit(n) for n in sizes]) if sizes else F.array().cast("array<int>"), lambda n: F.when(F.length("file") >= n, F.substring(F.col("file"), F.lit(1), n))), lambda p: p.isNotNull()))
    best = files.select("file", F.explode(prefixes).alias("path")).join(own, "path").groupBy("file").agg(F.max_by("module", F.length("path")).alias("module"))
    return rows.join(best, "file", "left").withColumn("module", T.capitalize(F.coalesce("module", T.top_segment("file")))).drop("_row")


def ast_index(files: DataFrame, symbols: DataFrame, modules: DataFrame) -> DataFrame:
    """name, kind, file and module of the symbols of an index; imports, symbols without a kind or a known file are left out."""
    named = symbols.where("kind <> 'import'").join(files.select(F.col("id").alias("file_id"), F.col("path").alias("file")), "file_id")
    return longest_prefix_module(named.select("name", "kind", "file"), modules)


