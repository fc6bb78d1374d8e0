"""Declarations of source text with the scope that encloses them, and its tokens, by Column expressions and windows.

Comments and strings are first blanked to their length, so places and line breaks stay. Text of a language with
braces is cut at braces and semicolons: the depth of a piece is a running sum, a closing brace belongs to the
last opening one of its depth, and so the depth in declarations alone is a running sum too; a declaration's
owner is the last one that opened one level above. In a language that goes by indentation, the owner is
the declaration on the last line before that is indented less than any between. Windows are those of one
file, whose size is bounded where files are listed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What begins a comment or a string, by language; the rest are as in the first entry.
_LINE, _BLOCK = r"//[^\n]*+", r"/\*(?:[^*]|\*(?!/))*+(?:\*/)?"
_QUOTED = r'"(?:[^"\\\n]|\\.)*+"|\'(?:[^\'\\\n]|\\.)*+\'|`(?:[^`\\]|\\.)*+`'
_TRIPLE = r'"""(?:[^"\\]|\\.|"(?!""))*+(?:""")?|' + r"'''(?:[^'\\]|\\.|'(?!''))*+(?:''')?"
HIDDEN = {
    None: rf"{_LINE}|{_BLOCK}|{_QUOTED}",
    "python": rf"\#[^\n]*+|{_TRIPLE}|{_QUOTED}",
    "ruby": rf"\#[^\n]*+|{_QUOTED}",
    "lua": rf"--\[\[(?:[^\]]|\](?!\]))*+(?:\]\])?|--[^\n]*+|{_QUOTED}",
    "php": rf"{_LINE}|{_BLOCK}|\#[^\n]*+|{_QUOTED}",
    "rust": rf'{_LINE}|{_BLOCK}|"(?:[^"\\]|\\.)*+"|\'(?:[^\'\\\n]|\\[^\'\n]{{1,9}})\'',
    "kotlin": rf"{_LINE}|{_BLOCK}|{_TRIPLE}|{_QUOTED}",
}
INDENTED = ("python", "ruby", "lua")
_REST = r"[^/\"'`#\-]++|."
TOKENS = rf"(?sU)(?:{_LINE}|/\*.*?\*/|\#[^\n]*+|--[^\n]*+)|{_QUOTED}|[A-Za-z_$][\w$]*+|[^A-Za-z_$/\"'`#\-]++|."


def _by_language(table: dict, make) -> Column:
    """make(value) of the language of a row, or of the entry None."""
    own = reduce(lambda c, kv: c.when(F.col("lang") == kv[0], make(kv[1])), ((k, v) for k, v in table.items() if k), F)
    return own if None not in table else make(table[None]) if own is F else own.otherwise(make(table[None]))


def blanked(languages=tuple(HIDDEN), content: str = "content") -> Column:
    """The text, of one of these languages, with comments and strings as spaces, line breaks kept."""

    def blank(hidden: str) -> Column:
        pieces = F.regexp_extract_all(content, F.lit(rf"(?s)(?:{hidden})|{_REST}"), 0)
        mark = lambda t: (F.length(t) > 1) & t.rlike("^(?://|/\\*|--|#|[\"'`])")
        return F.array_join(F.transform(pieces, lambda t: F.when(mark(t), F.regexp_replace(t, r"[^\n]", " ")).otherwise(t)), "")

    return _by_language({k: v for k, v in HIDDEN.items() if k is None or k in languages}, blank)


def _declared(patterns: dict[str, tuple[str, ...]], text: Column) -> Column:
    """The matches of the language's patterns in a text and the names in them, by place."""

    def found(own: tuple[str, ...]) -> Column:
        one = lambda p: F.transform(F.regexp_extract_all(text, F.lit(f"(?mU){p}"), 0), lambda m: F.struct(m.alias("hit"), F.regexp_extract(m, f"(?mU){p}", 1).alias("name")))
        return F.concat(*map(one, own))

    return _by_language(patterns, found)


def _breaks(text) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def _pieces(files: DataFrame, patterns: dict, texts: Column) -> DataFrame:
    """path, pos, line breaks, hits (name, line breaks before it) of each piece of a file's text, without the text."""
    rows = files.select("path", "lang", F.posexplode(texts).alias("pos", "piece"))
    rows = rows.withColumn("hits", F.coalesce(_declared(patterns, F.col("piece")), F.array().cast("array<struct<hit:string,name:string>>")))
    until = lambda t, part: F.call_function("substring_index", t, part, F.lit(1))
    before = lambda h: F.concat(until(F.col("piece"), h["hit"]), until(h["hit"], h["name"]))
    hits = F.transform("hits", lambda h: F.struct(F.length(before(h)).alias("at"), _breaks(before(h)).alias("breaks"), h["name"].alias("name")))
    return rows.select("path", "lang", "pos", F.right("piece", F.lit(1)).alias("end"), _breaks("piece").alias("breaks"), F.length(F.regexp_extract("piece", r"^[ \t]*", 0)).alias("indent"), (F.trim("piece") == "").alias("blank"), F.array_sort(hits).alias("hits"))


def _in_braces(files: DataFrame, patterns: dict, skip: tuple[str, ...]) -> DataFrame:
    """path, pos, at, name, line and owner of each declaration."""
    rows = _pieces(files, patterns, F.regexp_extract_all("text", F.lit(r"[^{};]++[{};]?|[{};]"), 0))
    rows = rows.withColumn("hits", F.filter("hits", lambda h: ~h["name"].isin(*skip)))
    file = Window.partitionBy("path").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    opens, closes = F.col("end") == "{", F.col("end") == "}"
    rows = rows.withColumn("line", F.coalesce(F.sum("breaks").over(file), F.lit(0)) + 1)
    rows = rows.withColumn("depth", F.coalesce(F.sum(opens.cast("int") - closes.cast("int")).over(file), F.lit(0)))
    rows = rows.withColumn("named", opens & (F.size("hits") > 0)).where(F.col("end").isin("{", "}") | (F.size("hits") > 0))
    # a closing brace at depth d ends what the last opening one at depth d - 1 began
    level = Window.partitionBy("path", F.when(closes, F.col("depth") - 1).otherwise(F.col("depth"))).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    ended = closes & F.coalesce(F.last(F.when(opens, F.col("named")), ignorenulls=True).over(level), F.lit(False))
    rows = rows.withColumn("step", F.col("named").cast("int") - ended.cast("int"))
    rows = rows.withColumn("inside", F.coalesce(F.sum("step").over(file), F.lit(0))).where(F.size("hits") > 0)
    seen = rows.select("path", "pos", F.col("inside").alias("level"), F.lit(None).cast("string").alias("opened"), "hits", "line")
    made = rows.where("named").select("path", "pos", (F.col("inside") + 1).alias("level"), F.col("hits")[F.size("hits") - 1]["name"].alias("opened"), F.lit(None).cast(rows.schema["hits"].dataType).alias("hits"), F.lit(None).cast("long").alias("line"))
    outer = Window.partitionBy("path", "level").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    owned = seen.union(made).withColumn("owner", F.last("opened", ignorenulls=True).over(outer)).where("hits is not null")
    return owned.select("path", "pos", "owner", "line", F.inline("hits")).select("path", "pos", "at", "name", (F.col("line") + F.col("breaks")).cast("int").alias("line"), "owner")


def _by_indent(files: DataFrame, patterns: dict, skip: tuple[str, ...]) -> DataFrame:
    """path, pos, at, name, line and owner of each declaration."""
    rows = _pieces(files, patterns, F.split("text", "\n")).where("not blank").withColumn("hits", F.filter("hits", lambda h: ~h["name"].isin(*skip)))
    levels = rows.where(F.size("hits") > 0).groupBy("path").agg(F.collect_set("indent").alias("levels"))
    rows = rows.join(levels, "path").withColumn("own", F.size("hits") > 0)
    # a line stands at every level that it would end, a declaration at those it may belong to, too
    each = rows.withColumn("level", F.explode("levels")).where((F.col("indent") <= F.col("level")) | F.col("own"))
    opener = F.when(F.col("indent") <= F.col("level"), F.struct("pos", F.when(F.col("own") & (F.col("indent") == F.col("level")), F.col("hits")[0]["name"]).alias("name")))
    outer = Window.partitionBy("path", "level").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    met = each.withColumn("last", F.last(opener, ignorenulls=True).over(outer)).where("own")
    owner = F.max_by("last.name", F.when((F.col("level") < F.col("indent")) & F.col("last.name").isNotNull(), F.col("level")))
    owned = met.groupBy("path", "pos").agg(owner.alias("owner"), F.first("hits").alias("hits"))
    return owned.select("path", "pos", "owner", F.inline("hits")).select("path", "pos", "at", "name", (F.col("pos") + 1).cast("int").alias("line"), "owner")


def declarations(files: DataFrame, patterns: dict[str, tuple[str, ...]], skip: tuple[str, ...] = ()) -> DataFrame:
    """path, name, line and owner (the name of the enclosing declaration, or null) of files (path, lang, content).

    patterns: for each language, expressions whose first group is a name. A name that stands several times in one
    scope of a file counts once, at its first place.
    """
    there = {r[0] for r in files.select("lang").distinct().collect()}  # as many as languages; the others' patterns are not compiled
    parts = []
    for make, own in ((_in_braces, {k: v for k, v in patterns.items() if k not in INDENTED and k in there}), (_by_indent, {k: v for k, v in patterns.items() if k in INDENTED and k in there})):
        if own:
            known = files.where(F.col("lang").isin(*own) & F.col("content").isNotNull())
            parts.append(make(known.select("path", "lang", blanked(own).alias("text")), own, skip))
    if not parts:
        return files.sparkSession.createDataFrame([], "path string, name string, line int, owner string")
    rows = reduce(DataFrame.unionByName, parts)
    return rows.groupBy("path", "owner", "name").agg(F.min(F.struct("line", "pos", "at")).alias("first")).select("path", "name", "first.line", "owner")


def tokens(files: DataFrame) -> DataFrame:
    """path, node (comment, string, identifier), term, span (line) and at (order in the file) of source text (path, content)."""
    rows = files.where("content is not null").select("path", F.posexplode(F.regexp_extract_all("content", F.lit(TOKENS), 0)).alias("at", "term"))
    node = F.when(F.col("term").rlike(r"^(?://|/\*|#|--)"), "comment").when((F.length("term") > 1) & F.col("term").rlike("^[\"'`]"), "string").when(F.col("term").rlike("^[A-Za-z_$]"), "identifier")
    slim = rows.select("path", "at", node.alias("node"), F.when(node.isNotNull(), F.col("term")).alias("term"), _breaks("term").alias("breaks")).where("node is not null or breaks > 0")
    file = Window.partitionBy("path").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    return slim.withColumn("span", (F.coalesce(F.sum("breaks").over(file), F.lit(0)) + 1).cast("int")).where("node is not null").select("path", "node", "term", "span", "at")
