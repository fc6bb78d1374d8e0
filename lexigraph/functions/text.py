"""Text and identifier functions as Column expressions; none of them leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values ---------------------------------------------------------------------------

#: Tokens that say nothing about a product.
STOPWORDS = (
    "type", "types", "string", "str", "name", "value", "val", "data", "id", "db", "key", "node", "path",
    "src", "dist", "out", "build", "version", "script", "scripts", "dependency", "dependencies", "option",
    "options", "config", "index", "util", "utils", "const", "let", "var", "return", "import", "export", "from",
    "function", "fn", "func", "method", "class", "interface", "enum", "void", "int", "bool", "boolean", "number",
    "num", "float", "double", "object", "obj", "array", "arr", "true", "false", "null", "undefined", "none",
    "this", "self", "new", "get", "set", "args", "arg", "param", "params", "result", "res", "req", "error", "err",
    "exception", "item", "items", "list", "map", "default", "module", "modules", "require", "async", "await",
    "public", "private", "protected", "static", "final", "override", "length", "size", "count", "ref", "title",
    "kind", "layer", "source", "field", "row", "col", "tmp", "temp", "test", "tests", "spec", "print", "log",
    "println", "todo", "main", "init", "run",
)

#: Directories that name a layer, not a feature.
GENERIC_DIRS = (
    "src", "lib", "internal", "app", "apps", "cmd", "pkg", "packages", "main",
    "source", "sources", "dist", "build", "target", "out", "vendor", "node_modules",
    "test", "tests", "transport", "service", "services", "store", "stores",
    "repository", "domain", "model", "models", "dto", "api", "core", "common",
    "shared", "util", "utils", "helpers", "config", "types", "db", "database", "server",
)

#: Headings that are never terms of a product.
GENERIC_HEADINGS = (
    "overview", "introduction", "intro", "getting started", "usage", "examples", "example",
    "api", "reference", "configuration", "config", "installation", "install", "faq", "changelog",
    "contents", "summary", "notes", "links", "see also", "prerequisites", "setup", "quick start",
    "architecture", "data model", "описание", "обзор", "примеры", "использование", "настройка",
)

#: Words that state a constraint; the Russian ones are stems.
CONSTRAINT_WORDS = r"must not|must|cannot|can only|may not|shall|should not|should|require[sd]?|never|always|forbidden|not allowed|mandatory|at most|at least|no more than|only|within \d+"
CONSTRAINT_STEMS = r"должн|обязан|обязательн|только|нельзя|запрещ|не может|не дол|в течение \d+|не более|не менее|всегда|никогда"
SCHEMA_TOKENS = r"FK|PK|uuid|varchar"
#: Of these each sentence with a constraint has one: the words and stems above but for those that follow from another.
CONSTRAINT_CUES = r"(?=[mcsrnafowдонзв])(?:must|cannot|may\s+not|shall|should|require|never|always|forbidden|not\s+allowed|mandatory|at\s+most|at\s+least|no\s+more\s+than|only|within\s+\d|должн|обязан|обязательн|только|нельзя|запрещ|не\s+может|не\s+дол|в\s+течение\s+\d|не\s+более|не\s+менее|всегда|никогда)"

#: Word boundaries that treat letters of any script alike in every regex engine.
LEFT, RIGHT = r"(^|[^\p{L}\p{N}_])", r"([^\p{L}\p{N}_]|$)"
CONSTRAINT = rf"(?iu){LEFT}({CONSTRAINT_WORDS}){RIGHT}|({CONSTRAINT_STEMS})"
SCHEMA_TOKEN = rf"(?iu){LEFT}({SCHEMA_TOKENS}){RIGHT}"
HEADING = r"^#{1,6}\s+(.*)$"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# Blanks -----------------------------------------------------------------------------------


def utrim(c) -> Column:
    """Without white space of any script at both ends."""
    return F.regexp_replace(_c(c), r"(?U)^\s+|\s+$", "")


def is_blank(c) -> Column:
    return F.coalesce(utrim(c), F.lit("")) == ""


def null_if_blank(c) -> Column:
    return F.when(~is_blank(c), _c(c))


# Identifiers ------------------------------------------------------------------------------


def split_identifier(c) -> Column:
    """Lower-cased tokens of an identifier: camel case and _ - . / : separate; short and numeric ones are left out."""
    spaced = F.regexp_replace(F.regexp_replace(_c(c), "([a-z0-9])([A-Z])", "$1 $2"), r"[_\-./:]+", " ")
    return F.filter(F.split(F.lower(spaced), r"\s+"), lambda t: (F.length(t) > 1) & ~t.rlike(r"^\d+$"))


def normalize(c) -> Column:
    return F.array_join(split_identifier(c), " ")


def clean_literal(c) -> Column:
    """A comment or string literal without its quotes."""
    return utrim(F.translate(_c(c), "\"'`", ""))


def meaningful_tokens(c) -> Column:
    """Tokens of a normalised term that are not stop words (repeats stay)."""
    stop = F.array(*[F.lit(w) for w in STOPWORDS])
    return F.filter(split_identifier(c), lambda t: ~F.array_contains(stop, t))


def mention_term(c) -> Column:
    """The normalised term of a mention, null if nothing of 2 to 80 characters is left."""
    term = F.array_join(meaningful_tokens(c), " ")
    return F.when(F.length(_c(c)).between(2, 80) & (term != ""), term)


def is_symbol_name(c) -> Column:
    return F.length(_c(c)).between(2, 80) & ~is_blank(c)


def capitalize(c) -> Column:
    return F.concat(F.upper(F.substring(_c(c), 1, 1)), F.substring(_c(c), 2, 2**31 - 1))


def cluster_label(ref) -> Column:
    """The nearest directory that names a feature, else the file's stem if that is not generic, else Misc; first letter upper-case."""
    parts = F.split(F.substring_index(_c(ref), "#", 1), "/")
    generic = F.array(*[F.lit(d) for d in GENERIC_DIRS])
    telling = lambda d: ~is_blank(d) & ~F.array_contains(generic, F.lower(d))
    dirs = F.filter(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), telling)
    stem = F.regexp_replace(F.element_at(parts, -1), r"\.[^.]*$", "")
    return capitalize(F.coalesce(F.get(F.reverse(dirs), 0), F.when(telling(stem), stem), F.lit("Misc")))


def top_segment(path) -> Column:
    """The first part of a path that is neither blank nor a dot, else code."""
    return F.coalesce(F.get(F.filter(F.split(_c(path), "/"), lambda p: ~is_blank(p) & (p != ".")), 0), F.lit("code"))


def normal_key(name) -> Column:
    """Singular form of a concept's name, by suffix."""
    n = F.lower(utrim(name))
    cut = lambda k: F.substring(n, F.lit(1), F.length(n) - k)
    return (
        F.when((F.length(n) <= 3) | n.endswith("ss"), n)
        .when(n.endswith("ies"), F.concat(cut(3), F.lit("y")))
        .when(n.rlike("(ses|xes|zes|ches|shes)$"), cut(2))
        .when(n.endswith("s"), cut(1))
        .otherwise(n)
    )


# References and paths ---------------------------------------------------------------------


def directory_of(ref) -> Column:
    return F.regexp_extract(_c(ref), "^(.*)/", 1)


def file_of(ref) -> Column:
    return F.substring_index(_c(ref), "#", 1)


def symbol_of(ref) -> Column:
    return F.substring_index(_c(ref), "#", -1)


def forward_slashes(path) -> Column:
    return F.translate(_c(path), "\\", "/")


def language_tag(file) -> Column:
    """A short tag for the language of a file, by its extension."""
    f = _c(file)
    return (
        F.when(f.endswith(".go"), "[go]")
        .when(f.rlike(r"\.tsx?$"), "[ts]")
        .when(f.rlike(r"\.kts?$"), "[kt]")
        .when(f.endswith(".py"), "[py]")
        .otherwise("[..]")
    )


def page_name(url) -> Column:
    """The last part of a URL's path without its query; the URL if that is blank."""
    path = F.regexp_replace(F.substring_index(_c(url), "?", 1), "/+$", "")
    return F.coalesce(null_if_blank(F.substring_index(path, "/", -1)), _c(url))


# Markdown and HTML ------------------------------------------------------------------------


def slug(c) -> Column:
    s = F.regexp_replace(F.regexp_replace(F.lower(_c(c)), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.coalesce(null_if_blank(F.substring(s, 1, 60)), F.lit("section"))


def lines(c) -> Column:
    return F.split(_c(c), "\r\n|\n|\r")


def alias_from_heading(h) -> Column:
    """A heading as an alias: without a leading number and final colons; null if it is no term."""
    s = utrim(F.regexp_replace(utrim(F.regexp_replace(_c(h), r"^\s*\d+[.)]\s*", "")), ":+$", ""))
    generic = F.lower(s).isin(*GENERIC_HEADINGS)
    bad = is_blank(s) | (F.length(s) > 50) | (F.size(F.split(s, r"\s+")) > 6) | generic | s.rlike(r"[`|#(]")
    return F.when(~bad, s)


def decode_entities(c) -> Column:
    out = _c(c)
    for entity, char in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return out


def html_to_text(html) -> Column:
    """HTML as text with headings as #, list items as dashes, blocks as lines; text without < stays."""
    s = F.regexp_replace(_c(html), r"(?is)<(script|style|noscript|head)[^>]*>.*?</\1>", " ")
    for level in range(1, 7):
        s = F.regexp_replace(s, rf"(?is)<h{level}[^>]*>(.*?)</h{level}>", "\n" + "#" * level + " $1\n")
    s = F.regexp_replace(s, r"(?i)<li[^>]*>", "\n- ")
    s = F.regexp_replace(s, r"(?i)</(p|div|section|article|tr|li|h[1-6])>|<br\s*/?>", "\n")
    s = decode_entities(F.regexp_replace(s, "<[^>]+>", ""))
    return F.when(_c(html).contains("<"), utrim(F.regexp_replace(s, r"\n{3,}", "\n\n"))).otherwise(_c(html))


# Rules ------------------------------------------------------------------------------------


def sentences(body) -> Column:
    """Cleaned sentences of a body, in order: bullets and quotes stripped, white space collapsed."""
    bare = lambda s: F.regexp_replace(utrim(s), "^[-*•> \\t]+|[-*•> \\t]+$", "")
    return F.transform(F.split(_c(body), r"(?<=[.!?])\s+|\n+"), lambda s: F.regexp_replace(bare(s), r"\s+", " "))


def is_prose_rule(s) -> Column:
    """A sentence that states a constraint and is no table row, URL, code or schema line."""
    s = _c(s)
    ticks = F.length(s) - F.length(F.replace(s, F.lit("`"), F.lit("")))
    return F.length(s).between(12, 240) & ~s.contains("|") & ~s.contains("://") & (ticks < 4) & s.rlike(CONSTRAINT) & ~(s.contains("=") & s.rlike(SCHEMA_TOKEN))


def may_have_rules(body) -> Column:
    """Whether a constraint word stands anywhere, boundaries not looked at: cheap, true for all texts with a rule.

    The text is lower-cased once and searched as it then is; the few signs that only folding takes for a letter count as one.
    """
    return F.lower(_c(body)).rlike(CONSTRAINT_CUES) | _c(body).rlike("[\u0130\u017f\u212a]")


def rules_in(body, most: int = 3) -> Column:
    """The first distinct rule sentences of a body; bodies without a cue are not cut into sentences."""
    found = F.slice(F.array_distinct(F.filter(sentences(body), is_prose_rule)), 1, most)
    return F.when(_c(body).isNotNull(), F.when(may_have_rules(body), found).otherwise(F.array().cast("array<string>")))


def rule_ref(sentence) -> Column:
    return F.concat(F.lit("rule:"), F.substring(F.sha2(_c(sentence), 256), 1, 16))


def snippet(body) -> Column:
    """The first line that is neither blank nor a heading, 180 characters of it."""
    own = F.filter(F.transform(lines(body), utrim), lambda s: (s != "") & ~s.startswith("#"))
    return F.substring(F.coalesce(F.get(own, 0), F.lit("")), 1, 180)


# Verdicts, usage, numbers -----------------------------------------------------------------


def json_string(c) -> Column:
    """A string as a JSON string, quotes, backslashes and control characters escaped."""
    return F.regexp_extract(F.to_json(F.struct(_c(c).alias("x"))), r'(?s)^\{"x":(.*)\}$', 1)


def json_array_in(reply) -> Column:
    """What stands from the first [ to the last ] of a reply; empty without both."""
    return F.regexp_extract(_c(reply), r"(?s)\[.*\]", 0)


def is_hit(reply) -> Column:
    return ~(_c(reply).rlike("^(No concepts?|Provide|Unknown tool)") | _c(reply).contains("no concept linked"))


def relates_confidence(n) -> Column:
    return F.least(F.lit(0.9), F.lit(0.3) + _c(n) * F.lit(0.1))


def day_of(ts_ms) -> Column:
    return F.date_format(F.timestamp_millis(_c(ts_ms)), "yyyy-MM-dd")
