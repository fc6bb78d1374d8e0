"""Registered queries of ingest, text functions and mutations on the given tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import code, docs, dml, evals, export, render, serve
from ..operators.snapshot import empty
from ..sources.pages import page_documents
from . import fixtures as X
from . import ingest
from .catalogue import PATH, html_sql, query, text
from .fixtures import with_tables as w

# --- sources and ingest -------------------------------------------------------------------

#: Source files made of suppliers: two declarations each, in three languages, one of them not read.
_FILES_SQL = """SELECT s_suppkey AS k, 'src/team'||(s_suppkey%7)||'/s'||s_suppkey||e AS path, s_nationkey AS mtime, e FROM (SELECT *, CASE s_suppkey%4 WHEN 0 THEN '.go' WHEN 1 THEN '.py' WHEN 2 THEN '.go' ELSE '.tsx' END AS e FROM supplier)"""


def _source_files(spark, d, second: bool = False):
    """The tree, or its second state: some files gone, some touched and given another declaration."""
    s = X.table(spark, d, "supplier")
    k, key = F.col("s_suppkey") % 4, F.col("s_suppkey").cast("string")
    ext = F.when(k == 1, ".py").when(k == 3, ".tsx").otherwise(".go")
    more = F.lit("z") if second else F.lit("")
    touched = (F.col("s_suppkey") % 5 == 0) & F.lit(second)
    suffix = F.when(touched, more).otherwise("")
    go = F.concat(F.lit("package p\n\nfunc Get"), key, suffix, F.lit("() {}\n\ntype Kind"), key, F.lit(" struct {}\n"))
    py = F.concat(F.lit("# reads\ndef get_"), key, suffix, F.lit("():\n    pass\n\nclass Kind"), key, F.lit(":\n    pass\n"))
    rows = s.select(F.concat(F.lit("src/team"), F.col("s_suppkey") % 7, F.lit("/s"), key, ext).alias("path"), (F.col("s_nationkey") + touched.cast("long")).cast("long").alias("mtime"), F.when(k == 1, py).otherwise(go).alias("content"), F.col("s_suppkey"))
    rows = rows.where("s_suppkey % 6 <> 0") if second else rows
    return code.with_language(rows.drop("s_suppkey"))


@query(f"""WITH f AS ({_FILES_SQL}), a AS (SELECT * FROM f WHERE e<>'.tsx'), b AS (SELECT * FROM f WHERE k%6<>0 AND e<>'.tsx'), c AS (SELECT * FROM b WHERE k%5=0)
SELECT 'files' AS counter, count(*) AS n FROM b UNION ALL SELECT 'changed', count(*) FROM c UNION ALL SELECT 'gone', count(*) FROM a WHERE k%6=0
UNION ALL SELECT 'symbols', 2*count(*) FROM c UNION ALL SELECT 'links', 2*count(*) FROM c UNION ALL SELECT 'concepts', count(DISTINCT k%7) FROM c
UNION ALL SELECT 'skipped_files', count(*) FROM f WHERE k%6<>0 AND e='.tsx'""")
def ingest_symbols_counters(spark, d):
    graph, _ = ingest.ingest_symbols(empty(spark), _source_files(spark, d))
    return ingest.ingest_symbols(graph, _source_files(spark, d, second=True))[1]


@query(f"""WITH f AS ({_FILES_SQL}), b AS (SELECT *, CASE WHEN k%5=0 THEN 'z' ELSE '' END AS z FROM f WHERE k%6<>0 AND e<>'.tsx')
SELECT path||'#'||CASE WHEN e='.go' THEN 'Get'||k||z ELSE 'get_'||k||z END AS ref, 'Team'||(k%7) AS concept FROM b UNION ALL SELECT path||'#Kind'||k, 'Team'||(k%7) FROM b""")
def ingest_symbols_twice(spark, d):
    graph, _ = ingest.ingest_symbols(empty(spark), _source_files(spark, d))
    graph, _ = ingest.ingest_symbols(graph, _source_files(spark, d, second=True))
    return serve.implementers_of(graph.edges, graph.artifacts).where("kind = 'code_symbol'").join(graph.concepts.select(F.col("id").alias("concept_id"), F.col("name").alias("concept")), "concept_id").select("ref", "concept")


@query(f"""WITH f AS ({_FILES_SQL}), a AS (SELECT * FROM f WHERE e<>'.tsx')
SELECT normalized, count(*) AS n FROM (SELECT 'package' AS normalized FROM a WHERE e='.go' UNION ALL SELECT 'get'||k FROM a WHERE e='.go' UNION ALL SELECT 'kind'||k FROM a
UNION ALL SELECT 'struct' FROM a WHERE e='.go' UNION ALL SELECT 'def' FROM a WHERE e='.py' UNION ALL SELECT 'pass' FROM a WHERE e='.py' UNION ALL SELECT 'reads' FROM a WHERE e='.py') GROUP BY 1""")
def ingest_mentions(spark, d):
    graph, _ = ingest.ingest_mentions(empty(spark), _source_files(spark, d))
    return graph.mentions.join(graph.artifacts.select(F.col("id").alias("artifact_id")), "artifact_id").groupBy("normalized").agg(F.count("*").alias("n"))


@query(w("module", "SELECT s_name AS name, 'func' AS kind, file, coalesce(upper(left(m,1))||substr(m,2), split_part(file,'/',1)) AS module FROM (SELECT s_name, r_name||'/'||n_name||'/x.go' AS file, (SELECT arg_max(name, length(path)) FROM module WHERE starts_with(r_name||'/'||n_name||'/x.go', path)) AS m FROM supplier JOIN place ON s_nationkey=n_nationkey WHERE s_suppkey%3<>0)"))
def symbol_index(spark, d):
    n, r = X.table(spark, d, "nation"), X.table(spark, d, "region")
    files = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("id"), F.concat("r_name", F.lit("/"), "n_name", F.lit("/x.go")).alias("path"))
    kind = F.when(F.col("s_suppkey") % 3 == 0, "import").otherwise("func")
    symbols = X.table(spark, d, "supplier").select(F.col("s_name").alias("name"), kind.alias("kind"), F.col("s_nationkey").alias("file_id"))
    return code.ast_index(files, symbols, X.modules(spark, d))


_SLUG = "coalesce(nullif(left(regexp_replace(regexp_replace(lower({0}), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 60), ''), 'section')"
_PAGES_SQL = f"""WITH t AS (SELECT url AS ref, coalesce(nullif(string_split(regexp_replace(split_part(url,'?',1),'/+$',''),'/')[-1],''), url) AS name, content FROM ({html_sql()}) JOIN pages USING (page_id) WHERE html IS NOT NULL),
l AS (SELECT ref, name, unnest(s) AS line, generate_subscripts(s,1) AS pos FROM (SELECT ref, name, string_split_regex(content, '\\r\\n|\\n|\\r') AS s FROM t)),
h AS (SELECT *, regexp_matches(line, '^#{{1,6}}\\s+(.*)$') AS is_heading FROM l),
p AS (SELECT *, sum(CASE WHEN is_heading THEN 1 ELSE 0 END) OVER (PARTITION BY ref, name ORDER BY pos) AS part FROM h),
g AS (SELECT ref, name, part, CASE WHEN part=0 THEN '(intro)' ELSE trim(max(CASE WHEN is_heading THEN regexp_extract(line, '^#{{1,6}}\\s+(.*)$', 1) END)) END AS heading, coalesce(string_agg(CASE WHEN NOT is_heading THEN line END, chr(10) ORDER BY pos), '') AS body FROM p GROUP BY 1,2,3),
n AS (SELECT *, CAST(row_number() OVER (PARTITION BY ref, name ORDER BY part)-1 AS INT) AS idx FROM g WHERE part>0 OR trim(body, ' '||chr(10)||chr(9))<>'')
SELECT ref, idx, ref||'#'||CASE WHEN heading='(intro)' THEN 'intro-'||idx ELSE {_SLUG.format('heading')} END AS section, CASE WHEN heading='(intro)' THEN name ELSE heading END AS title, CAST(length(body) AS INT) AS n_chars FROM n"""


@query(_PAGES_SQL)
def page_sections(spark, d):
    parts = docs.section_artifacts(docs.split_sections(page_documents(X.table(spark, d, "pages"))))
    return parts.select("ref", "idx", "section", "title", F.length("body").alias("n_chars"))


# --- text functions -----------------------------------------------------------------------


@query("SELECT doc_id, left(coalesce(list_filter(list_transform(string_split_regex(coalesce(text,''), '\\r\\n|\\n|\\r'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x<>'' AND NOT starts_with(x,'#'))[1], ''), 180) AS snippet FROM documents")
def snippet(spark, d):
    return X.table(spark, d, "documents").select("doc_id", T.snippet(F.coalesce("text", F.lit(""))).alias("snippet"))


@query("SELECT doc_id, 'rule:'||left(sha256(coalesce(text,'')),16) AS ref FROM documents")
def rule_refs(spark, d):
    return X.table(spark, d, "documents").select("doc_id", T.rule_ref(F.coalesce("text", F.lit(""))).alias("ref"))


@query("SELECT conv_id, turn, NOT (regexp_matches(r,'^(No concepts?|Provide|Unknown tool)') OR contains(r,'no concept linked')) AS hit FROM (SELECT conv_id, turn, CASE conv_id%5 WHEN 0 THEN 'No concept named '||text WHEN 1 THEN 'Unknown tool '||text WHEN 2 THEN text||' has no concept linked to it' WHEN 3 THEN 'provide '||text ELSE text END AS r FROM conversations)")
def reply_hits(spark, d):
    k, t = F.col("conv_id") % 5, F.col("text")
    reply = F.when(k == 0, F.concat(F.lit("No concept named "), t)).when(k == 1, F.concat(F.lit("Unknown tool "), t)).when(k == 2, F.concat(t, F.lit(" has no concept linked to it"))).when(k == 3, F.concat(F.lit("provide "), t)).otherwise(t)
    return X.table(spark, d, "conversations").select("conv_id", "turn", T.is_hit(reply).alias("hit"))


@query("SELECT part.p_partkey, '\"'||replace(replace(p_name||CASE p_size%3 WHEN 0 THEN ' \"'||p_type||'\"' WHEN 1 THEN ' \\'||p_brand ELSE '' END, '\\', '\\\\'), '\"', '\\\"')||'\"' AS json FROM part")
def json_strings(spark, d):
    k = F.col("p_size") % 3
    more = F.when(k == 0, F.concat(F.lit(' "'), "p_type", F.lit('"'))).when(k == 1, F.concat(F.lit(" \\"), "p_brand")).otherwise("")
    return X.table(spark, d, "part").select("p_partkey", T.json_string(F.concat("p_name", more)).alias("json"))


# --- mutations ----------------------------------------------------------------------------


@query(w("prev cur", "SELECT coalesce(c.path,p.path) AS path, coalesce(c.mtime,p.mtime) AS mtime FROM prev p FULL JOIN cur c ON p.path=c.path"))
def upsert_files(spark, d):
    return dml.upsert_files(X.listed_files(spark, d).withColumn("_seq", F.lit(1)), X.stored_files(spark, d)).select("path", "mtime")


@query(w("prev cur", "SELECT (SELECT count(*) FROM prev) AS indexed, (SELECT count(*) FROM prev p LEFT JOIN cur c ON p.path=c.path WHERE c.path IS NULL OR p.mtime<>c.mtime) AS stale"))
def file_counts(spark, d):
    return ingest.file_counts(X.stored_files(spark, d), X.listed_files(spark, d))


@query(w("concept", "SELECT name, status, count(*) AS n FROM (SELECT name, status FROM concept UNION ALL SELECT * FROM (SELECT DISTINCT n_name, 'candidate' FROM nation) UNION ALL SELECT 'new '||t, 'candidate' FROM (SELECT DISTINCT p_type AS t FROM part)) GROUP BY 1,2"))
def find_or_create_concepts(spark, d):
    p = X.table(spark, d, "part")
    names = X.table(spark, d, "nation").select(F.col("n_name").alias("name")).union(p.select(F.concat(F.lit("new "), "p_type"))).union(p.select("p_name")).union(p.select(F.lit(None).cast("string")))
    return dml.find_or_create_concepts(X.concepts(spark, d), names).groupBy("name", "status").agg(F.count("*").alias("n"))


@query("SELECT 'd'||doc_id AS artifact_id, 'new' AS term, count(*) AS n FROM documents WHERE doc_id%3=0 GROUP BY 1 UNION ALL SELECT 'd'||doc_id, 'old', 2*count(*) FROM documents WHERE doc_id%3<>0 GROUP BY 1")
def replace_mentions(spark, d):
    own = X.table(spark, d, "documents").select(F.concat(F.lit("d"), "doc_id").alias("artifact_id"), "doc_id")
    stored = own.select("artifact_id", F.lit("old").alias("term"))
    new = own.where("doc_id % 3 = 0").select("artifact_id", F.lit("new").alias("term"))
    return dml.replace_mentions(stored.union(stored), new).groupBy("artifact_id", "term").agg(F.count("*").alias("n"))


_EXTRA = "SELECT 'c'||p_partkey AS id, upper(p_name) AS alias, 1 AS pos FROM part UNION ALL SELECT 'c'||p_partkey, lower(p_brand)||' '||p_size, 2 FROM part UNION ALL SELECT 'c'||p_partkey, p_type, 3 FROM part UNION ALL SELECT 'c'||p_partkey, upper(p_type), 4 FROM part UNION ALL SELECT 'x', 'nobody', 5"


@query(w("concept", f"SELECT id, string_agg(alias, '|' ORDER BY pos) AS aliases FROM (SELECT *, row_number() OVER (PARTITION BY id, lower(alias) ORDER BY pos) AS n FROM (SELECT id, alias, 0 AS pos, name FROM concept UNION ALL SELECT e.id, e.alias, e.pos, c.name FROM ({_EXTRA}) e JOIN concept c ON c.id=e.id) WHERE lower(alias)<>lower(name) OR pos=0) WHERE n=1 GROUP BY 1"))
def add_aliases(spark, d):
    p, own = X.table(spark, d, "part"), F.concat(F.lit("c"), "p_partkey").alias("id")
    extra = p.select(own, F.upper("p_name").alias("alias"), F.lit(1).alias("pos")).union(p.select(own, F.concat(F.lower("p_brand"), F.lit(" "), "p_size"), F.lit(2))).union(p.select(own, "p_type", F.lit(3))).union(p.select(own, F.upper("p_type"), F.lit(4)))
    extra = extra.union(p.limit(1).select(F.lit("x"), F.lit("nobody"), F.lit(5)))
    return dml.add_aliases(X.concepts(spark, d), extra).select("id", text("aliases").alias("aliases"))


# --- serving, export, evaluation ------------------------------------------------------------

_RELATED = "both_ways AS (SELECT src_id AS concept_id, dst_id AS other_id FROM rel WHERE confidence>=0.7::DOUBLE UNION SELECT dst_id, src_id FROM rel WHERE confidence>=0.7::DOUBLE)"


@query(w("concept impl artifact rel told", "SELECT 1").replace("\nSELECT 1", f""",
{_RELATED},
f AS (SELECT c.id, c.name, string_agg(a.title,'|' ORDER BY a.title) AS symbols FROM impl JOIN artifact a ON src_id=a.id JOIN concept c ON dst_id=c.id WHERE impl.status IN ('confirmed','proposed') AND starts_with(a.ref,'{PATH}') GROUP BY 1,2),
r AS (SELECT concept_id, string_agg(n,'|' ORDER BY n) AS related FROM (SELECT DISTINCT concept_id, other_id, name AS n FROM both_ways JOIN concept ON id=other_id WHERE definition IS NOT NULL) GROUP BY 1),
t AS (SELECT dst_id, string_agg(title,'|' ORDER BY title) FILTER (WHERE type='constrains') AS rules, string_agg(ref,'|' ORDER BY ref) FILTER (WHERE type='describes') AS docs FROM told WHERE status='confirmed' OR (status='proposed' AND (type='constrains' OR confidence>=0.9::DOUBLE)) GROUP BY 1)
SELECT f.id, f.name, symbols, coalesce(related,'') AS related, coalesce(rules,'') AS rules, coalesce(docs,'') AS docs FROM f LEFT JOIN r ON concept_id=f.id LEFT JOIN t ON t.dst_id=f.id"""))
def code_context(spark, d):
    edges, artifacts = X.told(spark, d)
    names = ["id", "src_id", "dst_id", "type", "confidence", "status"]
    out = serve.code_context(X.concepts(spark, d), X.edges(spark, d).select(names).union(edges.select(names)), X.artifacts(spark, d).unionByName(artifacts), PATH)
    return out.select("id", "name", *(text(c).alias(c) for c in ("symbols", "related", "rules", "docs")))


@query(w("concept told", "SELECT c.id, coalesce(array_to_string(list_slice(list_sort(list_distinct(list(title) FILTER (WHERE type='describes'))),1,40),'|'),'') AS docs, coalesce(string_agg(title,'|' ORDER BY title) FILTER (WHERE type='constrains'),'') AS rules FROM concept c LEFT JOIN told ON dst_id=c.id GROUP BY 1"))
def export_told(spark, d):
    edges, artifacts = X.told(spark, d)
    return export.export_nodes(X.concepts(spark, d), edges, artifacts).select("id", text("docs").alias("docs"), text("rules").alias("rules"))


@query("SELECT 'd'||doc_id AS task, regexp_matches(coalesce(text,''), '[Tt]he \\w+') AND NOT regexp_matches(coalesce(text,''), 'licensed?') AS passed FROM documents")
def check_cells(spark, d):
    cells = X.table(spark, d, "documents").select(F.concat(F.lit("d"), "doc_id").alias("task"), F.lit("a").alias("arm"), F.coalesce("text", F.lit("")).alias("code"), F.lit(r"[Tt]he \w+").alias("fix"), F.lit("licensed?").alias("violation"))
    return evals.check_cells(cells).select("task", "passed")


@query("SELECT CAST((n-1)//12 AS INT) AS batch, string_agg(((n-1)%12+1)||'. [concept: '||concept||'] '||left(body,220), chr(10) ORDER BY n) AS prompt FROM (SELECT *, row_number() OVER (ORDER BY concept, ref, edge_id) AS n FROM (SELECT p_brand AS concept, p_type AS ref, 'e'||p_partkey AS edge_id, repeat(p_name||' ', 12) AS body FROM part)) GROUP BY 1")
def rule_prompts(spark, d):
    p = X.table(spark, d, "part")
    return render.rule_prompts(p.select(F.col("p_brand").alias("concept"), F.col("p_type").alias("ref"), F.concat(F.lit("e"), "p_partkey").alias("edge_id"), F.repeat(F.concat("p_name", F.lit("\n")), F.lit(12)).alias("text")))
