"""The registered queries of the graph engine: each operator on the fixtures, with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import beyond, code, curate, dml, docs, evals, export, gates, serve, usage
from ..operators.ranks import batches, first_per_key
from ..operators.scratch import stored
from ..streaming import usage as windows
from . import fixtures as X
from .fixtures import with_tables as w

QUERIES: dict = {}
SQL: dict[str, str] = {}
PATH = "AFRICA/NATION_1"
BOUNDARY_L, BOUNDARY_R = X.L, X.R
MODAL = f"(?i){X.L}({T.CONSTRAINT_WORDS}){X.R}|({T.CONSTRAINT_STEMS})"
SCHEMA_WORDS = f"(?i){X.L}({T.SCHEMA_TOKENS}){X.R}"


def query(sql: str | None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def text(c):
    """A sorted array as text."""
    return F.array_join(c, "|")


def r6(c):
    return F.round(c, 6)


# --- counts -------------------------------------------------------------------------------


@query(w("concept artifact edge", "SELECT 'concepts' AS \"table\", count(*) AS n FROM concept UNION ALL SELECT 'artifacts', count(*) FROM artifact UNION ALL SELECT 'mentions', count(*) FROM documents UNION ALL SELECT 'edges', count(*) FROM edge"))
def graph_counts(spark, d):
    return export.table_counts(X.concepts(spark, d), X.artifacts(spark, d), X.table(spark, d, "documents"), X.edges(spark, d))


@query(w("edge", "SELECT status AS key, count(*) AS n FROM edge GROUP BY 1"))
def edge_status_counts(spark, d):
    return export.edge_counts_by(X.edges(spark, d), "status")


@query(w("edge", "SELECT type AS key, count(*) AS n FROM edge GROUP BY 1"))
def edge_type_counts(spark, d):
    return export.edge_counts_by(X.edges(spark, d), "type")


@query("SELECT normalized, count(*) AS n FROM (SELECT array_to_string(list_filter(regexp_split_to_array(lower(regexp_replace(regexp_replace(l, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '[_\\-./:]+', ' ', 'g')), '\\s+'), lambda t: length(t)>1 AND NOT regexp_matches(t, '^\\d+$') AND t NOT IN (" + ", ".join(f"'{x}'" for x in T.STOPWORDS) + ")), ' ') AS normalized, l FROM (SELECT unnest(string_split(coalesce(text,''), ' ')) AS l FROM documents)) WHERE normalized<>'' AND length(l) BETWEEN 2 AND 80 GROUP BY 1 ORDER BY n DESC, normalized LIMIT 30")
def top_terms(spark, d):
    words = X.table(spark, d, "documents").select(F.explode(F.split(F.coalesce("text", F.lit("")), " ")).alias("term"))
    return export.top_terms(words.select(T.mention_term("term").alias("normalized")).where("normalized is not null"))


@query(w("concept", "SELECT coalesce(nullif(trim(bounded_context),''),'(no context)') AS context, count(*) AS n FROM concept WHERE coalesce(trim(definition),'')<>'' GROUP BY 1"))
def context_legend(spark, d):
    return export.context_legend(X.concepts(spark, d))


# --- mutations ----------------------------------------------------------------------------


@query(w("impl", "SELECT src_id, dst_id, round(confidence,6) AS confidence, status FROM impl"))
def edge_upsert_last_wins(spark, d):
    return X.implements(spark, d).select("src_id", "dst_id", r6("confidence").alias("confidence"), "status")


@query("SELECT 'o'||o_custkey AS ref, arg_min(o_orderpriority, (o_orderdate, o_orderkey)) AS kind, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS title FROM orders GROUP BY 1")
def artifact_upsert_first_kind(spark, d):
    o = X.table(spark, d, "orders")
    delta = o.select(F.lit("code").alias("source"), F.concat(F.lit("o"), "o_custkey").alias("ref"), F.col("o_orderpriority").alias("kind"), F.col("o_orderstatus").alias("title"), F.struct("o_orderdate", "o_orderkey").alias("_seq"))
    return dml.upsert_artifacts(delta).select("ref", "kind", "title")


@query(w("edge", "SELECT type, count(*) FILTER (WHERE status='confirmed' OR (status='proposed' AND confidence >= CASE type WHEN 'describes' THEN 0.9::DOUBLE WHEN 'relates' THEN 0.7::DOUBLE WHEN 'implements' THEN 0.0::DOUBLE WHEN 'constrains' THEN 0.0::DOUBLE END)) AS served, count(*) AS n FROM edge GROUP BY 1"))
def gate_served_by_type(spark, d):
    e = X.edges(spark, d)
    return e.groupBy("type").agg(F.count_if(gates.served(gates.bar_of_type())).alias("served"), F.count("*").alias("n"))


@query(w("impl", "SELECT dst_id, CASE WHEN status='proposed' AND confidence>=0.8::DOUBLE THEN 'confirmed' ELSE status END AS status, count(*) AS n FROM impl GROUP BY 1,2"))
def confirm_above(spark, d):
    return dml.confirm_above(X.implements(spark, d), 0.8, "implements").groupBy("dst_id", "status").agg(F.count("*").alias("n"))


@query(w("impl", "SELECT src_id, dst_id, CASE WHEN length(src_id)%2=0 AND confidence<0.8::DOUBLE THEN 'rejected' ELSE status END AS status FROM impl"))
def set_edge_status(spark, d):
    e = X.implements(spark, d)
    decisions = e.where((F.length("src_id") % 2 == 0) & (F.col("confidence") < 0.8)).select("id", F.lit("rejected").alias("status"))
    return dml.set_status(e, decisions).select("src_id", "dst_id", "status")


@query(w("concept impl", "SELECT (SELECT count(*) FROM concept WHERE bounded_context<>'Brand#11') AS concepts, count(*) AS edges, round(sum(confidence),4) AS confidence FROM impl JOIN concept ON dst_id=id WHERE bounded_context<>'Brand#11'"))
def delete_concept_cascade(spark, d):
    c, e = X.concepts(spark, d), X.implements(spark, d)
    kept, left = dml.delete_concepts(c, e, c.where("bounded_context = 'Brand#11'"))
    return left.agg(F.count("*").alias("edges"), F.round(F.sum("confidence"), 4).alias("confidence"), F.lit(0).alias("_k")).join(kept.agg(F.count("*").alias("concepts"), F.lit(0).alias("_k")), "_k").select("concepts", "edges", "confidence")


@query(w("artifact impl", "SELECT 'artifacts' AS t, count(*) AS n FROM artifact WHERE split_part(ref,'#',1) NOT LIKE '%/f3.go' UNION ALL SELECT 'edges', count(*) FROM impl JOIN artifact ON src_id=id WHERE split_part(ref,'#',1) NOT LIKE '%/f3.go'"))
def delete_file_artifacts(spark, d):
    a, e = X.artifacts(spark, d), X.implements(spark, d)
    paths = a.select(T.file_of("ref").alias("path")).where("path like '%/f3.go'").distinct()
    mentions = a.select(F.col("id").alias("artifact_id"))
    left, edges, _ = dml.delete_file_artifacts(a, e, mentions, paths)
    return left.agg(F.count("*").alias("n")).select(F.lit("artifacts").alias("t"), "n").union(edges.agg(F.count("*").alias("n")).select(F.lit("edges"), "n"))


@query(w("prev cur", "SELECT coalesce(p.path,c.path) AS path, CASE WHEN p.path IS NULL THEN 'new' WHEN c.path IS NULL THEN 'gone' WHEN p.mtime=c.mtime THEN 'unchanged' ELSE 'changed' END AS state FROM prev p FULL JOIN cur c ON p.path=c.path"))
def incremental_diff(spark, d):
    return dml.diff_files(X.stored_files(spark, d), X.listed_files(spark, d)).select("path", "state")


@query(w("prev cur", "SELECT p.path FROM prev p LEFT JOIN cur c ON p.path=c.path WHERE c.path IS NULL OR p.mtime<>c.mtime"))
def stale_files(spark, d):
    return dml.stale_files(X.stored_files(spark, d), X.listed_files(spark, d))


# --- serving ------------------------------------------------------------------------------

_SERVED_IMPL = "(impl.status='confirmed' OR impl.status='proposed')"


@query(w("concept impl artifact", f"SELECT c.id, c.name, string_agg(a.title,'|' ORDER BY a.title) AS symbols FROM impl JOIN artifact a ON src_id=a.id JOIN concept c ON dst_id=c.id WHERE {_SERVED_IMPL} AND starts_with(a.ref,'{PATH}') GROUP BY 1,2"))
def concepts_for_path(spark, d):
    return serve.concepts_for_path(X.concepts(spark, d), X.implements(spark, d), X.artifacts(spark, d), PATH).select("id", "name", text("symbols").alias("symbols"))


@query(w("concept impl artifact", f"SELECT c.id, string_agg(a.title,'|' ORDER BY a.title) AS symbols FROM impl JOIN artifact a ON src_id=a.id JOIN concept c ON dst_id=c.id WHERE {_SERVED_IMPL} AND lower(a.ref) LIKE 'africa/nation_1%' GROUP BY 1"))
def concepts_for_path_wildcards(spark, d):
    return serve.concepts_for_path(X.concepts(spark, d), X.implements(spark, d), X.artifacts(spark, d), PATH, strict=False).select("id", text("symbols").alias("symbols"))


@query(w("impl artifact", f"SELECT dst_id AS concept_id, split_part(ref,'#',1) AS file, string_agg(DISTINCT title,'|' ORDER BY title) AS symbols FROM impl JOIN artifact a ON src_id=a.id WHERE {_SERVED_IMPL} GROUP BY 1,2"))
def implementers_by_file(spark, d):
    return serve.implementers_by_file(X.implements(spark, d), X.artifacts(spark, d)).withColumn("symbols", text("symbols"))


@query(w("impl artifact", f"SELECT dst_id AS concept_id, count(*) AS n, min(ref) AS first_ref, max(ref) AS last_ref FROM impl JOIN artifact a ON src_id=a.id WHERE {_SERVED_IMPL} GROUP BY 1"))
def implementers_of(spark, d):
    return serve.implementers_of(X.implements(spark, d), X.artifacts(spark, d)).groupBy("concept_id").agg(F.count("*").alias("n"), F.min("ref").alias("first_ref"), F.max("ref").alias("last_ref"))


_RELATED = "both_ways AS (SELECT src_id AS concept_id, dst_id AS other_id, confidence FROM rel WHERE confidence>=0.7::DOUBLE UNION SELECT dst_id, src_id, confidence FROM rel WHERE confidence>=0.7::DOUBLE)"


@query(w("concept rel", "SELECT 1").replace("\nSELECT 1", f",\n{_RELATED}\nSELECT concept_id, other_id, name AS other_name, round(max(confidence),6) AS confidence FROM both_ways JOIN concept ON id=other_id WHERE definition IS NOT NULL GROUP BY 1,2,3"))
def related_concepts(spark, d):
    return serve.related_concepts(X.concepts(spark, d), X.relates(spark, d)).withColumn("confidence", r6("confidence"))


@query(w("concept rel", "SELECT 1").replace("\nSELECT 1", f",\n{_RELATED}\nSELECT concept_id, other_id, name AS other_name, round(confidence,6) AS confidence FROM both_ways JOIN concept ON id=other_id WHERE definition IS NOT NULL"))
def related_union_compat(spark, d):
    return serve.related_concepts(X.concepts(spark, d), X.relates(spark, d), union=True).withColumn("confidence", r6("confidence"))


_CALLS = "SELECT DISTINCT s.ref AS src_ref, t.ref AS dst_ref FROM call JOIN artifact s ON src_id=s.id JOIN artifact t ON dst_id=t.id WHERE status<>'rejected' AND "


@query(w("call artifact", f"{_CALLS} starts_with(s.ref,'ASIA/NATION_2') ORDER BY 1,2 LIMIT 40"))
def calls_out(spark, d):
    return serve.calls_from_path(X.calls(spark, d), X.artifacts(spark, d), "ASIA/NATION_2")


@query(w("call artifact", f"{_CALLS} starts_with(t.ref,'{PATH}') AND NOT starts_with(s.ref,'{PATH}') ORDER BY 1,2 LIMIT 40"))
def calls_in(spark, d):
    return serve.calls_into_path(X.calls(spark, d), X.artifacts(spark, d), PATH)


@query(w("concept", "SELECT term, coalesce((SELECT min(id) FROM concept WHERE name=term), (SELECT min(id) FROM concept WHERE lower(alias)=lower(term))) AS concept_id FROM (SELECT DISTINCT p_name AS term FROM part UNION SELECT DISTINCT lower(p_brand)||' '||p_size FROM part UNION SELECT DISTINCT p_type FROM part)"))
def resolve_concept(spark, d):
    p = X.table(spark, d, "part")
    terms = p.select(F.col("p_name").alias("term")).union(p.select(F.concat(F.lower("p_brand"), F.lit(" "), "p_size"))).union(p.select("p_type")).distinct()
    return serve.resolve_terms(X.concepts(spark, d), terms)


@query(w("concept", "SELECT id, name, definition FROM concept WHERE contains(lower(name),'an') OR contains(lower(definition),'an') OR contains(lower(alias),'an') ORDER BY coalesce(trim(definition),'')<>'' DESC, length(name), name, id LIMIT 20"))
def search_concepts(spark, d):
    return serve.search_concepts(X.concepts(spark, d), "AN").select("id", "name", "definition")


@query(w("concept", "SELECT id, name FROM concept WHERE name=(SELECT min(name) FROM concept) ORDER BY id LIMIT 1"))
def find_concept(spark, d):
    c = X.concepts(spark, d)
    return serve.find_concept(c, c.agg(F.min("name")).first()[0]).select("id", "name")


@query(w("concept impl artifact", """, o AS (SELECT c.id, c.name, a.title, a.ref, a.id AS aid, regexp_extract(a.ref,'^(.*)/',1) AS dir FROM concept c JOIN impl ON dst_id=c.id JOIN artifact a ON src_id=a.id WHERE c.definition IS NULL),
s AS (SELECT id, name, string_agg(title,'|' ORDER BY ref, aid) AS symbols FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ref, aid) AS n FROM o) WHERE n<=12 GROUP BY 1,2),
g AS (SELECT id, string_agg(dir,'|' ORDER BY dir) AS directories FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dir) AS n FROM (SELECT DISTINCT id, dir FROM o WHERE dir<>'')) WHERE n<=4 GROUP BY 1)
SELECT s.id, name, symbols, coalesce(directories,'') AS directories FROM s LEFT JOIN g USING (id)""").replace(")\n, o AS", "),\no AS"))
def candidate_concepts(spark, d):
    out = serve.candidate_concepts(X.concepts(spark, d), X.implements(spark, d), X.artifacts(spark, d))
    return out.select("id", "name", text("symbols").alias("symbols"), text("directories").alias("directories"))


@query(w("concept impl artifact", "SELECT src_id, dst_id, round(confidence,6) AS confidence, coalesce('concept '||c1.name, 'code_symbol '||a1.title, src_id) AS src_label, coalesce('concept '||c2.name, 'code_symbol '||a2.title, dst_id) AS dst_label FROM (SELECT * FROM impl WHERE status='proposed' ORDER BY confidence DESC, src_id, dst_id LIMIT 50) LEFT JOIN concept c1 ON src_id=c1.id LEFT JOIN artifact a1 ON src_id=a1.id LEFT JOIN concept c2 ON dst_id=c2.id LEFT JOIN artifact a2 ON dst_id=a2.id"))
def proposed_edges_labeled(spark, d):
    out = serve.proposed_edges(X.implements(spark, d), X.concepts(spark, d), X.artifacts(spark, d))
    return out.select("src_id", "dst_id", r6("confidence").alias("confidence"), "src_label", "dst_label")


# --- merging ------------------------------------------------------------------------------

_NORM = "CASE WHEN length(n)<=3 OR n LIKE '%ss' THEN n WHEN n LIKE '%ies' THEN left(n,length(n)-3)||'y' WHEN regexp_matches(n,'(ses|xes|zes|ches|shes)$') THEN left(n,length(n)-2) WHEN n LIKE '%s' THEN left(n,length(n)-1) ELSE n END"
_DEDUPE = f""",
k AS (SELECT c.*, {_NORM.replace('n LIKE', 'lower(trim(name)) LIKE').replace('length(n)', 'length(lower(trim(name)))').replace('left(n,', 'left(lower(trim(name)),').replace('(n,', '(lower(trim(name)),').replace('THEN n ', 'THEN lower(trim(name)) ').replace('ELSE n ', 'ELSE lower(trim(name)) ')} AS norm_key, (SELECT count(*) FROM impl WHERE dst_id=c.id) AS ne FROM concept c),
rk AS (SELECT *, first_value(id) OVER w AS survivor, count(*) OVER (PARTITION BY norm_key) AS members FROM k WINDOW w AS (PARTITION BY norm_key ORDER BY CASE WHEN coalesce(trim(definition),'')<>'' THEN 0 ELSE 1 END, ne DESC, length(name), id)),
mp AS (SELECT id, survivor, norm_key, alias, name FROM rk WHERE members>1 AND id<>survivor)
"""


def _dedupe(select: str) -> str:
    return w("concept impl", "SELECT 1").replace("\nSELECT 1", _DEDUPE + select)


@query(_dedupe("SELECT norm_key, count(*) AS n FROM k GROUP BY 1 HAVING count(*)>1"))
def dedupe_groups(spark, d):
    return curate.dedupe_groups(X.concepts(spark, d))


@query(_dedupe("SELECT id, survivor FROM mp"))
def dedupe_survivors(spark, d):
    return curate.dedupe_mapping(X.concepts(spark, d), X.implements(spark, d)).select("id", "survivor")


@query(_dedupe("SELECT src_id, dst_id, round(confidence,6) AS confidence, status FROM (SELECT src_id, coalesce(survivor,dst_id) AS dst_id, confidence, status, row_number() OVER (PARTITION BY src_id, coalesce(survivor,dst_id) ORDER BY survivor IS NOT NULL, confidence DESC, src_id||'>'||i.dst_id) AS n FROM impl i LEFT JOIN mp ON i.dst_id=mp.id) WHERE n=1"))
def dedupe_repointed_edges(spark, d):
    e = X.implements(spark, d)
    return curate.repoint_edges(e, curate.dedupe_mapping(X.concepts(spark, d), e)).select("src_id", "dst_id", r6("confidence").alias("confidence"), "status")


@query(_dedupe("SELECT survivor AS id, count(DISTINCT a) AS n_aliases, md5(string_agg(DISTINCT a,'|' ORDER BY a)) AS digest FROM (SELECT survivor, alias AS a FROM mp UNION ALL SELECT survivor, name FROM mp UNION ALL SELECT id, alias FROM concept WHERE id IN (SELECT survivor FROM mp)) x JOIN concept c ON c.id=x.survivor WHERE a<>c.name GROUP BY 1").replace("survivor AS id", "x.survivor AS id").replace("(SELECT survivor, alias AS a", "(SELECT mp.survivor, mp.alias AS a"))
def dedupe_aliases(spark, d):
    c = X.concepts(spark, d)
    out = curate.folded_aliases(c, curate.dedupe_mapping(c, X.implements(spark, d)))
    return out.select("id", F.size("aliases").cast("long").alias("n_aliases"), F.md5(F.array_join(F.array_sort("aliases"), "|").cast("binary")).alias("digest"))


# --- text functions -----------------------------------------------------------------------


@query("SELECT p_partkey, array_to_string(list_filter(regexp_split_to_array(lower(regexp_replace(regexp_replace(x, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '[_\\-./:]+', ' ', 'g')), '\\s+'), lambda t: length(t)>1 AND NOT regexp_matches(t, '^\\d+$')), ' ') AS normalized FROM (SELECT p_partkey, 'get'||replace(p_name,' ','_')||'.'||p_brand||':a/'||p_size||'FooBar' AS x FROM part)")
def split_identifier(spark, d):
    x = F.concat(F.lit("get"), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("."), "p_brand", F.lit(":a/"), "p_size", F.lit("FooBar"))
    return X.table(spark, d, "part").select("p_partkey", T.normalize(x).alias("normalized"))


@query("SELECT p_partkey, coalesce(nullif(left(regexp_replace(regexp_replace(lower(p_name||' / '||p_type||'!'), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 60), ''), 'section') AS slug FROM part")
def slug(spark, d):
    return X.table(spark, d, "part").select("p_partkey", T.slug(F.concat("p_name", F.lit(" / "), "p_type", F.lit("!"))).alias("slug"))


@query("SELECT s, " + _NORM.replace("n LIKE", "s LIKE").replace("length(n)", "length(s)").replace("left(n,", "left(s,").replace("(n,", "(s,").replace("THEN n ", "THEN s ").replace("ELSE n ", "ELSE s ") + " AS norm_key FROM (SELECT DISTINCT lower(x) AS s FROM (SELECT unnest(string_split(p_name||' '||p_type,' ')) AS x FROM part) UNION SELECT unnest(['statuses','status','databases','policies','boxes','pass','tests','is']))")
def norm_key(spark, d):
    words = X.table(spark, d, "part").select(F.explode(F.split(F.lower(F.concat_ws(" ", "p_name", "p_type")), " ")).alias("s"))
    more = spark.createDataFrame([(x,) for x in ("statuses", "status", "databases", "policies", "boxes", "pass", "tests", "is")], "s string")
    return words.union(more).distinct().select("s", T.normal_key("s").alias("norm_key"))


_LABEL_DIRS = ", ".join(f"'{x}'" for x in T.GENERIC_DIRS)


_LABEL_SQL = f"""SELECT s_suppkey, upper(left(l,1))||substr(l,2) AS label FROM (
  SELECT s_suppkey, coalesce(list_filter(list_reverse(list_slice(p,1,len(p)-1)), lambda x: trim(x)<>'' AND lower(x) NOT IN ({_LABEL_DIRS}))[1],
    CASE WHEN trim(stem)<>'' AND lower(stem) NOT IN ({_LABEL_DIRS}) THEN stem END, 'Misc') AS l FROM (
    SELECT *, regexp_replace(p[-1], '\\.[^.]*$', '') AS stem FROM (
      SELECT s_suppkey, string_split(CASE s_suppkey%5 WHEN 0 THEN 'src/'||lower(replace(s_name,'#','_'))||'/api/x.go' WHEN 1 THEN 'src/lib/'||replace(s_name,'#','_')||'.go'
        WHEN 2 THEN 'app/feature'||s_suppkey||'/model/t.kt' WHEN 3 THEN 'src/lib/Util.ts' ELSE 'main.go' END, '/') AS p FROM supplier)))"""


@query(_LABEL_SQL)
def cluster_label(spark, d):
    k, name = F.col("s_suppkey") % 5, F.replace("s_name", F.lit("#"), F.lit("_"))
    ref = F.when(k == 0, F.concat(F.lit("src/"), F.lower(name), F.lit("/api/x.go"))).when(k == 1, F.concat(F.lit("src/lib/"), name, F.lit(".go")))
    ref = ref.when(k == 2, F.concat(F.lit("app/feature"), "s_suppkey", F.lit("/model/t.kt"))).when(k == 3, F.lit("src/lib/Util.ts")).otherwise(F.lit("main.go"))
    return X.table(spark, d, "supplier").select("s_suppkey", T.cluster_label(F.concat(ref, F.lit("#f"))).alias("label"))


@query("SELECT page_id, coalesce(nullif(string_split(regexp_replace(split_part(url,'?',1),'/+$',''),'/')[-1],''), url) AS name FROM pages")
def page_name(spark, d):
    return X.table(spark, d, "pages").select("page_id", T.page_name("url").alias("name"))


@query("SELECT s_suppkey, CASE s_suppkey%5 WHEN 0 THEN '[go]' WHEN 1 THEN '[ts]' WHEN 2 THEN '[kt]' WHEN 3 THEN '[py]' ELSE '[..]' END AS tag FROM supplier")
def lang_tag(spark, d):
    ext = F.element_at(F.array(*[F.lit(x) for x in (".go", ".tsx", ".kts", ".py", ".md")]), (F.col("s_suppkey") % 5 + 1).cast("int"))
    return X.table(spark, d, "supplier").select("s_suppkey", T.language_tag(F.concat("s_name", ext)).alias("tag"))


def html_sql() -> str:
    s = "html"
    for tag in ("script", "style", "noscript", "head"):
        s = f"regexp_replace({s}, '(?is)<{tag}[^>]*>.*?</{tag}>', ' ', 'g')"
    for level in range(1, 7):
        s = f"regexp_replace({s}, '(?is)<h{level}[^>]*>(.*?)</h{level}>', chr(10)||'{'#' * level} \\1'||chr(10), 'g')"
    s = f"regexp_replace(regexp_replace({s}, '(?i)<li[^>]*>', chr(10)||'- ', 'g'), '(?i)</(p|div|section|article|tr|li|h[1-6])>|<br\\s*/?>', chr(10), 'g')"
    s = f"regexp_replace({s}, '<[^>]+>', '', 'g')"
    for entity, char in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&apos;", "''")):
        s = f"replace({s}, '{entity}', '{char}')"
    return f"SELECT page_id, CASE WHEN contains(html, '<') THEN regexp_replace(regexp_replace({s}, '\\n{{3,}}', chr(10)||chr(10), 'g'), '^\\s+|\\s+$', '', 'g') ELSE html END AS content FROM pages"


@query(html_sql())
def html_to_text(spark, d):
    return X.table(spark, d, "pages").select("page_id", T.html_to_text("html").alias("content"))


# --- documents ----------------------------------------------------------------------------

_SENTENCES = "s AS (SELECT ref, pos, regexp_replace(regexp_replace(regexp_replace(regexp_replace(raw,'^\\s+|\\s+$','','g'),'^[-*•> \\t]+|[-*•> \\t]+$','','g'),'\\s+',' ','g'),'^$','') AS rule FROM (SELECT ref, unnest(l) AS raw, generate_subscripts(l,1) AS pos FROM (SELECT ref, string_split_regex(regexp_replace(body,'([.!?])\\s+','\\1'||chr(10),'g'),'\\n+') AS l FROM section)))"
_IS_RULE = f"length(rule) BETWEEN 12 AND 240 AND regexp_matches(rule,'{MODAL}') AND NOT contains(rule,'|') AND NOT contains(rule,'://') AND length(rule)-length(replace(rule,'`',''))<4 AND NOT (contains(rule,'=') AND regexp_matches(rule,'{SCHEMA_WORDS}'))"


@query(w("section", f"SELECT 1").replace("\nSELECT 1", f",\n{_SENTENCES}\nSELECT rule, count(*) AS n FROM s WHERE {_IS_RULE} GROUP BY 1"))
def prose_rules(spark, d):
    s = X.sections(spark, d).select(F.explode(T.sentences("body")).alias("rule"))
    return s.where(T.is_prose_rule("rule")).groupBy("rule").agg(F.count("*").alias("n"))


@query(w("section", f"SELECT 1").replace("\nSELECT 1", f",\n{_SENTENCES},\nu AS (SELECT ref, rule, min(pos) AS pos FROM s WHERE {_IS_RULE} GROUP BY 1,2)\nSELECT ref, n-1 AS pos, rule FROM (SELECT ref, rule, row_number() OVER (PARTITION BY ref ORDER BY pos) AS n FROM u) WHERE n<=3"))
def rules_top3_per_section(spark, d):
    return X.rules(spark, d).select("ref", F.col("pos").cast("long").alias("pos"), "rule")


@query(w("hit", "SELECT ref, concept_id, heading_hit FROM hit"))
def dictionary_match(spark, d):
    return X.matches(spark, d).select("ref", "concept_id", "heading_hit")


@query(w("hit", "SELECT ref, concept_id, CASE WHEN heading_hit THEN 0.9::DOUBLE ELSE 0.6::DOUBLE END AS confidence FROM hit"))
def describes_edges(spark, d):
    s = X.sections(spark, d).withColumn("section", F.col("ref"))
    return docs.describes_edges(X.matches(spark, d), s).select(F.col("section").alias("ref"), "concept_id", "confidence")


@query(w("hit", "SELECT a.concept_id AS low, b.concept_id AS high, count(*) AS n, least(0.9::DOUBLE, 0.3::DOUBLE+count(*)*0.1::DOUBLE) AS confidence FROM hit a JOIN hit b ON a.ref=b.ref AND a.concept_id<b.concept_id GROUP BY 1,2 HAVING count(*)>=2"))
def cooccurrence_relates(spark, d):
    return docs.cooccurrences(X.matches(spark, d))


_GENERIC = ", ".join(f"'{g}'" for g in T.GENERIC_HEADINGS)


@query(w("hit", f"SELECT DISTINCT concept_id AS id, h AS alias FROM (SELECT concept_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(heading,'^\\s*\\d+[.)]\\s*',''),'^\\s+|\\s+$','','g'),':+$',''),'^\\s+|\\s+$','','g') AS h FROM hit JOIN section USING (ref) WHERE heading_hit) WHERE h<>'' AND length(h)<=50 AND len(regexp_split_to_array(h,'\\s+'))<=6 AND lower(h) NOT IN ({_GENERIC}) AND NOT regexp_matches(h,'[`|#(]')"))
def heading_aliases(spark, d):
    return docs.heading_aliases(X.matches(spark, d), X.sections(spark, d)).select("id", "alias").distinct()


@query(w("hit", "SELECT concept_id, ref, title, 0.9::DOUBLE AS confidence FROM (SELECT concept_id, ref, heading AS title FROM hit JOIN section USING (ref) WHERE heading_hit)"))
def describing_docs(spark, d):
    s = X.sections(spark, d)
    e = docs.describes_edges(X.matches(spark, d), s.withColumn("section", F.col("ref"))).select(F.col("section").alias("src_id"), F.col("concept_id").alias("dst_id"), F.lit("describes").alias("type"), "confidence", F.lit("proposed").alias("status"))
    a = s.select(F.col("ref").alias("id"), F.lit("doc").alias("kind"), "ref", F.col("heading").alias("title"))
    return serve.describing_docs(e, a)


_RULED = f",\n{_SENTENCES},\nu AS (SELECT ref, rule, min(pos) AS pos FROM s WHERE {_IS_RULE} GROUP BY 1,2),\nt3 AS (SELECT ref, rule FROM (SELECT ref, rule, row_number() OVER (PARTITION BY ref ORDER BY pos) AS n FROM u) WHERE n<=3),\ncon AS (SELECT DISTINCT rule, concept_id FROM t3 JOIN hit USING (ref))\n"


def _rule_graph(spark, d):
    own = X.rules(spark, d).join(X.matches(spark, d).select("ref", "concept_id"), "ref").select("rule", "concept_id").distinct()
    own = stored(own, "rules-of-concepts")  # edges, artifacts and candidates are made of it
    e = own.select(F.concat_ws(">", "rule", "concept_id").alias("id"), F.col("rule").alias("src_id"), F.col("concept_id").alias("dst_id"), F.lit("constrains").alias("type"), F.lit(0.6).alias("confidence"), F.lit("proposed").alias("status"))
    a = own.select("rule").distinct().select(F.col("rule").alias("id"), F.lit("rule").alias("kind"), T.rule_ref("rule").alias("ref"), F.substring("rule", 1, 160).alias("title"), F.col("rule").alias("body"))
    return e, a


@query(w("hit", "SELECT 1").replace("\nSELECT 1", _RULED + "SELECT concept_id, left(rule,160) AS title, 0.6::DOUBLE AS confidence FROM con"))
def rules_for(spark, d):
    e, a = _rule_graph(spark, d)
    return serve.rules_for(e, a).select("concept_id", "title", "confidence")


@query(w("hit", "SELECT 1").replace("\nSELECT 1", _RULED + "SELECT rule AS text, CASE concept_id " + " ".join(f"WHEN '{i}' THEN '{n}'" for i, n, _ in X.VOCABULARY) + " END AS concept FROM con"))
def candidate_rules(spark, d):
    e, a = _rule_graph(spark, d)
    return serve.candidate_rules(e, a, X.vocabulary(spark), limit=None).select("text", "concept")


@query(w("hit", "SELECT 1").replace("\nSELECT 1", _RULED + f"SELECT title, min(concept_id) AS concept FROM (SELECT left(rule,160) AS title, concept_id FROM con) WHERE length(title) BETWEEN 20 AND 160 AND regexp_matches(title,'{MODAL}') GROUP BY 1"))
def rule_seeds(spark, d):
    e, a = _rule_graph(spark, d)
    return evals.rule_seeds(serve.rules_for(e, a).select("title", F.col("concept_id").alias("concept")))


@query(w("hit", "SELECT 1").replace("\nSELECT 1", _RULED + "SELECT rule, concept_id, CASE WHEN id%3=0 THEN 'rejected' WHEN id%5=0 THEN 'proposed' ELSE 'confirmed' END AS status FROM (SELECT rule, concept_id, (row_number() OVER (ORDER BY concept_id, rule, concept_id)-1)%12+1 AS id FROM con)"))
def refine_apply(spark, d):
    e, a = _rule_graph(spark, d)
    candidates = e.select(F.col("id").alias("edge_id"), F.col("src_id").alias("rule_id"), F.col("dst_id").alias("concept"), F.col("src_id").alias("ref"), F.col("src_id").alias("text"))
    verdicts = batches(candidates, [], [F.col("concept"), F.col("ref"), F.col("edge_id")], 12).where("id % 3 = 0 or id % 5 <> 0").select("batch", "id", (F.col("id") % 3 != 0).alias("keep"), F.lit("").alias("refined"))
    edges, _ = curate.refine_rules(e, a, candidates, verdicts)
    return edges.select(F.col("src_id").alias("rule"), F.col("dst_id").alias("concept_id"), "status")


# --- code, curation, export ---------------------------------------------------------------


@query(w("artifact module", "SELECT ref, coalesce(upper(left(m,1))||substr(m,2), split_part(ref,'/',1)) AS module FROM (SELECT ref, (SELECT arg_max(name, length(path)) FROM module WHERE starts_with(split_part(ref,'#',1), path)) AS m FROM artifact)"))
def longest_prefix_module(spark, d):
    files = X.artifacts(spark, d).select("ref", T.file_of("ref").alias("file"))
    return code.longest_prefix_module(files, X.modules(spark, d)).select("ref", "module")


@query(w("artifact call", "SELECT kind, layer, count(*) AS n FROM (SELECT DISTINCT 'code_symbol' AS kind, 'code' AS layer, ref FROM artifact UNION ALL SELECT DISTINCT 'file', 'code', split_part(ref,'#',1) FROM artifact) GROUP BY 1,2 UNION ALL SELECT 'implements', 'inferred', count(DISTINCT ref) FROM artifact UNION ALL SELECT 'calls', 'deterministic', count(*) FROM (SELECT DISTINCT s.ref, t.ref FROM call JOIN artifact s ON src_id=s.id JOIN artifact t ON dst_id=t.id WHERE status<>'rejected') UNION ALL SELECT 'concepts', '', count(DISTINCT split_part(ref,'/',1)) FROM artifact"))
def codegraph_ingest(spark, d):
    a = X.artifacts(spark, d)
    communities = a.groupBy(F.substring_index("ref", "/", 1).alias("label"), T.file_of("ref").alias("file")).agg(F.collect_list(F.struct(F.lit("func").alias("kind"), F.col("title").alias("name"), T.file_of("ref").alias("file"))).alias("members"))
    ends = serve.calls(X.calls(spark, d), a)
    head = (F.lit("shop").alias("repo"), F.lit("codegraph").alias("source"))
    exports = communities.select(*head, F.array(F.struct("label", "members")).alias("communities"), F.lit(None).cast("array<struct<from:string,to:string>>").alias("calls"))
    exports = exports.unionByName(ends.select(*head, F.lit(None).cast("array<struct<label:string,members:array<struct<kind:string,name:string,file:string>>>>").alias("communities"), F.array(F.struct(F.col("src_ref").alias("from"), F.col("dst_ref").alias("to"))).alias("calls")))
    artifacts, names, edges = code.code_graph(exports)
    n = F.count("*").alias("n")
    return artifacts.groupBy("kind", "layer").agg(n).union(edges.groupBy("type", "source").agg(n)).union(names.agg(n).select(F.lit("concepts"), F.lit(""), "n"))


@query(w("concept impl", "SELECT 1").replace("\nSELECT 1", ",\nv AS (SELECT id, name, length(name)%3 AS k FROM concept WHERE definition IS NULL)\nSELECT c.id, CASE WHEN k=1 THEN upper(c.name) ELSE c.name END AS name, CASE WHEN k=1 THEN 'about '||c.name ELSE c.definition END AS definition, (SELECT count(*) FROM impl WHERE dst_id=c.id) AS edges FROM concept c LEFT JOIN v USING (id) WHERE k IS NULL OR k<>2"))
def canonicalize_apply(spark, d):
    c, e = X.concepts(spark, d), X.implements(spark, d)
    open_ = c.where("definition is null").select("id", "name")
    k = F.length("name") % 3
    verdicts = open_.select("name").distinct().where(k > 0).select(F.col("name").alias("cluster"), (k == 1).alias("keep"), F.lit(0.9).alias("confidence"), F.upper("name").alias("name"), F.concat(F.lit("about "), "name").alias("definition"), F.lit("").alias("bounded_context"), F.array().cast("array<string>").alias("aliases"), F.lit(0).alias("pos"))
    kept, edges = curate.canonicalize(c, e, open_, verdicts)
    return curate.edge_counts(kept, edges).select("id", "name", "definition", F.col("n").alias("edges"))


@query(w("concept impl artifact", "SELECT c.id, c.name, coalesce(trim(c.definition),'')<>'' AS resolved, count(a.id) AS symbols, CAST(count(DISTINCT split_part(a.ref,'#',1)) AS INT) AS n_files, coalesce(array_to_string(list_slice(list_sort(list_distinct(list(split_part(a.ref,'#',1)) FILTER (WHERE a.ref IS NOT NULL))),1,60),'|'),'') AS files FROM concept c LEFT JOIN impl ON dst_id=c.id LEFT JOIN artifact a ON src_id=a.id GROUP BY 1,2,3"))
def export_nodes(spark, d):
    out = export.export_nodes(X.concepts(spark, d), X.implements(spark, d), X.artifacts(spark, d))
    return out.select("id", "name", "resolved", "symbols", F.greatest("n_files", F.lit(0)).alias("n_files"), text("files").alias("files"))


@query(w("concept rel", "SELECT src_id, dst_id, round(confidence,6) AS confidence FROM rel JOIN concept a ON a.id=src_id JOIN concept b ON b.id=dst_id WHERE a.definition IS NOT NULL AND b.definition IS NOT NULL"))
def export_links(spark, d):
    return export.export_links(X.concepts(spark, d), X.relates(spark, d), resolved_only=True).select("src_id", "dst_id", r6("confidence").alias("confidence"))


@query(w("rel", "SELECT id, count(DISTINCT o) AS related FROM (SELECT src_id AS id, dst_id AS o FROM rel UNION ALL SELECT dst_id, src_id FROM rel) GROUP BY 1"))
def related_degrees(spark, d):
    return export.degrees(X.relates(spark, d))


@query(w("concept impl", "SELECT c.id, count(i.src_id) AS n FROM concept c LEFT JOIN impl i ON i.dst_id=c.id GROUP BY 1"))
def concept_edge_counts(spark, d):
    return curate.edge_counts(X.concepts(spark, d), X.implements(spark, d)).select("id", "n")


# --- usage and evaluation -----------------------------------------------------------------


@query(w("use", "SELECT count(*) AS events, strftime(min(ts),'%Y-%m-%d') AS first_day, strftime(max(ts),'%Y-%m-%d') AS last_day, count(*) FILTER (WHERE hit) AS hits, (100*count(*) FILTER (WHERE hit))//count(*) AS hit_percent, CAST(sum(chars) AS BIGINT)//1024 AS kb, CAST(sum(chars) AS BIGINT)//4//1000 AS k_tokens, CAST(floor(avg(ms)) AS BIGINT) AS mean_ms FROM use"))
def usage_summary(spark, d):
    return usage.summary(X.usage(spark, d))


@query(w("use", "SELECT tool, count(*) AS n FROM use GROUP BY 1"))
def usage_by_tool(spark, d):
    return usage.by_tool(X.usage(spark, d))


@query(w("use", "SELECT q, count(*) AS n FROM use GROUP BY 1 ORDER BY n DESC, q LIMIT 8"))
def usage_top_queries(spark, d):
    return usage.top_queries(X.usage(spark, d))


@query("SELECT 'baseline' AS arm, count(*) AS n, count(*) FILTER (WHERE quality=1) AS n_passed, 100*count(*) FILTER (WHERE quality=1)//count(*) AS percent FROM labels UNION ALL SELECT 'treatment', count(*), count(*) FILTER (WHERE toxic=0), 100*count(*) FILTER (WHERE toxic=0)//count(*) FROM labels")
def pass_rates(spark, d):
    return evals.pass_rates(X.cells(spark, d))


@query("SELECT *, round(least(1.0::DOUBLE, 2*(SELECT sum(exp(lgamma(b+c+1)-lgamma(k+1)-lgamma(b+c-k+1)+(b+c)*ln(0.5))) FROM unnest(range(0, least(b,c)+1)) AS u(k))),6) AS p FROM (SELECT count(*) FILTER (WHERE quality<>1 AND toxic=0) AS b, count(*) FILTER (WHERE quality=1 AND toxic<>0) AS c, count(*) AS n FROM labels)")
def mcnemar_exact(spark, d):
    return evals.paired(X.cells(spark, d), "baseline", "treatment").withColumn("p", r6(evals.mcnemar_exact(F.col("b"), F.col("c"))))


@query("SELECT *, percent-max(CASE WHEN arm='baseline' THEN percent END) OVER () AS delta FROM (SELECT 'baseline' AS arm, 100*count(*) FILTER (WHERE quality=1)//count(*) AS percent FROM labels UNION ALL SELECT 'treatment', 100*count(*) FILTER (WHERE toxic=0)//count(*) FROM labels)")
def arm_deltas(spark, d):
    return evals.arm_deltas(X.cells(spark, d), "baseline")


# --- beyond one hop -----------------------------------------------------------------------


@query(w("call impl", "SELECT 1").replace("\nSELECT 1", ",\ne AS (SELECT src_id, dst_id FROM call UNION SELECT src_id, dst_id FROM impl),\nh1 AS (SELECT DISTINCT dst_id AS node FROM e WHERE src_id='u1'),\nh2 AS (SELECT DISTINCT dst_id AS node FROM e JOIN h1 ON src_id=node)\nSELECT 'u1' AS node, 0 AS hops UNION ALL SELECT node, 1 FROM h1 UNION ALL SELECT node, 2 FROM h2 WHERE node NOT IN (SELECT node FROM h1)"))
def khop_2(spark, d):
    e = X.calls(spark, d).select("src_id", "dst_id").union(X.implements(spark, d).select("src_id", "dst_id"))
    return beyond.k_hops(e, spark.createDataFrame([("u1",)], "node string"), 2)


@query(w("raw_impl", "SELECT src_id, dst_id, l_orderkey, l_linenumber, l_quantity, l_extendedprice, round(confidence*pow(0.5::DOUBLE, date_diff('day', CAST(l_shipdate AS DATE), DATE '2002-01-01')/365.0::DOUBLE),6) AS decayed FROM raw_impl"))
def decayed_confidence(spark, d):
    e = X.raw_implements(spark, d).withColumn("age", F.datediff(F.lit("2002-01-01").cast("date"), F.col("_seq.l_shipdate").cast("date")))
    out = beyond.decayed(e, "age", 365.0)
    return out.select("src_id", "dst_id", "_seq.l_orderkey", "_seq.l_linenumber", "_seq.l_quantity", "_seq.l_extendedprice", r6("decayed").alias("decayed"))


@query("SELECT query_id, vec_id, round(s,6) AS similarity FROM (SELECT q.vec_id AS query_id, v.vec_id, list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])) AS s, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])),9) DESC, v.vec_id) AS n FROM embeddings q JOIN embeddings v ON q.vec_id<>v.vec_id WHERE q.vec_id%50=0) WHERE n<=5")
def cosine_topk(spark, d):
    e = X.table(spark, d, "embeddings")
    return beyond.nearest_vectors(e.where("vec_id % 50 = 0"), e, 5).select("query_id", "vec_id", r6("similarity").alias("similarity"))


@query(w("use", "SELECT strftime(date_trunc('day',ts),'%Y-%m-%d %H:%M:%S') AS start, tool, count(*) AS n, count(*) FILTER (WHERE hit) AS hits FROM use GROUP BY 1,2"))
def usage_tumbling(spark, d):
    return windows.tumbling(X.usage(spark, d)).select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "tool", "n", "hits")


@query(w("use", "SELECT strftime(s,'%Y-%m-%d %H:%M:%S') AS start, tool, count(*) AS n, count(*) FILTER (WHERE hit) AS hits FROM (SELECT *, time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '1970-01-01') - k*INTERVAL '6 hours' AS s FROM use, unnest(range(0,4)) AS u(k)) GROUP BY 1,2"))
def usage_sliding(spark, d):
    return windows.sliding(X.usage(spark, d)).select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "tool", "n", "hits")


@query(w("use", "SELECT q, strftime(min(ts),'%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM (SELECT *, sum(CASE WHEN p IS NULL OR ts>=p+INTERVAL '30 minutes' THEN 1 ELSE 0 END) OVER (PARTITION BY q ORDER BY ts) AS g FROM (SELECT *, lag(ts) OVER (PARTITION BY q ORDER BY ts) AS p FROM use)) GROUP BY q, g"))
def usage_session(spark, d):
    return windows.sessions(X.usage(spark, d)).select("q", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


@query("SELECT c_custkey, o_orderkey, o_totalprice FROM (SELECT c_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY c_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM customer JOIN orders ON c_custkey=o_custkey) WHERE n<=3")
def first_per_key_top3(spark, d):
    own = X.table(spark, d, "customer").select("c_custkey").join(X.table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey")).select("c_custkey", "o_orderkey", "o_totalprice")
    return first_per_key(own, ["c_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], 3)
