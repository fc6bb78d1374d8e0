"""The star schema's tables read as a knowledge graph: what the registered queries run on.

Parts are concepts, suppliers and customers code symbols, line items implements edges, shared
orders relates edges, orders calls, documents sections, events usage, labels evaluations. SQL
names the same tables as common table expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import docs as D
from ..operators.dml import upsert_edges

VOCABULARY = [("v1", "License", ["licensed"]), ("v2", "With", ["from"]), ("v3", "ThatWas", ["this"]), ("v4", "ByThe", []), ("v5", "Version", [])]


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def concepts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(
        F.concat(F.lit("c"), "p_partkey").alias("id"),
        F.col("p_name").alias("name"),
        F.when(F.col("p_size") % 3 == 0, F.col("p_type")).alias("definition"),
        F.col("p_brand").alias("bounded_context"),
        F.array(F.concat("p_brand", F.lit(" "), "p_size")).alias("aliases"),
        F.lit("candidate").alias("status"),
    )


def raw_implements(spark: SparkSession, d: str) -> DataFrame:
    confidence = (100 - 5 * F.round(F.col("l_discount") * 100)) / 100
    status = F.when(F.col("l_returnflag") == "N", "proposed").when(F.col("l_returnflag") == "A", "confirmed").otherwise("rejected")
    return table(spark, d, "lineitem").select(
        F.concat(F.lit("s"), "l_suppkey").alias("src_id"),
        F.concat(F.lit("c"), "l_partkey").alias("dst_id"),
        F.lit("implements").alias("type"),
        F.lit("inferred").alias("source"),
        confidence.alias("confidence"),
        status.alias("status"),
        F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity").alias("_seq"),
    )


def implements(spark: SparkSession, d: str) -> DataFrame:
    edges = upsert_edges(raw_implements(spark, d))
    return edges.withColumn("id", F.concat_ws(">", "src_id", "dst_id"))


def artifacts(spark: SparkSession, d: str) -> DataFrame:
    place = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    ref = lambda letter, k, name: F.concat("r_name", F.lit("/"), "n_name", F.lit(f"/{letter}"), F.col(k) % 10, F.lit(".go#"), F.col(name))
    art = lambda df, p, k, name, letter: df.select(F.concat(F.lit(p), k).alias("id"), F.lit("code_symbol").alias("kind"), F.lit("code").alias("layer"), F.lit("code").alias("source"), ref(letter, k, name).alias("ref"), F.col(name).alias("title"))
    s = table(spark, d, "supplier").join(place, F.col("s_nationkey") == F.col("n_nationkey"))
    c = table(spark, d, "customer").join(place, F.col("c_nationkey") == F.col("n_nationkey"))
    return art(s, "s", "s_suppkey", "s_name", "f").union(art(c, "u", "c_custkey", "c_name", "u"))


def shared_orders(spark: SparkSession, d: str) -> DataFrame:
    """Concepts (the first part of each name) that stand in one urgent early order, as matches."""
    first = table(spark, d, "part").groupBy("p_name").agg(F.min("p_partkey").alias("k"))
    names = table(spark, d, "part").select("p_partkey", "p_name").join(first, "p_name").select("p_partkey", F.concat(F.lit("c"), "k").alias("concept_id"))
    orders = table(spark, d, "orders").where("o_orderpriority = '1-URGENT' and o_orderdate < timestamp '1995-10-01'").select("o_orderkey")
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_partkey").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return lines.join(names, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").cast("string").alias("ref"), F.lit(0).alias("idx"), "concept_id").distinct()


def relates(spark: SparkSession, d: str) -> DataFrame:
    pairs = D.cooccurrences(shared_orders(spark, d))
    return pairs.select(F.concat_ws(">", "low", "high").alias("id"), F.col("low").alias("src_id"), F.col("high").alias("dst_id"), F.lit("relates").alias("type"), F.lit("inferred").alias("source"), "confidence", F.lit("proposed").alias("status"))


def told(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Describes edges of a document for each nation and constrains edges of a rule for each region to parts, and their artifacts."""
    p = table(spark, d, "part")
    part = F.concat(F.lit("c"), "p_partkey")
    doc, rule = F.concat(F.lit("dn"), F.col("p_partkey") % 25), F.concat(F.lit("rr"), F.col("p_partkey") % 5)

    def edge(src, kind, confidence, status):
        return p.select(F.concat_ws(">", src, part).alias("id"), src.alias("src_id"), part.alias("dst_id"), F.lit(kind).alias("type"), confidence.alias("confidence"), status.alias("status"))

    described = edge(doc, "describes", F.when(F.col("p_size") % 2 == 0, 0.9).otherwise(0.6), F.when(F.col("p_size") % 5 == 0, "rejected").when(F.col("p_size") % 5 == 1, "confirmed").otherwise("proposed"))
    ruled = edge(rule, "constrains", F.lit(0.6), F.when(F.col("p_size") % 4 == 0, "rejected").otherwise("proposed"))
    art = lambda k, kind, ref, title: (k.alias("id"), F.lit(kind).alias("kind"), F.lit("product").alias("layer"), F.lit("docs").alias("source"), ref.alias("ref"), title.alias("title"))
    docs = table(spark, d, "nation").select(*art(F.concat(F.lit("dn"), "n_nationkey"), "doc", F.concat(F.lit("docs/"), "n_name", F.lit(".md")), F.col("n_name")))
    rules = table(spark, d, "region").select(*art(F.concat(F.lit("rr"), "r_regionkey"), "rule", F.concat(F.lit("rule:"), "r_name"), F.concat(F.lit("Rule of "), "r_name")))
    return described.union(ruled), docs.union(rules)


def calls(spark: SparkSession, d: str) -> DataFrame:
    pairs = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).select(F.concat(F.lit("u"), "o_custkey").alias("src_id"), F.concat(F.lit("s"), "l_suppkey").alias("dst_id")).distinct()
    status = F.when(F.col("dst_id").endswith("7"), "rejected").otherwise("confirmed")
    return pairs.select(F.concat_ws(">", "src_id", "dst_id").alias("id"), "src_id", "dst_id", F.lit("calls").alias("type"), F.lit("deterministic").alias("source"), F.lit(1.0).alias("confidence"), status.alias("status"))


def edges(spark: SparkSession, d: str) -> DataFrame:
    names = ["id", "src_id", "dst_id", "type", "source", "confidence", "status"]
    return implements(spark, d).select(names).union(relates(spark, d).select(names)).union(calls(spark, d).select(names))


def sections(spark: SparkSession, d: str) -> DataFrame:
    """The first line of a document as its heading, the rest as the body."""
    text = F.coalesce("text", F.lit(""))
    return table(spark, d, "documents").select(F.concat(F.lit("d"), "doc_id").alias("ref"), F.lit(0).alias("idx"), F.substring_index(text, "\n", 1).alias("heading"), F.when(F.instr(text, "\n") > 0, F.regexp_replace(text, r"\A[^\n]*\n", "")).otherwise("").alias("body"), F.col("source").alias("name"))


def vocabulary(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(VOCABULARY, "id string, name string, aliases array<string>").withColumn("definition", F.col("name")).withColumn("bounded_context", F.lit(None).cast("string")).withColumn("status", F.lit("confirmed"))


def matches(spark: SparkSession, d: str) -> DataFrame:
    return D.dictionary_match(sections(spark, d), D.vocabulary_forms(vocabulary(spark)))


def rules(spark: SparkSession, d: str) -> DataFrame:
    return D.section_rules(sections(spark, d))


def usage(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, d, "events").select(F.unix_millis(F.col("ts").cast("timestamp")).alias("ts"), F.col("ts").cast("timestamp").alias("at"), F.col("event_type").alias("tool"), F.concat(F.lit("u"), "user_id").alias("q"), (F.col("event_type") != "error").alias("hit"), (100 * k).alias("chars"), F.floor("value").cast("long").alias("ms"))


def cells(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "labels")
    return own.select(F.col("doc_id").cast("string").alias("task"), F.lit("baseline").alias("arm"), (F.col("quality") == 1).alias("passed")).union(own.select(F.col("doc_id").cast("string"), F.lit("treatment"), F.col("toxic") == 0))


def stored_files(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("doc_id % 5 <> 0").select(F.concat(F.lit("d"), "doc_id").alias("path"), F.col("n_chars").alias("mtime"))


def listed_files(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("doc_id % 7 <> 0").select(F.concat(F.lit("d"), "doc_id").alias("path"), (F.col("n_chars") + (F.col("doc_id") % 11 == 0).cast("long")).alias("mtime"))


def modules(spark: SparkSession, d: str) -> DataFrame:
    """Regions and nations as modules by their path."""
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    both = n.join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return both.select(F.lower("n_name").alias("name"), F.concat("r_name", F.lit("/"), "n_name").alias("path")).where("n_name like '%1%'").union(r.select(F.lower("r_name"), "r_name").where("r_regionkey < 3"))


_FORMS = ", ".join(f"('{i}', '{f}')" for i, n, a in VOCABULARY for f in dict.fromkeys([n, "".join(" " + c if c.isupper() and k and n[k - 1].islower() else c for k, c in enumerate(n)), *a]))
L, R = r"(^|[^\p{L}\p{N}_])", r"([^\p{L}\p{N}_]|$)"

SQL = {
    "concept": "SELECT 'c'||p_partkey AS id, p_name AS name, CASE WHEN p_size%3=0 THEN p_type END AS definition, p_brand AS bounded_context, p_brand||' '||p_size AS alias, 'candidate' AS status FROM part",
    "raw_impl": "SELECT 's'||l_suppkey AS src_id, 'c'||l_partkey AS dst_id, (100-5*round(l_discount*100))/100 AS confidence, CASE l_returnflag WHEN 'N' THEN 'proposed' WHEN 'A' THEN 'confirmed' ELSE 'rejected' END AS status, * FROM lineitem",
    "impl": "SELECT src_id, dst_id, confidence, status FROM (SELECT *, row_number() OVER (PARTITION BY src_id, dst_id ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC, l_extendedprice DESC, l_quantity DESC, confidence DESC, status DESC) AS rn FROM raw_impl) WHERE rn=1",
    "place": "SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey=r_regionkey",
    "artifact": "SELECT 's'||s_suppkey AS id, r_name||'/'||n_name||'/f'||(s_suppkey%10)||'.go#'||s_name AS ref, s_name AS title FROM supplier JOIN place ON s_nationkey=n_nationkey UNION ALL SELECT 'u'||c_custkey, r_name||'/'||n_name||'/u'||(c_custkey%10)||'.go#'||c_name, c_name FROM customer JOIN place ON c_nationkey=n_nationkey",
    "share": "SELECT DISTINCT l_orderkey AS ref, 'c'||k AS concept_id FROM lineitem JOIN orders ON l_orderkey=o_orderkey JOIN part ON l_partkey=p_partkey JOIN (SELECT p_name AS pn, min(p_partkey) AS k FROM part GROUP BY 1) ON pn=p_name WHERE o_orderpriority='1-URGENT' AND o_orderdate < TIMESTAMP '1995-10-01'",
    "rel": "SELECT a.concept_id AS src_id, b.concept_id AS dst_id, count(*) AS n, least(0.9::DOUBLE, 0.3::DOUBLE+count(*)*0.1::DOUBLE) AS confidence FROM share a JOIN share b ON a.ref=b.ref AND a.concept_id<b.concept_id GROUP BY 1,2 HAVING count(*)>=2",
    "call": "SELECT DISTINCT 'u'||o_custkey AS src_id, 's'||l_suppkey AS dst_id, CASE WHEN l_suppkey%10=7 THEN 'rejected' ELSE 'confirmed' END AS status FROM orders JOIN lineitem ON o_orderkey=l_orderkey",
    "edge": "SELECT src_id, dst_id, 'implements' AS type, confidence, status FROM impl UNION ALL SELECT src_id, dst_id, 'relates', confidence, 'proposed' FROM rel UNION ALL SELECT src_id, dst_id, 'calls', 1.0::DOUBLE, status FROM call",
    "section": "SELECT 'd'||doc_id AS ref, source AS name, split_part(coalesce(text,''), chr(10), 1) AS heading, CASE WHEN contains(text, chr(10)) THEN substr(text, strpos(text, chr(10))+1) ELSE '' END AS body FROM documents",
    "form": f"SELECT * FROM (VALUES {_FORMS}) AS t(concept_id, form)",
    "hit": f"SELECT ref, concept_id, bool_or(regexp_matches(heading, '(?i){L}'||form||'{R}')) AS heading_hit FROM section, form WHERE regexp_matches(heading||chr(10)||body, '(?i){L}'||form||'{R}') GROUP BY 1,2",
    "use": "SELECT epoch_ms(ts) AS ms_ts, ts, event_type AS tool, 'u'||user_id AS q, event_type<>'error' AS hit, 100*CAST(json_extract_string(props,'$.k') AS INT) AS chars, CAST(floor(value) AS BIGINT) AS ms FROM events",
    "told": "SELECT 'dn'||(p_partkey%25) AS src_id, 'c'||p_partkey AS dst_id, 'describes' AS type, CASE WHEN p_size%2=0 THEN 0.9::DOUBLE ELSE 0.6::DOUBLE END AS confidence, CASE p_size%5 WHEN 0 THEN 'rejected' WHEN 1 THEN 'confirmed' ELSE 'proposed' END AS status, 'docs/'||n_name||'.md' AS ref, n_name AS title FROM part JOIN nation ON p_partkey%25=n_nationkey UNION ALL SELECT 'rr'||(p_partkey%5), 'c'||p_partkey, 'constrains', 0.6::DOUBLE, CASE WHEN p_size%4=0 THEN 'rejected' ELSE 'proposed' END, 'rule:'||r_name, 'Rule of '||r_name FROM part JOIN region ON p_partkey%5=r_regionkey",
    "prev": "SELECT 'd'||doc_id AS path, n_chars AS mtime FROM documents WHERE doc_id%5<>0",
    "cur": "SELECT 'd'||doc_id AS path, n_chars+CASE WHEN doc_id%11=0 THEN 1 ELSE 0 END AS mtime FROM documents WHERE doc_id%7<>0",
    "module": "SELECT lower(n_name) AS name, r_name||'/'||n_name AS path FROM place WHERE n_name LIKE '%1%' UNION ALL SELECT lower(r_name), r_name FROM region WHERE r_regionkey<3",
}
_NEEDS = {"impl": ["raw_impl"], "artifact": ["place"], "rel": ["share"], "edge": ["impl", "rel", "call"], "hit": ["section", "form"], "module": ["place"]}


def with_tables(names: str, query: str) -> str:
    """The query with the named fixtures, and those they need, before it."""
    order: list[str] = []

    def add(n: str) -> None:
        for m in _NEEDS.get(n, []):
            add(m)
        if n not in order:
            order.append(n)

    for n in names.split():
        add(n)
    return "WITH " + ",\n".join(f"{n} AS ({SQL[n]})" for n in order) + "\n" + query
