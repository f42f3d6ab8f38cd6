"""Ingestion and text queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillgraph.functions import text as X
from quillgraph.operators import ingest, reference_docs
from quillgraph.plans import bindings as B
from quillgraph.plans.registry import query
from quillgraph.session import table

_STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
_DOCS = f"SELECT 'doc-' || md5({_STRIP.format('text')}) AS doc_id, any_value({_STRIP.format('text')}) AS content FROM documents GROUP BY 1"


@query(f"SELECT doc_id, length(content) AS n FROM ({_DOCS})")
def content_documents(spark, d):
    return ingest.documents(table(spark, d, "documents")).select("doc_id", F.length("content").cast("long").alias("n"))


@query(rf"""WITH t AS (SELECT doc_id, string_split(text, ' ') AS t FROM documents), s AS (SELECT doc_id, t, unnest(range(0, len(t), 100)) AS s FROM t WHERE length(array_to_string(t, ' ')) > 0)
    SELECT doc_id AS full_doc_id, (s // 100)::INT AS chunk_order_index, least(120, len(t) - s)::INT AS tokens, 'chunk-' || md5({_STRIP.format("array_to_string(t[s + 1:s + 120], ' ')")}) AS chunk_id FROM s""")
def token_chunks(spark, d):
    return ingest.chunks(table(spark, d, "documents"), 120, 20, content="text").select("full_doc_id", "chunk_order_index", "tokens", "chunk_id")


@query()
def markdown_chunks(spark, d):
    """Documents with their source as headings every few lines."""
    docs = table(spark, d, "documents").select("doc_id", F.concat(F.lit("# "), "source", F.lit("\n"), F.regexp_replace("text", r"\n", "\n## part\n")).alias("content"))
    return ingest.markdown_chunks(docs, 300, 30)


@query(r"SELECT doc_id, list_filter(list_transform(string_split_regex(text, '\.|\n|,'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS parts FROM documents")
def marker_split(spark, d):
    return table(spark, d, "documents").select("doc_id", X.split_markers(F.col("text"), [".", "\n", ","]).alias("parts"))


_OUT = """SELECT o_orderkey AS chunk_id, o_custkey % 10 AS w, o_orderkey % 70 AS e FROM orders"""


@query(f"""WITH r AS ({_OUT}) SELECT chunk_id, '<hyperedge>fact ' || chunk_id AS hyperedge, w::DOUBLE AS weight FROM r WHERE w >= 7""")
def extracted_hyperedges(spark, d):
    return ingest.extraction(_outputs(spark, d))[0].select("chunk_id", "hyperedge", "weight")


@query(f"""WITH r AS ({_OUT}) SELECT chunk_id, '<hyperedge>fact ' || chunk_id AS hyperedge, 'DRUG ' || e AS entity, CASE e % 3 WHEN 0 THEN 'RECOMMENDATION' WHEN 1 THEN 'EVIDENCE' ELSE 'CONDITION' END AS role, (40 + e)::DOUBLE AS weight FROM r WHERE w >= 7 AND 40 + e >= 50""")
def extracted_entities(spark, d):
    return ingest.extraction(_outputs(spark, d))[1].select("chunk_id", "hyperedge", "entity", "role", "weight")


def _outputs(spark, d):
    """Extraction outputs as a language model writes them, from orders."""
    o = table(spark, d, "orders")
    e = F.col("o_orderkey") % 70
    role = F.when(e % 3 == 0, "action").when(e % 3 == 1, "SOURCE").otherwise("whatever")
    text = F.format_string('("hyper-relation"<|>fact %d<|>%d)##("entity"<|>drug %d<|>drug<|>text<|>%s<|>%d)##("entity"<|>short<|>x)<|COMPLETE|>', "o_orderkey", F.col("o_custkey") % 10, e, role, 40 + e)
    return o.select(F.col("o_orderkey").alias("chunk_id"), text.alias("output"))


@query("SELECT l_orderkey AS hyperedge, sum(l_quantity) AS weight, list_sort(list(DISTINCT 's' || l_suppkey)) AS source_ids FROM lineitem GROUP BY 1")
def merge_hyperedges(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("hyperedge"), F.col("l_quantity").alias("weight"), F.concat(F.lit("s"), "l_suppkey").alias("source_id"), "l_linenumber")
    new, old = rows.filter("l_linenumber > 2"), rows.filter("l_linenumber <= 2")
    return ingest.merge_hyperedges(new, ingest.merge_hyperedges(old))


@query(f"""WITH l AS (SELECT l_partkey AS entity, l_linestatus AS t, l_orderkey * 10 + l_linenumber AS pos, 'n' || l_linenumber AS txt FROM lineitem), v AS (SELECT entity, t, count(*) AS c, min(pos) AS p FROM l GROUP BY ALL)
    SELECT entity, arg_max(t, c * 1000000000 - p) AS entity_type, sum(c)::BIGINT AS n, (SELECT array_to_string(list_sort(list(DISTINCT txt)), '<SEP>') FROM l WHERE l.entity = v.entity) AS description FROM v GROUP BY entity""")
def merge_entities(spark, d):
    l = table(spark, d, "lineitem").select(F.col("l_partkey").alias("entity"), F.col("l_linestatus").alias("entity_type"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"), F.concat(F.lit("n"), "l_linenumber").alias("description"))  # noqa: E741
    return ingest.merge_entities(l).select("entity", "entity_type", "n", "description")


@query(f"SELECT hyperedge, entity, arg_max(role, pos) AS role, sum(weight) AS weight FROM ({B.LINKS}) GROUP BY hyperedge, entity")
def merge_incidence(spark, d):
    return ingest.merge_incidence(B.links(spark, d))


@query("""WITH e AS (SELECT upper(n_name) AS name FROM nation WHERE n_nationkey < 15), r AS (SELECT upper(n_name) AS src, upper(r_name) AS tgt FROM nation JOIN region ON n_regionkey = r_regionkey)
    SELECT name, 'known' AS kind FROM e UNION ALL SELECT name, 'UNKNOWN' FROM (SELECT src AS name FROM r UNION SELECT tgt FROM r) WHERE name NOT IN (SELECT name FROM e)""")
def custom_graph_nodes(spark, d):
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    chunks = n.select(F.col("n_name").alias("source_id"), F.concat(F.lit("about "), "n_name").alias("content"))
    entities = n.filter("n_nationkey < 15").select(F.col("n_name").alias("entity_name"), F.lit("known").alias("entity_type"), F.lit(None).cast("string").alias("description"), F.col("n_name").alias("source_id"))
    rel = n.join(r, n["n_regionkey"] == r["r_regionkey"]).select(F.col("n_name").alias("src_id"), F.col("r_name").alias("tgt_id"), F.lit("in").alias("description"), F.lit("place").alias("keywords"), F.lit(None).cast("double").alias("weight"), F.lit("nowhere").alias("source_id"))
    return ingest.custom_graph(chunks, entities, rel)[0].select("name", F.col("entity_type").alias("kind"))


@query()
def clean_pages(spark, d):
    """References decoded, control characters dropped; the full table of references is no built-in of SQL."""
    return table(spark, d, "pages").select("page_id", X.clean_text(F.col("html")).alias("text"))


@query(r"SELECT doc_id, line_no::INT AS line_no, array_to_string(l[greatest(line_no, 1):line_no + 3], chr(10)) AS snippet FROM (SELECT doc_id, string_split(text, chr(10)) AS l, unnest(range(0, len(string_split(text, chr(10))))) AS line_no FROM documents) WHERE contains(lower(l[line_no + 1]), 'license')")
def keyword_in_context(spark, d):
    return reference_docs.keyword_lines(table(spark, d, "documents"), "license")


@query(r"SELECT doc_id, len(string_split(chr(10) || text, chr(10) || 'The ')) AS n FROM documents")
def reference_sections(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.concat(F.lit("intro\n"), F.regexp_replace("text", r"(?m)^The ", "## ")).alias("text"))
    return reference_docs.sections(docs).groupBy("doc_id").agg(F.count("*").alias("n"))


@query("WITH s AS (SELECT lang AS g, doc_id, contains(lower(text), 'license') OR contains(lower(text), 'copyright') AS hit FROM documents) SELECT doc_id FROM s QUALIFY hit OR NOT bool_or(hit) OVER (PARTITION BY g)")
def keyword_sections(spark, d):
    secs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("doc_id"), F.col("text").alias("content"))
    return reference_docs.keyword_sections(secs, ["License", "copyright"]).select(F.col("id").alias("doc_id"))


@query(r"SELECT conv_id, list_sort(list(turn)) AS turns, count_if(role = 'user') AS n_user, max(len(string_split(text, ' '))) AS longest FROM conversations GROUP BY conv_id")
def conversation_turns(spark, d):
    c = table(spark, d, "conversations")
    return c.groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("turns"), F.count_if(F.col("role") == "user").alias("n_user"), F.max(X.token_count(F.col("text"))).cast("long").alias("longest"))


@query("SELECT conv_id, string_agg('<' || role || '>' || text || '</' || role || '>', chr(10) ORDER BY turn) AS prompt FROM conversations GROUP BY conv_id")
def chat_prompts(spark, d):
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("m"))
    return rows.select("conv_id", X.chat_prompt(F.col("m.role"), F.col("m.text")).alias("prompt"))


@query("SELECT event_id, json_extract_string(props, '$.k')::INT AS k FROM events")
def event_properties(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


@query()
def tool_calculator(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.format_string("(%d + 2) * -3 / %d", "o_orderkey", F.col("o_custkey") % 4).alias("e"))
    return o.select("o_orderkey", X.calculator("e").alias("answer"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '{\"query\": \"q' || doc_id || '\"}' END AS call FROM documents")
def tool_calls(spark, d):
    text = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("I ask <query>\n{\"query\": \"q"), "doc_id", F.lit("\"} </query> now"))).otherwise(F.lit("no call"))
    return table(spark, d, "documents").select("doc_id", X.tool_call(text).alias("call"))
