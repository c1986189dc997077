"""Queries that apply the operators to the shared tables, each with SQL that gives the same
rows by another route."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from termweave.functions import scores, spans, text
from termweave.operators import chunk, diff, etl, metrics, model_json, postprocess, search, tree, validate
from termweave.operators.expand import RULES
from termweave.operators.extract import RuleExtractor, extract_entities
from termweave.schema import DIAGNOSIS, DRUG, SYMPTOM, TEST, TYPES
from termweave.sources import files, sinks
from termweave.sources.scratch import drop_at_end, shared_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: White space in the dialect of the SQL engine.
SQL_SPACE = r"[\x{09}-\x{0d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


#: Events of a task: each makes an answer to be parsed.
EVENT_ROWS = 25_000


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    read = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    # texts and JSON cost far more to work on than to move
    return files.spread(read, EVENT_ROWS if name == "events" else None) if name in ("documents", "conversations", "events") else read


def sql_fold(x: str) -> str:
    return f"replace(translate(lower({x}), 'ςſµ', 'σsμ'), 'ß', 'ss')"


def sql_normal(x: str) -> str:
    return f"trim(regexp_replace({sql_fold(x)}, '{SQL_SPACE}+', ' ', 'g'))"


def sql_tokens(x: str, breaks: bool = True) -> str:
    normal = f"translate({sql_normal(x)}, '/-', '  ')" if breaks else sql_normal(x)
    return f"list_filter(string_split({normal}, ' '), lambda w: w <> '')"


# -- text ------------------------------------------------------------------------------------


@query(f"SELECT doc_id, {sql_normal('text')} AS normal FROM documents")
def text_normalize(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.normalize_text("text").alias("normal"))


@query(f"""SELECT doc_id, len({sql_tokens("text")}) AS n_tokens, md5(array_to_string({sql_tokens("text")}, '|')) AS tokens_md5,
  len({sql_tokens("text", False)}) AS n_plain FROM documents""")
def tokenize(spark, sf_dir):
    found = table(spark, sf_dir, "documents").select("doc_id", text.search_tokens("text").alias("t"), text.term_tokens("text").alias("p"))
    return found.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.md5(F.array_join("t", "|")).alias("tokens_md5"), F.size("p").cast("long").alias("n_plain"))


@query(f"SELECT doc_id, replace(strip_accents({sql_fold('text')}), 'đ', 'd') AS plain FROM documents")
def strip_diacritics(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.strip_diacritics("text").alias("plain"))


@query("""WITH t AS (SELECT doc_id, list_distinct(regexp_extract_all(replace(strip_accents(lower(replace(text, 'ß', 'ss'))), 'đ', 'd'), '[a-z0-9]+')) AS t FROM documents)
SELECT doc_id, CAST(len(list_filter(t, lambda x: (x NOT IN ('bao','benh','cap','chung','da','dai','day','gan','hoi','man','mo','ruot','te','tu','ung','viem') AND length(x) > 1)
  OR x IN ('bao','buong','dai','duong','gan','giap','kich','mat','nghien','ruot','ruou','thich','trung','tuyen'))) AS BIGINT) AS n_meaningful FROM t""")
def meaningful_tokens(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(text.meaningful_tokens("text")).cast("long").alias("n_meaningful"))


@query("""WITH n AS (SELECT DISTINCT p_name || ' ' || (p_partkey % 977) || '.txt' AS name FROM part)
SELECT name, row_number() OVER (ORDER BY coalesce(TRY_CAST(nullif(regexp_extract(regexp_replace(name, '\\.[^.]*$', ''), '[0-9]+'), '') AS BIGINT), 1000000000), name) AS place FROM n ORDER BY place LIMIT 100""")
def natural_sort_limit(spark, sf_dir):
    names = table(spark, sf_dir, "part").select(F.concat("p_name", F.lit(" "), (F.col("p_partkey") % 977).cast("string"), F.lit(".txt")).alias("name")).distinct()
    first = files.first_files(names, 100)
    return first.select("name", F.row_number().over(W.orderBy(*text.natural_order("name"))).cast("long").alias("place"))


# -- chunks ----------------------------------------------------------------------------------

CHUNK_SQL = r"""
WITH RECURSIVE c AS (
  SELECT CAST(doc_id AS VARCHAR) AS doc_id, text, -1 AS chunk_index, 0 AS s, 0 AS e FROM documents WHERE text <> ''
  UNION ALL
  SELECT doc_id, text, chunk_index + 1, e, CASE
    WHEN chunk_index = -1 AND length(text) <= 1500 OR length(text) - e <= 800 THEN length(text)
    ELSE e + coalesce(
      CASE WHEN contains(wl, chr(10) || chr(10)) THEN 300 + length(regexp_extract(wl, '(?s)^.*\n\n')) END,
      CASE WHEN contains(w, chr(10)) THEN 300 + length(regexp_extract(w, '(?s)^.*\n')) END,
      CASE WHEN regexp_matches(wl, '[.!?;]\s') THEN 299 + length(regexp_extract(wl, '(?s)^.*[.!?;]\s')) END,
      CASE WHEN regexp_matches(wl, '[,:]\s') THEN 299 + length(regexp_extract(wl, '(?s)^.*[,:]\s')) END,
      CASE WHEN regexp_matches(w, '\s') THEN 300 + length(regexp_extract(w, '(?s)^.*\s')) END,
      600) END
  FROM (SELECT *, substr(text, e + 301, 500) AS w, substr(text, e + 301, 501) AS wl FROM c WHERE e < length(text))
)
"""


@query(CHUNK_SQL + "SELECT doc_id, CAST(chunk_index AS BIGINT) AS chunk_index, CAST(s AS BIGINT) AS \"start\", CAST(e AS BIGINT) AS \"end\", substr(text, s + 1, e - s) AS text FROM c WHERE chunk_index >= 0")
def chunk_rows(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    rows = chunk.chunks(docs)
    return rows.select("doc_id", *[F.col(c).cast("long").alias(c) for c in ("chunk_index", "start", "end")], "text")


@query(CHUNK_SQL + "SELECT count(*) AS n_chunks, sum(e - s)::BIGINT AS n_chars, max(e - s)::BIGINT AS longest, true AS faithful FROM c WHERE chunk_index >= 0")
def chunk_invariants(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    rows = chunk.chunks(docs).withColumnRenamed("text", "part").join(docs, "doc_id")
    faithful = spans.slice_text(F.col("text"), F.col("start"), F.col("end")) == F.col("part")
    size = F.col("end") - F.col("start")
    return rows.agg(F.count(F.lit(1)).alias("n_chunks"), F.sum(size).cast("long").alias("n_chars"), F.max(size).cast("long").alias("longest"), F.bool_and(faithful).alias("faithful"))


# -- spans and entities ----------------------------------------------------------------------


# mentions hold no blank, so each lies in one of the pieces between blanks
PIECE_SQL = """p AS (SELECT doc_id, piece, sum(length(piece) + 1) OVER (PARTITION BY doc_id ORDER BY i) - length(piece) - 1 AS base
  FROM (SELECT doc_id, generate_subscripts(s, 1) AS i, unnest(s) AS piece FROM (SELECT doc_id, string_split(text, ' ') AS s FROM documents)))"""
MENTIONS = ["ontion", "erer", "ee", "éé", "zzz"]


@query(f"""WITH {PIECE_SQL}, m AS (SELECT *, unnest({MENTIONS}) AS mention FROM p)
SELECT doc_id, mention, CAST(base + i AS BIGINT) AS "start", CAST(base + i + length(mention) AS BIGINT) AS "end"
FROM (SELECT *, unnest(range(0, length(piece))) AS i FROM m WHERE contains(piece, mention)) WHERE substr(piece, i + 1, length(mention)) = mention""")
def exact_mentions(spark, sf_dir):
    words = F.array(*map(F.lit, MENTIONS))
    rows = table(spark, sf_dir, "documents").select("doc_id", "text", F.explode(words).alias("mention"))
    found = rows.select("doc_id", "mention", F.explode(spans.exact_matches(F.col("text"), F.col("mention"))).alias("m"))
    return found.select("doc_id", "mention", F.col("m.start").cast("long").alias("start"), F.col("m.end").cast("long").alias("end"))


@query(f"""WITH {PIECE_SQL}, w AS (SELECT doc_id, text, string_split(text, ' ')[5] AS mention, 7 * (doc_id % 9) AS p FROM documents),
m AS (SELECT w.doc_id, w.p, base + unnest(range(0, length(piece) - length(mention) + 1)) AS i, piece, base, mention FROM w JOIN p USING (doc_id) WHERE mention <> '' AND contains(piece, mention)),
o AS (SELECT doc_id, list_sort(list([abs(i - p), i])) AS o FROM m WHERE substr(piece, CAST(i - base + 1 AS BIGINT), length(mention)) = mention GROUP BY doc_id)
SELECT doc_id, CAST(CASE WHEN mention <> '' AND substr(text, p + 1, length(mention)) = mention THEN p WHEN len(o) = 1 OR o[2][1] > o[1][1] THEN o[1][2] END AS BIGINT) AS fixed FROM w LEFT JOIN o USING (doc_id)""")
def span_repair(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "text", F.get(F.split("text", " "), F.lit(4)).alias("mention"), (7 * (F.col("doc_id") % 9)).cast("int").alias("p"))
    fixed = spans.correct_span(F.col("text"), F.col("mention"), F.col("p"), F.col("p") + F.length("mention"))
    return rows.select("doc_id", fixed["start"].cast("long").alias("fixed"))


@query("""SELECT doc_id, k, coalesce(k > 0 AND doc_id % 11 + k <= length(text) AND text[CAST(doc_id % 11 + 1 AS INT) : CAST(doc_id % 11 + k AS INT)] = substr(text, 4, 3), false) AS valid,
  CASE WHEN k > 0 AND doc_id % 11 + k <= 12 THEN 100 + doc_id % 11 END AS global_start
FROM (SELECT *, unnest([0, 3, 99999]) AS k FROM documents)""")
def span_validate(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "text", F.explode(F.array(*map(F.lit, (0, 3, 99999)))).alias("k"))
    start = (F.col("doc_id") % 11).cast("int")
    valid = spans.valid_span(F.col("text"), F.substr(F.col("text"), F.lit(4), F.lit(3)), start, start + F.col("k"))
    moved = spans.to_global(F.lit(100), F.lit(112), start, start + F.col("k"))
    return rows.select("doc_id", "k", valid.alias("valid"), moved["start"].cast("long").alias("global_start"))


RULE_SQL = "\n UNION ALL ".join(
    f"SELECT doc_id, text, {k} AS rank, '{p}' AS pattern, '{t}' AS type, base + unnest(list_filter(range(0, length(text)), lambda i: substr(text, i + 1, {len(p)}) = '{p}')) AS s FROM conv WHERE contains(text, '{p}')"
    for k, (p, t) in enumerate(RuleExtractor().patterns)
)


@query(CHUNK_SQL + f""", conv AS (SELECT doc_id, s AS base, substr(text, s + 1, e - s) AS text FROM c WHERE chunk_index >= 0), f AS ({RULE_SQL})
SELECT DISTINCT CAST(doc_id AS VARCHAR) AS doc_id, pattern AS text, type, CAST(s AS BIGINT) AS "start", CAST(s + length(pattern) AS BIGINT) AS "end", 0 AS n_assertions FROM f""")
def rule_entities(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    rows = extract_entities(docs, RuleExtractor())
    return rows.select("doc_id", "text", "type", F.col("position")[0].cast("long").alias("start"), F.col("position")[1].cast("long").alias("end"), F.size("assertions").alias("n_assertions"))


ASSERTED = ["không", "tiền sử", "gia đình", "bố từng", "xong", "ÂM TÍNH"]


@query(f"""WITH w AS (SELECT c_custkey, [{", ".join(f"'{a}'" for a in ASSERTED)}][CAST(c_custkey % {len(ASSERTED)} + 1 AS INT)] || repeat('.', CAST(c_custkey % 37 AS INT)) AS before FROM customer),
x AS (SELECT c_custkey, lower(right(before, 30)) AS w FROM w)
SELECT c_custkey, CASE WHEN regexp_matches(w, 'không|phủ nhận|chưa ghi nhận|âm tính') THEN 'isNegated ' ELSE '' END || CASE WHEN regexp_matches(w, 'tiền sử|từng|đã dùng|trước nhập viện') THEN 'isHistorical ' ELSE '' END
  || CASE WHEN regexp_matches(w, 'bố|mẹ|gia đình|người thân') THEN 'isFamily ' ELSE '' END AS found FROM x""")
def assertion_window(spark, sf_dir):
    from termweave.operators.extract import assertions_near

    words = F.array(*map(F.lit, ASSERTED))
    before = F.concat(F.get(words, (F.col("c_custkey") % len(ASSERTED)).cast("int")), F.repeat(F.lit("."), (F.col("c_custkey") % 37).cast("int")))
    rows = table(spark, sf_dir, "customer").select("c_custkey", before.alias("before"))
    near = assertions_near(F.concat("before", F.lit("ho")), F.length("before"))
    return rows.select("c_custkey", F.array_join(F.transform(near, lambda a: F.concat(a, F.lit(" "))), "").alias("found"))


def line_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities made of order lines: overlapping spans of few types in each order."""
    rows = table(spark, sf_dir, "lineitem")
    start, size = (F.col("l_linenumber") % 3).cast("int"), (F.col("l_quantity").cast("int") % 4 + 1)
    marks = F.array_repeat(F.lit("isNegated"), (F.col("l_partkey") % 3).cast("int"))
    return rows.select(
        F.col("l_orderkey").cast("string").alias("doc_id"), (F.col("l_linenumber") * 1000000 + F.col("l_partkey") * 10 + F.col("l_suppkey") % 10).cast("long").alias("ord"), F.col("l_returnflag").alias("text"), F.array(start, start + size).alias("position"),
        F.col("l_linestatus").alias("type"), marks.alias("assertions"), F.array().cast("array<string>").alias("candidates"),
    )


LINE_SQL = """l AS (SELECT CAST(l_orderkey AS VARCHAR) AS doc_id, CAST(l_linenumber * 1000000 + l_partkey * 10 + l_suppkey % 10 AS BIGINT) AS ord, l_returnflag AS text, l_linenumber % 3 AS s, l_linenumber % 3 + CAST(trunc(l_quantity) AS INT) % 4 + 1 AS e, l_linestatus AS type, l_partkey % 3 AS rich FROM lineitem)"""


@query(f"""WITH {LINE_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, type, text, s, e ORDER BY rich DESC, ord) AS n, min(ord) OVER (PARTITION BY doc_id, type, text, s, e) AS first FROM l)
SELECT doc_id, first AS ord, text, type, CAST(s AS BIGINT) AS "start", CAST(e AS BIGINT) AS "end", CAST(rich AS BIGINT) AS richness FROM r WHERE n = 1""")
def dedupe_richest(spark, sf_dir):
    rows = postprocess.dedupe_richest(line_entities(spark, sf_dir))
    return rows.select("doc_id", "ord", "text", "type", F.col("position")[0].cast("long").alias("start"), F.col("position")[1].cast("long").alias("end"), postprocess.richness().cast("long").alias("richness"))


@query(f"""WITH {LINE_SQL} SELECT doc_id, ord FROM l WHERE NOT EXISTS (SELECT 1 FROM l o WHERE o.doc_id = l.doc_id AND o.type = l.type AND o.s <= l.s AND o.e >= l.e AND o.e - o.s > l.e - l.s AND o.rich >= l.rich)""")
def nested_filter(spark, sf_dir):
    return postprocess.drop_nested(line_entities(spark, sf_dir)).select("doc_id", "ord")


NOISE_TEXTS = ["Bé  Trai", "khó thở", "5,5 mg", "Phẫu thuật tim", "Aspirin", "men G6PD", "gan", "sơ sinh", "12 tuần", "hội chứng x", "Ung Thư"]


@query(f"""WITH t AS (SELECT p_partkey, [{", ".join(f"'{x}'" for x in NOISE_TEXTS)}][CAST(p_partkey % {len(NOISE_TEXTS)} + 1 AS INT)] AS text, [{", ".join(f"'{x}'" for x in TYPES)}][CAST(p_size % 5 + 1 AS INT)] AS type FROM part)
SELECT p_partkey FROM t WHERE text NOT IN ('Bé  Trai', '5,5 mg', '12 tuần') AND NOT (type = '{DIAGNOSIS}' AND text IN ('Phẫu thuật tim', 'gan', 'Ung Thư')) AND NOT (type = '{SYMPTOM}' AND text IN ('men G6PD', 'sơ sinh'))""")
def noise_filter(spark, sf_dir):
    of = lambda values, n: F.get(F.array(*map(F.lit, values)), (n % len(values)).cast("int"))
    rows = table(spark, sf_dir, "part").select("p_partkey", of(NOISE_TEXTS, F.col("p_partkey")).alias("text"), of(TYPES, F.col("p_size")).alias("type"))
    return postprocess.drop_noise(rows).select("p_partkey")


def event_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of a model made of events: valid ones, forbidden lists, broken ends."""
    n = F.col("event_id")
    kind = F.when(n % 3 == 0, SYMPTOM).when(n % 3 == 1, DRUG).otherwise("OTHER")
    entity = F.concat(F.lit('{"text": "'), "event_type", F.lit('", "position": ['), (n % 5).cast("string"), F.lit(", "), (n % 7).cast("string"), F.lit('], "type": "'), kind, F.lit('", "assertions": [], "candidates": ["'), (n % 4).cast("string"), F.lit('"]}'))
    whole = F.concat(F.lit(' {"entities": ['), entity, F.lit(", "), entity, F.lit("]} "))
    return table(spark, sf_dir, "events").select("event_id", F.when(n % 4 == 3, F.expr("cast('' as string)")).when(n % 4 == 2, F.concat(F.lit('{"entities": ['), entity, F.lit(', {"text": "cut'))).otherwise(whole).alias("generated"))


@query(f"""WITH e AS (SELECT event_id, event_id % 4 AS shape, event_id % 5 < event_id % 7 AS span, event_id % 3 AS kind FROM events)
SELECT event_id, CASE WHEN shape = 3 THEN 'empty' WHEN shape = 2 THEN 'salvaged' WHEN span AND kind = 1 THEN 'strict' ELSE 'tolerant' END AS outcome,
  CASE WHEN shape = 3 OR kind = 2 OR NOT span THEN 0 WHEN shape = 2 THEN 1 ELSE 2 END AS n_entities, CASE WHEN shape <> 3 AND span AND kind = 1 THEN 1 ELSE 0 END AS n_candidates FROM e""")
def json_parse(spark, sf_dir):
    rows = model_json.parse_answers(event_answers(spark, sf_dir))
    return rows.select("event_id", "outcome", F.size("entities").alias("n_entities"), F.coalesce(F.size(F.get("entities", F.lit(0))["candidates"]), F.lit(0)).alias("n_candidates"))


# -- search ----------------------------------------------------------------------------------


def _document_search(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), "text", F.array().cast("array<string>").alias("aliases"))
    return docs, table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("query_id"), "text")


BM25_SQL = f"""d AS (SELECT CAST(doc_id AS VARCHAR) AS id, unnest({sql_tokens("text")}) AS token FROM documents),
z AS (SELECT CAST(doc_id AS VARCHAR) AS id, len({sql_tokens("text")}) AS size FROM documents),
g AS (SELECT count(*) AS docs, avg(size) AS mean FROM z),
p AS (SELECT token, id, count(*) AS n FROM d GROUP BY ALL),
i AS (SELECT token, ln(docs - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM p, g GROUP BY token, docs),
j AS (SELECT token, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM i) ELSE raw END AS idf FROM i),
q AS (SELECT CAST(item_id AS VARCHAR) AS query_id, unnest({sql_tokens("text")}) AS token FROM benchmark),
s AS (SELECT query_id, p.id, sum(idf * n * 2.5 / (n + 1.5 * (0.25 + 0.75 * size / mean))) AS score FROM q JOIN j USING (token) JOIN p USING (token) JOIN z ON z.id = p.id, g GROUP BY ALL),
r AS (SELECT query_id, id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, id) AS rank FROM s)"""


@query(f"WITH {BM25_SQL} SELECT query_id, id, score FROM r WHERE rank <= 5")
def bm25_topk(spark, sf_dir):
    docs, asked = _document_search(spark, sf_dir)
    return search.Bm25Index.build(docs).best(asked, 5, 6).select("query_id", "id", F.round("score", 6).alias("score"))


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("rxcui"), "p_name", "p_brand", "p_type").select("rxcui", F.col("p_name").alias("name"), F.array("p_brand", F.concat_ws("/", "p_type", "p_brand")).alias("synonyms"))


def _part_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    every = p.select(F.upper("p_type").alias("text")).union(p.select(F.concat_ws("  ", "p_brand", "p_type"))).union(p.select(F.concat_ws("-", F.lower("p_type"), "p_brand"))).union(p.select(F.substring("p_name", 2, 4))).union(p.select(F.upper("p_name")))
    return every.distinct().select(F.col("text").alias("query_id"), "text")


PART_SQL = """pt AS (SELECT DISTINCT CAST(p_partkey AS VARCHAR) AS id, unnest([p_name, p_brand, p_type || '/' || p_brand]) AS term FROM part),
pq AS (SELECT DISTINCT t AS query_id FROM (SELECT upper(p_type) AS t FROM part UNION ALL SELECT p_brand || '  ' || p_type FROM part UNION ALL SELECT lower(p_type) || '-' || p_brand FROM part UNION ALL SELECT substr(p_name, 2, 4) FROM part UNION ALL SELECT upper(p_name) FROM part))"""


def _lexical_sql(breaks: bool) -> str:
    return f"""{PART_SQL},
xq AS (SELECT query_id, {sql_normal("query_id")} AS q, list_distinct({sql_tokens("query_id", breaks)}) AS qt FROM pq),
xt AS (SELECT DISTINCT {sql_normal("term")} AS t, list_distinct({sql_tokens("term", breaks)}) AS tt FROM pt),
xp AS (SELECT query_id, t, greatest(len(list_intersect(qt, tt))::DOUBLE / len(list_distinct(list_concat(qt, tt))), CASE WHEN q = t THEN 1.0 WHEN contains(q, t) OR contains(t, q) THEN 0.85 ELSE 0.0 END) AS score FROM xq, xt WHERE len(qt) > 0),
xs AS (SELECT query_id, id, max(score) AS score FROM xp JOIN (SELECT id, {sql_normal("term")} AS t FROM pt) USING (t) WHERE score > 0 GROUP BY ALL),
xr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM xs)"""


@query(f"WITH {_lexical_sql(True)} SELECT query_id, id, score, source FROM (SELECT *, 'sparse' AS source FROM xr) WHERE rank <= 5")
def lexical_search(spark, sf_dir):
    p = _parts(spark, sf_dir)
    docs = p.select(F.col("rxcui").alias("id"), F.col("name").alias("text"), F.col("synonyms").alias("aliases"))
    return search.sparse_search(_part_queries(spark, sf_dir), docs, 5, bm25=False).select("query_id", "id", "score", "source")


@query(f"WITH {_lexical_sql(False)} SELECT query_id, id, score FROM xr WHERE rank <= 5")
def drug_search(spark, sf_dir):
    return search.term_search(_part_queries(spark, sf_dir), _parts(spark, sf_dir)).select("query_id", "id", "score")


@query(f"WITH {_lexical_sql(False)} SELECT query_id, id FROM xr WHERE rank <= 3 AND score >= 0.1 AND NOT (SELECT max(score) FROM xr b WHERE b.query_id = xr.query_id) - score > 0.15")
def drug_candidates(spark, sf_dir):
    from termweave.operators.link import link_drugs

    linked = link_drugs(_part_queries(spark, sf_dir), _parts(spark, sf_dir))
    return linked.select("query_id", F.explode("candidates").alias("id"))


@query(f"WITH {PART_SQL} SELECT DISTINCT query_id, id AS rxcui FROM pq JOIN pt ON {sql_normal('query_id')} = {sql_normal('term')}")
def rx_exact(spark, sf_dir):
    return search.exact_terms(_part_queries(spark, sf_dir), _parts(spark, sf_dir))


@query("""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
n AS (SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS n FROM v),
s AS (SELECT q.vec_id AS query_id, d.vec_id AS id, round(list_inner_product(q.e, d.e) / (q.n * d.n), 6) AS score FROM n q, n d WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, CAST(id AS VARCHAR)) AS rank FROM s WHERE score > 0)
SELECT CAST(query_id AS VARCHAR) AS query_id, CAST(id AS VARCHAR) AS id, score FROM r WHERE rank <= 5""")
def dense_topk(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    vectors = v.select(F.col("vec_id").cast("string").alias("id"), "embedding")
    asked = v.where("vec_id % 50 = 0").select(F.col("vec_id").cast("string").alias("query_id"), "embedding")
    return search.vector_search(asked, vectors, 5, digits=6).select("query_id", "id", F.round("score", 6).alias("score"))


def _customer_results(spark: SparkSession, sf_dir: str, later: bool) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    c = c.where(F.col("c_mktsegment").isin("BUILDING", "MACHINERY")) if later else c.where(F.col("c_mktsegment") != "MACHINERY")
    score = F.abs("c_acctbal") / (8000 if later else 10000)
    return c.select(F.col("c_nationkey").cast("string").alias("query_id"), F.col("c_custkey").cast("string").alias("id"), score.alias("score"), F.when(F.lit(later), F.upper("c_name")).otherwise(F.col("c_name")).alias("text"), F.lit("dense" if later else "sparse").alias("source"))


@query("""WITH a AS (SELECT c_nationkey::VARCHAR AS query_id, c_custkey::VARCHAR AS id, abs(c_acctbal) / 10000 AS score, c_name AS text FROM customer WHERE c_mktsegment <> 'MACHINERY'),
b AS (SELECT c_nationkey::VARCHAR AS query_id, c_custkey::VARCHAR AS id, abs(c_acctbal) / 8000 AS score, upper(c_name) AS text FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY'))
SELECT query_id, id, greatest(coalesce(a.score, b.score), coalesce(b.score, a.score)) AS score, coalesce(b.text, a.text) AS text, CASE WHEN a.id IS NULL THEN 'dense' WHEN b.id IS NULL THEN 'sparse' ELSE 'ensemble' END AS source FROM a FULL JOIN b USING (query_id, id)""")
def ensemble_merge(spark, sf_dir):
    return search.ensemble(_customer_results(spark, sf_dir, False), _customer_results(spark, sf_dir, True))


@query("""WITH o AS (SELECT o_custkey::VARCHAR AS query_id, o_orderpriority AS id, o_totalprice / 1e6 * [1.0, 0.9, 0.75, 0.2][CAST(o_orderkey % 4 + 1 AS INT)]::DOUBLE AS score, o_orderkey AS q_ord FROM orders)
SELECT query_id, id, score, q_ord::VARCHAR AS text FROM (SELECT *, row_number() OVER (PARTITION BY query_id, id ORDER BY score DESC, q_ord) AS n FROM o) WHERE n = 1""")
def variant_merge(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    weight = F.get(F.array(*map(F.lit, (1.0, 0.9, 0.75, 0.2))), (F.col("o_orderkey") % 4).cast("int"))
    rows = o.select(F.col("o_custkey").cast("string").alias("query_id"), F.col("o_orderpriority").alias("id"), (F.col("o_totalprice") / 1e6).alias("score"), F.col("o_orderkey").cast("string").alias("text"), F.lit("x").alias("source"), F.col("o_orderkey").alias("q_ord"), weight.alias("q_weight"))
    return search.merge_variants(rows).select("query_id", "id", "score", "text")


@query("""WITH q AS (SELECT p_partkey, lower(p_name) AS t, lower(p_type || ' viem benh ' || p_name) AS r FROM part)
SELECT p_partkey::VARCHAR AS query_id, s.n::VARCHAR AS id FROM q, (SELECT n_nationkey AS n FROM nation) s WHERE s.n = p_partkey % 25 AND (len(list_filter(regexp_extract_all(t, '[a-z0-9]+'), lambda x: length(x) > 1)) = 0 OR s.n % 2 = 0)""")
def token_guard(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    asked = p.select(F.col("p_partkey").cast("string").alias("query_id"), F.col("p_name").alias("text"))
    shown = F.when(F.col("p_partkey") % 25 % 2 == 0, F.concat_ws(" ", "p_type", F.lit("viem benh"), "p_name")).otherwise(F.lit("viem benh z"))
    results = p.select(F.col("p_partkey").cast("string").alias("query_id"), (F.col("p_partkey") % 25).cast("string").alias("id"), shown.alias("text"))
    return search.token_guard(results, asked).select("query_id", "id")


@query("SELECT p_partkey::VARCHAR AS query_id FROM part WHERE p_size % 3 = 0 OR contains(lower(p_name), 'ing') OR contains(lower(p_name), 'red')")
def must_have_guard(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    results = p.select(F.col("p_partkey").cast("string").alias("query_id"), F.upper("p_name").alias("text"))
    words = F.when(F.col("p_size") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("ÍNG"), F.lit("Red")))
    return search.must_have(results, p.select(F.col("p_partkey").cast("string").alias("query_id"), words.alias("must_have"))).select("query_id")


@query("""WITH s AS (SELECT l_orderkey::VARCHAR AS query_id, l_linenumber || '-' || l_partkey || '-' || l_suppkey AS id, l_discount * 10 AS score FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank, max(score) OVER (PARTITION BY query_id) AS best FROM s WHERE score >= 0.1)
SELECT query_id, id, score, rank FROM r WHERE rank <= 3 AND best - score <= 0.15""")
def dynamic_threshold(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("query_id"), F.concat_ws("-", "l_linenumber", "l_partkey", "l_suppkey").alias("id"), (F.col("l_discount") * 10).alias("score"))
    return search.dynamic_threshold(rows).select("query_id", "id", "score", F.col("rank").cast("long").alias("rank"))


PART_BM25_SQL = f"""bd AS (SELECT CAST(p_partkey AS VARCHAR) AS id, {sql_tokens("concat_ws(' ', p_name, p_brand, p_type || '/' || p_brand)")} AS l FROM part),
bp AS (SELECT token, id, size, count(*) AS n FROM (SELECT id, len(l) AS size, unnest(l) AS token FROM bd) GROUP BY ALL),
bg AS (SELECT count(*) AS docs, avg(len(l)) AS mean FROM bd),
bi AS (SELECT token, ln(docs - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM bp, bg GROUP BY token, docs),
bj AS (SELECT token, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM bi) ELSE raw END AS idf FROM bi),
bq AS (SELECT query_id, unnest({sql_tokens("query_id")}) AS token FROM pq),
bs AS (SELECT query_id, bp.id, sum(idf * n * 2.5 / (n + 1.5 * (0.25 + 0.75 * size / mean))) AS raw FROM bq JOIN bj USING (token) JOIN bp USING (token), bg GROUP BY ALL),
bt AS (SELECT query_id, id, CASE WHEN max(raw) OVER (PARTITION BY query_id) > 0 THEN raw / max(raw) OVER (PARTITION BY query_id) ELSE 0 END AS score FROM bs),
bx AS (SELECT query_id, id, max(score) AS score FROM (SELECT query_id, id, score FROM bt UNION ALL SELECT query_id, id, score FROM xs) GROUP BY ALL),
br AS (SELECT query_id, id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, id) AS rank FROM bx WHERE score > 0)"""


@query(f"WITH {_lexical_sql(True)}, {PART_BM25_SQL} SELECT query_id, score, count(*) AS n FROM br WHERE rank <= 5 GROUP BY ALL")
def bm25_and_lexical(spark, sf_dir):
    p = _parts(spark, sf_dir)
    docs = p.select(F.col("rxcui").alias("id"), F.col("name").alias("text"), F.col("synonyms").alias("aliases"))
    found = search.sparse_search(_part_queries(spark, sf_dir), docs, 5)
    # equal scores differ in their last bits from engine to engine, which changes the choice
    # among equals; how many results have which score does not depend on it
    return found.groupBy("query_id", F.round("score", 6).alias("score")).agg(F.count(F.lit(1)).alias("n"))


# -- trees -----------------------------------------------------------------------------------


def geography(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree of regions, nations and customers."""
    r, n, c = (table(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    rows = spark.createDataFrame([("ROOT", "World", None, 0)], "code string, name string, parent_code string, level int")
    rows = rows.union(r.select(F.concat(F.lit("R"), "r_regionkey"), "r_name", F.lit("ROOT"), F.lit(1)))
    rows = rows.union(n.select(F.concat(F.lit("N"), "n_nationkey"), "n_name", F.concat(F.lit("R"), "n_regionkey"), F.lit(2)))
    return rows.union(c.select(F.concat(F.lit("C"), "c_custkey"), "c_name", F.concat(F.lit("N"), "c_nationkey"), F.lit(3))).withColumn("aliases", F.array().cast("array<string>"))


GEO_SQL = """g AS (SELECT 'ROOT' AS code, NULL AS parent UNION ALL SELECT 'R' || r_regionkey, 'ROOT' FROM region UNION ALL SELECT 'N' || n_nationkey, 'R' || n_regionkey FROM nation UNION ALL SELECT 'C' || c_custkey, 'N' || c_nationkey FROM customer),
h AS (SELECT 'C' || c_custkey AS code, c_custkey AS k, c_nationkey AS n, n_regionkey AS r FROM customer JOIN nation ON n_nationkey = c_nationkey)"""


@query(f"WITH {GEO_SQL} SELECT code, 'ROOT/R' || r || '/N' || n || '/' || code AS path, 3 AS depth FROM h UNION ALL SELECT 'N' || n_nationkey, 'ROOT/R' || n_regionkey || '/N' || n_nationkey, 2 FROM nation UNION ALL SELECT 'R' || r_regionkey, 'ROOT/R' || r_regionkey, 1 FROM region UNION ALL SELECT 'ROOT', 'ROOT', 0")
def tree_paths(spark, sf_dir):
    return tree.tree_paths(geography(spark, sf_dir)).select("code", F.array_join("path", "/").alias("path"), "depth")


@query(f"""WITH {GEO_SQL}, p AS (SELECT a.code, b.code AS other, CASE WHEN a.n = b.n THEN 2 WHEN a.r = b.r THEN 1 ELSE 0 END AS d, CASE WHEN a.n = b.n THEN 'N' || a.n WHEN a.r = b.r THEN 'R' || a.r ELSE 'ROOT' END AS lca FROM h a JOIN h b ON b.k = a.k + 1)
SELECT code, other, lca, 6 - 2 * d AS distance, d / 3.0::DOUBLE AS similarity, round(exp(-0.7 * (1 - d / 3.0::DOUBLE)), 9) AS penalty FROM p""")
def tree_lca(spark, sf_dir):
    paths = tree.tree_paths(geography(spark, sf_dir))
    pairs = table(spark, sf_dir, "customer").select(F.concat(F.lit("C"), "c_custkey").alias("code"), F.concat(F.lit("C"), (F.col("c_custkey") + 1).cast("string")).alias("other"))
    both = pairs.join(paths.select("code", F.col("path").alias("a")), "code").join(paths.select(F.col("code").alias("other"), F.col("path").alias("b")), "other")
    a, b = F.col("a"), F.col("b")
    return both.select("code", "other", scores.common_ancestor(a, b).alias("lca"), scores.tree_distance(a, b).alias("distance"), scores.wu_palmer(a, b).alias("similarity"), F.round(scores.ontology_penalty(a, b), 9).alias("penalty"))


@query("SELECT (SELECT count(*) FROM region) + (SELECT count(*) FROM nation) + (SELECT count(*) FROM customer) + 1 AS nodes, (SELECT count(*) FROM region) + (SELECT count(*) FROM nation) + (SELECT count(*) FROM customer) AS edges, 3::BIGINT AS max_depth, true AS is_tree")
def tree_valid(spark, sf_dir):
    return tree.tree_check(geography(spark, sf_dir)).select("nodes", "edges", "max_depth", "is_tree")


@query(f"""WITH {GEO_SQL}, c AS (SELECT (o_orderkey // 6)::VARCHAR AS query_id, CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE '' END || 'C' || o_custkey AS code, o_totalprice / 500000 AS score, o_orderkey AS ord FROM orders),
u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, code ORDER BY ord) AS i FROM c) WHERE i = 1),
k AS (SELECT u.*, h.n, h.r FROM u JOIN h USING (code)),
a AS (SELECT query_id, code AS a_code, n AS a_n, r AS a_r FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ord) AS b FROM k) WHERE b = 1),
s AS (SELECT k.query_id, k.code, score, CASE WHEN code = a_code THEN 1.0 WHEN n = a_n THEN 2 / 3.0 WHEN r = a_r THEN 1 / 3.0 ELSE 0.0 END::DOUBLE AS near, CASE WHEN code = a_code THEN 0 WHEN n = a_n THEN 2 WHEN r = a_r THEN 4 ELSE 6 END AS distance FROM k JOIN a USING (query_id))
SELECT query_id, code, near AS ontology_score, round(0.7 * score + 0.3 * near, 9) AS final_score, distance, row_number() OVER (PARTITION BY query_id ORDER BY 0.7 * score + 0.3 * near DESC, code) AS rank FROM s WHERE code IS NOT NULL AND near >= 0.5 AND distance <= 4""")
def prune(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    code = F.concat(F.when(F.col("o_orderkey") % 7 == 0, "X").otherwise(""), F.lit("C"), "o_custkey")
    rows = o.select(F.expr("cast(o_orderkey div 6 as string)").alias("query_id"), F.col("o_orderkey").alias("ord"), code.alias("code"), (F.col("o_totalprice") / 500000).alias("score"))
    done = tree.prune(rows, tree.tree_paths(geography(spark, sf_dir)))
    return done.select("query_id", "code", "ontology_score", F.round("final_score", 9).alias("final_score"), "distance", F.col("rank").cast("long").alias("rank"))


# -- tables ----------------------------------------------------------------------------------


@query("""WITH a AS (SELECT p_brand AS code, p_type || ' ' || CASE WHEN p_size % 2 = 0 THEN upper(p_name) ELSE p_name END AS alias, p_partkey AS ord FROM part),
r AS (SELECT *, row_number() OVER (PARTITION BY code, lower(alias) ORDER BY ord) AS n FROM a)
SELECT code, string_agg(alias, '|' ORDER BY ord) AS aliases FROM r WHERE n = 1 GROUP BY code""")
def alias_merge(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    nodes = p.select(F.col("p_brand").alias("code")).distinct().withColumn("aliases", F.array().cast("array<string>"))
    name = F.when(F.col("p_size") % 2 == 0, F.upper("p_name")).otherwise(F.col("p_name"))
    done = etl.merge_aliases(nodes, p.select(F.col("p_brand").alias("code"), F.concat_ws(" ", "p_type", name).alias("alias"), F.col("p_partkey").alias("ord")))
    return done.select("code", F.array_join("aliases", "|").alias("aliases"))


TTYS = ["IN", "SCD", "BN", "ZZ", "PIN"]
RANKS = "CASE tty WHEN 'IN' THEN 0 WHEN 'PIN' THEN 2 WHEN 'BN' THEN 3 WHEN 'SCD' THEN 4 ELSE 99 END"


def part_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Concept lines made of parts."""
    empty = [F.lit("")] * 18
    fields = dict(enumerate(empty))
    fields |= {
        0: F.regexp_replace("p_brand", "[^0-9]", ""), 1: F.when(F.col("p_size") % 10 == 0, "SPA").otherwise("ENG"), 12: F.get(F.array(*map(F.lit, TTYS)), (F.col("p_partkey") % 5).cast("int")),
        14: F.concat(F.lit(" "), "p_name", F.lit("  "), F.col("p_type")), 16: F.when(F.col("p_partkey") % 11 == 0, "O").otherwise("N"),
    }
    return table(spark, sf_dir, "part").select(F.concat_ws("|", *[fields[k] for k in range(18)]).alias("value"))


RRF_SQL = f"t AS (SELECT regexp_replace(p_brand, '[^0-9]', '', 'g') AS rxcui, [{', '.join(f'{x!r}' for x in TTYS)}][CAST(p_partkey % 5 + 1 AS INT)] AS tty, p_name || ' ' || p_type AS term FROM part WHERE p_size % 10 <> 0 AND p_partkey % 11 <> 0)"


@query(f"WITH {RRF_SQL} SELECT rxcui, tty, term, count(*) AS n FROM t GROUP BY ALL")
def rrf_terms(spark, sf_dir):
    return files.rrf_terms(part_lines(spark, sf_dir)).groupBy("rxcui", "tty", "term").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {RRF_SQL}, o AS (SELECT rxcui, tty, term, row_number() OVER (PARTITION BY rxcui, lower(term) ORDER BY {RANKS}, length(term), lower(term), term, tty) AS n FROM t),
r AS (SELECT rxcui, tty, term, row_number() OVER (PARTITION BY rxcui ORDER BY {RANKS}, length(term), lower(term), term, tty) AS rank FROM o WHERE n = 1)
SELECT rxcui, max(term) FILTER (rank = 1) AS name, max(tty) FILTER (rank = 1) AS tty, coalesce(string_agg(term, '|' ORDER BY rank) FILTER (rank BETWEEN 2 AND 101), '') AS synonyms FROM r GROUP BY rxcui""")
def rx_group(spark, sf_dir):
    return etl.group_terms(files.rrf_terms(part_lines(spark, sf_dir))).select("rxcui", "name", "tty", F.array_join("synonyms", "|").alias("synonyms"))


# -- scores and comparisons ------------------------------------------------------------------


def turn_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adjacent turns of conversations as word lists."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", text.words_of(text.squeeze("text")).alias("a"))
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("a").alias("b"))
    return c.join(nxt, ["conv_id", "turn"])


TURNS = f"""w AS (SELECT conv_id, turn, list_filter(string_split(trim(regexp_replace(text, '{SQL_SPACE}+', ' ', 'g')), ' '), lambda x: x <> '') AS a FROM conversations),
p AS (SELECT w.conv_id, w.turn, w.a, v.a AS b FROM w JOIN w v ON v.conv_id = w.conv_id AND v.turn = w.turn + 1)"""


@query(f"WITH {TURNS} SELECT conv_id, turn, len(list_intersect(a, b))::DOUBLE / len(list_distinct(list_concat(a, b))) AS jaccard FROM p")
def jaccard_pairs(spark, sf_dir):
    return turn_pairs(spark, sf_dir).select("conv_id", "turn", scores.jaccard(F.col("a"), F.col("b")).alias("jaccard"))


@query(f"""WITH {TURNS}, e AS (SELECT conv_id, turn, len(a) AS n, list_reduce(b, lambda prev, x: list_reduce(range(1, len(a) + 1), lambda out, i: list_append(out, least(out[-1] + 1, prev[i + 1] + 1, prev[i] + CASE WHEN a[i] = x THEN 0 ELSE 1 END)), [prev[1] + 1]), range(0, len(a) + 1)) AS last FROM p)
SELECT conv_id, turn, last[-1]::DOUBLE / n AS wer FROM e""")
def wer_pairs(spark, sf_dir):
    return turn_pairs(spark, sf_dir).select("conv_id", "turn", scores.word_error_rate(F.col("a"), F.col("b")).alias("wer"))


@query(f"WITH {TURNS}, j AS (SELECT len(a) + 1 AS weight, len(list_intersect(a, b))::DOUBLE / len(list_distinct(list_concat(a, b))) AS j FROM p) SELECT round(avg(j), 9) AS plain, round(sum(weight * j) / sum(weight), 9) AS weighted, round(0.3 * avg(j) + 0.3 * avg(j) + 0.4 * sum(weight * j) / sum(weight), 9) AS final FROM j")
def final_scores(spark, sf_dir):
    pairs = turn_pairs(spark, sf_dir).select(F.array_distinct("a").alias("truth"), F.array_distinct("b").alias("prediction"), F.size("a").alias("n"))
    j = scores.jaccard(F.col("truth"), F.col("prediction"))
    one = pairs.agg(F.avg(j).alias("plain"), (F.sum((F.col("n") + 1) * j) / F.sum(F.col("n") + 1)).alias("weighted"))
    return one.select(F.round("plain", 9).alias("plain"), F.round("weighted", 9).alias("weighted"), F.round(scores.final_score(F.col("plain"), F.col("plain"), F.col("weighted")), 9).alias("final"))


def runs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two runs made of order lines that mostly agree."""
    base = table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") % 500).cast("string").alias("file"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"), F.col("l_returnflag").alias("text"), F.when(F.col("l_linestatus") == "F", DIAGNOSIS).otherwise(DRUG).alias("type"),
        (F.col("l_partkey") % 50).cast("int").alias("start"), (F.col("l_partkey") % 50 + 1).cast("int").alias("end"), F.array((F.col("l_suppkey") % 3).cast("string")).alias("candidates"), "l_orderkey", "l_partkey", "l_suppkey",
    )
    keep = lambda f: f.drop("l_orderkey", "l_partkey", "l_suppkey")
    changed = F.when(F.col("l_suppkey") % 5 == 0, F.array(F.lit("z"))).otherwise(F.col("candidates"))
    return keep(base.where("l_orderkey % 9 <> 0")), keep(base.where("l_orderkey % 11 <> 0").withColumn("candidates", changed))


RUN_SQL = f"""l AS (SELECT (l_orderkey % 500)::VARCHAR AS file, l_orderkey * 10 + l_linenumber AS ord, l_returnflag AS text, CASE WHEN l_linestatus = 'F' THEN '{DIAGNOSIS}' ELSE '{DRUG}' END AS type, l_partkey % 50 AS s, (l_suppkey % 3)::VARCHAR AS c, l_orderkey, l_suppkey, l_partkey FROM lineitem),
b AS (SELECT * FROM l WHERE l_orderkey % 9 <> 0), a AS (SELECT * REPLACE (CASE WHEN l_suppkey % 5 = 0 THEN 'z' ELSE c END AS c) FROM l WHERE l_orderkey % 11 <> 0)"""


@query(f"WITH {RUN_SQL} SELECT type, count(*) AS n FROM a GROUP BY type")
def count_by_type(spark, sf_dir):
    return diff.count_by_type(runs(spark, sf_dir)[1])


@query(f"WITH {RUN_SQL}, x AS (SELECT type, count(*) AS n FROM b GROUP BY type), y AS (SELECT type, count(*) AS n FROM a GROUP BY type) SELECT type, coalesce(x.n, 0) AS before, coalesce(y.n, 0) AS after, coalesce(y.n, 0) - coalesce(x.n, 0) AS delta FROM x FULL JOIN y USING (type)")
def run_diff_counts(spark, sf_dir):
    return diff.type_counts(*runs(spark, sf_dir))


@query(f"WITH {RUN_SQL} SELECT file, ord, text, type FROM a WHERE (file, text, type, s) NOT IN (SELECT file, text, type, s FROM b)")
def run_diff_added(spark, sf_dir):
    return diff.added(*runs(spark, sf_dir)).select("file", "ord", "text", "type")


@query(f"WITH {RUN_SQL} SELECT file, ord, text, type FROM b WHERE (file, text, type, s) NOT IN (SELECT file, text, type, s FROM a)")
def run_diff_dropped(spark, sf_dir):
    return diff.dropped(*runs(spark, sf_dir)).select("file", "ord", "text", "type")


@query(f"WITH {RUN_SQL}, o AS (SELECT file, text, type, s, max(ord) AS ord FROM b GROUP BY ALL), p AS (SELECT file, text, type, s, min(c) AS old FROM b JOIN o USING (file, text, type, s, ord) GROUP BY ALL) SELECT file, a.ord, text, old, c AS new FROM a JOIN p USING (file, text, type, s) WHERE old <> c")
def run_diff_changed(spark, sf_dir):
    # lines that share order and number are told apart by nothing else than their candidates
    before, after = runs(spark, sf_dir)
    rows = diff.changed(before.withColumn("ord", F.struct("ord", (-F.get("candidates", F.lit(0)).cast("int")).alias("c"))), after)
    return rows.select("file", "ord", "text", F.get("old", F.lit(0)).alias("old"), F.get("candidates", F.lit(0)).alias("new"))


SUSPECTS = ["Gan", "phẫu thuật tim", "hội chứng x", "hội chứng Parkinson", "u  mật", "ho"]


@query(f"""WITH t AS (SELECT p_partkey, [{", ".join(f"'{x}'" for x in SUSPECTS)}][CAST(p_partkey % {len(SUSPECTS)} + 1 AS INT)] AS text, CASE WHEN p_size % 4 = 0 THEN '{DRUG}' ELSE '{DIAGNOSIS}' END AS type, CASE WHEN p_size % 2 = 0 THEN 'G20.C' ELSE 'C73' END AS c FROM part)
SELECT p_partkey, CASE text WHEN 'Gan' THEN 'generic diagnosis' WHEN 'phẫu thuật tim' THEN 'procedure as diagnosis' WHEN 'hội chứng x' THEN 'syndrome mapped to Parkinson' ELSE 'biliary text mapped to thyroid' END AS reason
FROM t WHERE type = '{DIAGNOSIS}' AND (text IN ('Gan', 'phẫu thuật tim') OR text = 'hội chứng x' AND c = 'G20.C' OR text = 'u  mật' AND c = 'C73')""")
def suspicious_rows(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    rows = p.select("p_partkey", F.get(F.array(*map(F.lit, SUSPECTS)), (F.col("p_partkey") % len(SUSPECTS)).cast("int")).alias("text"), F.when(F.col("p_size") % 4 == 0, DRUG).otherwise(DIAGNOSIS).alias("type"), F.array(F.when(F.col("p_size") % 2 == 0, "G20.C").otherwise("C73")).alias("candidates"))
    return diff.suspicious(rows).select("p_partkey", "reason")


def made_submissions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Submissions for conversation turns, each of one entity with one fault or none."""
    c = table(spark, sf_dir, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("doc_id"), F.concat(F.coalesce("text", F.lit("")), F.lit(" end.")).alias("text"), (F.col("conv_id") * 7 + F.col("turn")).alias("k"))
    first = F.to_json(F.struct(F.substr(F.col("text"), F.lit(1), F.lit(3)).alias("t")))
    first = F.regexp_replace(first, r"^\{\"t\":|\}$", "")
    kind = F.when(F.col("k") % 12 == 1, "OTHER").when(F.col("k") % 12 == 2, TEST).otherwise(SYMPTOM)
    marks = F.when(F.col("k") % 12 == 2, '["isNegated"]').when(F.col("k") % 12 == 3, '["x"]').when(F.col("k") % 12 == 4, "5").otherwise("[]")
    codes = F.when(F.col("k") % 12 == 5, '["A"]').when(F.col("k") % 12 == 6, "[1]").otherwise("[]")
    place = F.when(F.col("k") % 12 == 7, "[0]").when(F.col("k") % 12 == 8, "[0, 999999]").when(F.col("k") % 12 == 9, "[0, 2]").otherwise("[0, 3]")
    extra = F.when(F.col("k") % 12 == 10, ', "more": 1').otherwise("")
    body = F.concat(F.lit('[{"text": '), first, F.lit(', "type": "'), kind, F.lit('", "candidates": '), codes, F.lit(', "assertions": '), marks, F.lit(', "position": '), place, extra, F.lit("}]"))
    body = F.when(F.col("k") % 12 == 11, "[{").otherwise(body)
    return c, c.select("doc_id", body.alias("body"))


FAULTS = "v AS (SELECT conv_id || '-' || turn AS doc_id, (conv_id * 7 + turn) % 12 AS f FROM conversations)"
FAULT_NAMES = "CASE f WHEN 1 THEN 'invalid_type' WHEN 2 THEN 'assertions_not_allowed' WHEN 3 THEN 'invalid_assertion' WHEN 4 THEN 'invalid_assertions' WHEN 5 THEN 'candidates_not_allowed' WHEN 6 THEN 'invalid_candidates' WHEN 7 THEN 'invalid_position' WHEN 8 THEN 'position_out_of_bounds' WHEN 9 THEN 'span_text_mismatch' WHEN 10 THEN 'extra_keys' WHEN 11 THEN 'invalid_json' END"


@query(f"WITH {FAULTS} SELECT doc_id || '.json' AS file, {FAULT_NAMES} AS code FROM v WHERE f > 0")
def validator_issues(spark, sf_dir):
    return validate.validate(*made_submissions(spark, sf_dir)).select("file", "code")


@query(f"WITH {FAULTS} SELECT count(*) AS checked_files, count(*) FILTER (f = 0) AS valid_files, count(*) FILTER (f > 0) AS invalid_files, count(*) FILTER (f > 0) AS issues FROM v")
def validator_summary(spark, sf_dir):
    docs, bodies = made_submissions(spark, sf_dir)
    return validate.summary(docs, validate.validate(docs, bodies))


@query(f"""WITH {LINE_SQL}, o AS (SELECT o_orderkey::VARCHAR AS doc_id FROM orders),
j AS (SELECT doc_id, '[' || string_agg('{{"text":"' || text || '","type":"' || type || '","candidates":[],"assertions":[' || CASE rich WHEN 0 THEN '' WHEN 1 THEN '"isNegated"' ELSE '"isNegated","isNegated"' END || '],"position":[' || s || ',' || e || ']}}', ',' ORDER BY ord, text, type) || ']' AS body FROM l GROUP BY doc_id)
SELECT o.doc_id, coalesce(body, '[]') AS body FROM o LEFT JOIN j USING (doc_id)""")
def submission_json(spark, sf_dir):
    docs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("doc_id"))
    return sinks.submissions(docs, line_entities(spark, sf_dir))


@query("""WITH v AS (SELECT conv_id || '-' || turn || '.json' AS file, substr(coalesce(text, '') || ' end.', 1, 3) AS text, (conv_id * 7 + turn) % 12 AS f FROM conversations)
SELECT file, text, CASE f WHEN 7 THEN -1 ELSE 0 END AS "start", CASE f WHEN 7 THEN -1 WHEN 8 THEN 999999 WHEN 9 THEN 2 ELSE 3 END AS "end", CASE f WHEN 5 THEN 'A' WHEN 6 THEN '1' ELSE '' END AS candidates FROM v WHERE f <> 11""")
def saved_entities(spark, sf_dir):
    _, bodies = made_submissions(spark, sf_dir)
    rows = files.saved_entities(bodies.select(F.concat("doc_id", F.lit(".json")).alias("file"), "body"))
    return rows.select("file", "text", "start", "end", F.array_join("candidates", ",").alias("candidates"))


@query(f"WITH {GEO_SQL} SELECT g.code, coalesce(g.parent, '') AS parent_code, CASE WHEN g.code = 'ROOT' THEN 0 WHEN g.code[1] = 'R' THEN 1 WHEN g.code[1] = 'N' THEN 2 ELSE 3 END AS depth, (SELECT count(*) FROM g) - 1 AS n_edges FROM g")
def graph_export(spark, sf_dir):
    nodes = geography(spark, sf_dir)
    table_, edges = sinks.graph_tables(nodes, tree.tree_paths(nodes))
    n = edges.agg(F.count(F.lit(1)).alias("n_edges"))
    return table_.select("code", "parent_code", "depth").join(F.broadcast(n))  # one row


@query(f"""WITH {LINE_SQL}, t AS (SELECT doc_id, ord, rich, [{", ".join(f"'{x}'" for x in [*TYPES, "OTHER"])}][CAST(ord % 6 + 1 AS INT)] AS type FROM l)
SELECT doc_id, ord, type, CASE WHEN type = 'OTHER' THEN 'type' WHEN type IN ('{TYPES[1]}', '{TYPES[2]}') AND rich > 0 THEN 'assertions_not_allowed' ELSE '' END AS faults FROM t""")
def entity_schema(spark, sf_dir):
    from termweave.schema import entity_faults

    kinds = F.array(*map(F.lit, [*TYPES, "OTHER"]))
    rows = line_entities(spark, sf_dir).withColumn("type", F.get(kinds, (F.col("ord") % 6).cast("int")))
    faults = entity_faults(*map(F.col, ("text", "position", "type", "assertions", "candidates")))
    return rows.select("doc_id", "ord", "type", F.array_join(faults, ",").alias("faults"))


@query("""WITH e AS (SELECT p_partkey::VARCHAR AS id, p_name AS m, CASE WHEN p_size % 3 = 0 THEN '' ELSE p_type END AS en, p_brand AS syn, CASE WHEN p_size % 2 = 0 THEN '' ELSE 'site' END AS site FROM part),
v AS (SELECT id, 0 AS o, en AS q, 1.0 AS w FROM e WHERE en <> '' UNION ALL SELECT id, 1, syn, 0.9 FROM e WHERE en <> '' UNION ALL SELECT id, 2, en || ' ' || site, 0.75 FROM e WHERE en <> '' AND site <> ''
  UNION ALL SELECT id, 3, m, 0.2 FROM e WHERE en <> '' UNION ALL SELECT id, 0, m, 1.0 FROM e WHERE en = '')
SELECT id AS query_id, row_number() OVER (PARTITION BY id ORDER BY o) - 1 AS q_ord, q AS q_text, w::DOUBLE AS q_weight FROM v""")
def query_variants(spark, sf_dir):
    from termweave.operators.expand import weighted_queries

    p = table(spark, sf_dir, "part")
    made = F.struct(F.when(F.col("p_size") % 3 == 0, "").otherwise(F.col("p_type")).alias("english"), F.array("p_brand").alias("synonyms"), F.when(F.col("p_size") % 2 == 0, "").otherwise("site").alias("site"))
    rows = weighted_queries(p.select(F.col("p_partkey").cast("string").alias("query_id"), F.col("p_name").alias("text"), made.alias("expansion")))
    return rows.withColumn("q_ord", F.col("q_ord").cast("long"))


@query(f"""WITH {TURNS}, e AS (SELECT len(a) AS n, list_reduce(b, lambda prev, x: list_reduce(range(1, len(a) + 1), lambda out, i: list_append(out, least(out[-1] + 1, prev[i + 1] + 1, prev[i] + CASE WHEN a[i] = x THEN 0 ELSE 1 END)), [prev[1] + 1]), range(0, len(a) + 1)) AS last FROM p)
SELECT round(avg(1 - last[-1]::DOUBLE / n), 9) AS score FROM e""")
def text_score(spark, sf_dir):
    pairs = turn_pairs(spark, sf_dir).select(F.array_join("a", " ").alias("reference"), F.array_join("b", " ").alias("hypothesis"))
    return metrics.text_score(pairs).select(F.round("score", 9).alias("score"))


# -- end to end ------------------------------------------------------------------------------

SAMPLE_NODES = [("ROOT", "ICD-10", None, 0, []), ("E10-E14", "Diabetes mellitus", "ROOT", 1, []), ("E11", "Type 2 diabetes mellitus", "E10-E14", 2, ["đái tháo đường tuýp 2"]), ("A00", "Cholera", "ROOT", 1, ["tả", "bệnh tả"])]
SAMPLE_CONCEPTS = [("1191", "Aspirin", "IN", ["ASA"]), ("243670", "aspirin 81 MG Oral Tablet", "SCD", ["aspirin 81 mg"])]
SENTENCE = "Bệnh nhân có tiền sử đái tháo đường tuýp 2, hiện không ho và dùng Aspirin."


@query(CHUNK_SQL + f""", h AS (SELECT doc_id, chunk_index, unnest(range(s, e - 1)) AS i, text FROM c WHERE chunk_index >= 0),
f AS (SELECT doc_id, chunk_index, i, row_number() OVER (PARTITION BY doc_id, chunk_index ORDER BY i) - 1 AS k FROM h WHERE substr(text, CAST(i + 1 AS BIGINT), 2) = 'ho')
SELECT doc_id, chunk_index * 4294967296 + k AS ord, 'ho' AS text, i AS "start", i + 2 AS "end", '{SYMPTOM}' AS type, '' AS assertions, '' AS candidates FROM f
UNION ALL VALUES ('note', 0, 'đái tháo đường tuýp 2', 21, 42, '{DIAGNOSIS}', 'isHistorical', 'E11'), ('note', 2, 'Aspirin', 66, 73, '{DRUG}', 'isNegated', '1191'), ('note', 3, 'ho', 55, 57, '{SYMPTOM}', 'isNegated', '')""")
def flagship_link(spark, sf_dir):
    """Documents and one clinical sentence, through the whole plan."""
    from termweave.operators.link import Knowledge
    from termweave.plans.linking import linked

    nodes = spark.createDataFrame(SAMPLE_NODES, "code string, name string, parent_code string, level int, aliases array<string>")
    concepts = spark.createDataFrame(SAMPLE_CONCEPTS, "rxcui string, name string, tty string, synonyms array<string>")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    docs = docs.unionByName(spark.createDataFrame([("note", SENTENCE)], "doc_id string, text string"))
    rows = linked(docs, RuleExtractor(), Knowledge(nodes, concepts))
    place = [F.get("position", F.lit(k)).cast("long").alias(n) for k, n in enumerate(("start", "end"))]
    return rows.select("doc_id", "ord", "text", *place, "type", *[F.array_join(c, ",").alias(c) for c in ("assertions", "candidates")])


def sql_rules() -> str:
    """The rule expander as one CASE over a text ``t`` and its bare form ``b``."""
    from termweave.operators.expand import RULES

    def quoted(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"

    def fits(rule) -> str:
        if not rule.is_pattern:
            return f"contains(b, {quoted(rule.find)})"
        pattern = quoted("(?i)" + re.sub(r"\\u([0-9a-f]{4})", lambda m: chr(int(m[1], 16)), rule.find))
        return f"regexp_matches(t, {pattern}) OR regexp_matches(b, {pattern})"

    return "CASE " + " ".join(f"WHEN {fits(r)} THEN {k}" for k, r in enumerate(RULES)) + " ELSE -1 END"


@query(f"""WITH d AS (SELECT doc_id, trim(regexp_replace(text, '^{SQL_SPACE}+|{SQL_SPACE}+$', '', 'g')) AS t FROM documents), e AS (SELECT doc_id, t, replace(strip_accents({sql_fold('t')}), 'đ', 'd') AS b FROM d),
r AS (SELECT doc_id, {sql_rules()} AS k FROM e), n AS (SELECT * FROM (VALUES {", ".join(f"({k}, '{r.english}', '{r.site}', {len(r.synonyms)}, {len(r.must_have)})" for k, r in enumerate(RULES))}) AS v(k, english, site, synonyms, must_have))
SELECT CAST(doc_id AS VARCHAR) AS query_id, coalesce(english, '') AS english, coalesce(site, '') AS site, coalesce(synonyms, 0)::BIGINT AS n_synonyms, coalesce(must_have, 0)::BIGINT AS n_must_have, CASE WHEN k < 0 THEN 'low' ELSE 'high' END AS confidence FROM r LEFT JOIN n USING (k)""")
def expansion_rules(spark, sf_dir):
    """Expansions of whole documents as mentions."""
    from termweave.operators.expand import expand

    mentions = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("query_id"), "text")
    sizes = [F.size(f"expansion.{c}").cast("long").alias(f"n_{c}") for c in ("synonyms", "must_have")]
    return expand(mentions).select("query_id", "expansion.english", "expansion.site", *sizes, "expansion.confidence")


# -- tables read, written and made -----------------------------------------------------------


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/termweave/{name}-{uuid.uuid4().hex}"
    drop_at_end(spark, path)
    return path


@query(f"WITH {GEO_SQL} SELECT code, parent AS parent_code, CASE code[1] WHEN 'C' THEN 3 WHEN 'N' THEN 2 WHEN 'R' THEN CASE WHEN code = 'ROOT' THEN 0 ELSE 1 END END AS level, CASE WHEN code[1] = 'C' THEN 'a \"x\", b|c' ELSE '' END AS aliases FROM g")
def code_tables(spark, sf_dir):
    """A code table written as CSV and read again."""
    path = scratch_path(spark, "codes")
    nodes = geography(spark, sf_dir)
    listed = F.when(F.startswith("code", F.lit("C")), F.array(F.lit('a "x", b'), F.lit("c"))).otherwise(F.array().cast("array<string>"))
    sinks.write_table(nodes.withColumn("aliases", listed), path)
    return files.read_codes(spark, path).select("code", "parent_code", "level", F.array_join("aliases", "|").alias("aliases"))


@query("SELECT p_partkey::VARCHAR AS rxcui, p_name AS name, p_brand AS tty, p_type || '|' || p_brand AS synonyms FROM part")
def concept_tables(spark, sf_dir):
    """A drug table written as CSV and read again."""
    path = scratch_path(spark, "concepts")
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("rxcui"), F.concat(F.lit(" "), "p_name").alias("name"), F.col("p_brand").alias("tty"), F.array("p_type", F.lit(" "), "p_brand").alias("synonyms"))
    sinks.write_table(rows, path)
    return files.read_concepts(spark, path).select("rxcui", "name", "tty", F.array_join("synonyms", "|").alias("synonyms"))


@query("SELECT 'n' || n_nationkey AS doc_id, 'line 1 of ' || n_name || chr(10) || 'line 2' || chr(10) AS text FROM nation")
def text_files(spark, sf_dir):
    """Text files written by executors and read as documents."""
    path = scratch_path(spark, "texts")
    n = table(spark, sf_dir, "nation")
    sinks.write_texts(n.select(F.concat(F.lit("n"), "n_nationkey", F.lit(".txt")).alias("name"), F.concat(F.lit("line 1 of "), "n_name", F.lit("\r\nline 2\r")).alias("body")), path)
    return files.read_documents(spark, path)


@query(f"""SELECT 'n' || n_nationkey || '.json' AS file, 0 AS ord, n_name AS text, '{SYMPTOM}' AS type, 0 AS "start", length(n_name) AS "end" FROM nation WHERE n_nationkey % 5 <> 0""")
def submission_files(spark, sf_dir):
    """Submissions written one file each and read again; every fifth is empty."""
    path = scratch_path(spark, "submissions")
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("doc_id"), F.col("n_name").alias("text"), F.col("n_nationkey").alias("k"))
    none = F.array().cast("array<string>")
    found = n.where("k % 5 <> 0").select("doc_id", F.lit(0).cast("long").alias("ord"), "text", F.array(F.lit(0), F.length("text")).alias("position"), F.lit(SYMPTOM).alias("type"), none.alias("assertions"), none.alias("candidates"))
    sinks.write_submissions(sinks.submissions(n, found), path)
    rows = files.saved_entities(files.read_submissions(spark, path))
    return rows.select("file", F.col("ord").cast("long").alias("ord"), "text", "type", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))


@query("""SELECT * FROM (SELECT 'ROOT' AS code, 'ICD-10-CM' AS name, '' AS parent_code, 0 AS level, '' AS aliases, count(*) AS n FROM region)
UNION ALL SELECT 'CHAPTER_' || r_regionkey, r_name, 'ROOT', 1, '', 1 FROM region UNION ALL SELECT 'SECTION_' || n_nationkey, n_name, 'CHAPTER_' || n_regionkey, 2, '', 1 FROM nation
UNION ALL SELECT 'C' || c_custkey, c_name, 'SECTION_' || c_nationkey, 3, 'seg ' || c_mktsegment, 1 FROM customer UNION ALL SELECT 'C' || c_custkey || '.0', c_name || ' & more', 'C' || c_custkey, 4, '', 1 FROM customer""")
def xml_codes(spark, sf_dir):
    """Classification XML, a document for each region."""
    r, n, c = (table(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    inner = F.concat(F.lit("<diag><name>C"), "c_custkey", F.lit(".0</name><desc>"), "c_name", F.lit(" &amp; more</desc></diag>"))
    diag = F.concat(F.lit("<diag><name>C"), "c_custkey", F.lit("</name><desc> "), "c_name", F.lit("</desc><inclusionTerm><note>seg  <b>"), "c_mktsegment", F.lit("</b></note></inclusionTerm>"), inner, F.lit("</diag><diag><name>X</name></diag>"))
    by_nation = c.groupBy("c_nationkey").agg(F.array_join(F.collect_list(diag), "").alias("d"))
    sections = n.join(by_nation, F.col("c_nationkey") == F.col("n_nationkey"), "left").groupBy("n_regionkey").agg(F.array_join(F.collect_list(F.concat(F.lit('<section id="'), "n_nationkey", F.lit('"><desc>'), "n_name", F.lit("</desc>"), F.coalesce("d", F.lit("")), F.lit("</section>"))), "").alias("s"))
    docs = r.join(sections, F.col("n_regionkey") == F.col("r_regionkey"), "left").select(F.concat(F.lit("<t><chapter><name>"), "r_regionkey", F.lit("</name><desc>"), "r_name", F.lit("</desc>"), F.coalesce("s", F.lit("")), F.lit("</chapter></t>")).alias("text"))
    rows = files.xml_nodes(docs)
    return rows.groupBy("code", "name", "parent_code", "level", F.array_join("aliases", "|").alias("aliases")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH p AS (SELECT replace(p_brand, '#', '') AS p_brand, p_partkey, p_type, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS n FROM part), b AS (SELECT DISTINCT p_brand FROM p)
SELECT 'ROOT' AS code, 'ICD-10' AS name, '' AS parent_code, '0' AS level, 'root' AS model, '' AS aliases
UNION ALL SELECT 'I', 'Parts', 'ROOT', '1', 'chapter', '(I) Parts' UNION ALL SELECT 'S', 'Brands', 'I', '2', 'section', '(S) Brands'
UNION ALL SELECT p_brand, 'Brand ' || p_brand, 'S', '3', 'type', '(' || p_brand || ') Brand ' || p_brand FROM b
UNION ALL SELECT 'P' || p_partkey, CASE WHEN n % 3 = 0 THEN 'P' || p_partkey ELSE p_type || ' & co' END, p_brand, '4', 'disease', '' FROM p""")
def crawl_rows(spark, sf_dir):
    """Kept replies: a page of each brand shows its parts, every third without a name."""
    p = table(spark, sf_dir, "part").withColumn("p_brand", F.replace("p_brand", F.lit("#"), F.lit("")))
    key = F.concat(F.lit("p"), "p_partkey")
    mark = F.concat(F.lit('href="disease/'), key, F.lit('" name="P'), "p_partkey", F.lit('" field" hidden>name</div><div class="id" hidden>'), key, F.lit("</div>"))
    shown = F.concat(F.lit('<div class="content d-inline-block" >'), "p_type", F.lit(' &amp; co</div><span class="icons"> <div class="content-raw" hidden>'), key, F.lit(":"))
    n = F.row_number().over(W.partitionBy("p_brand").orderBy("p_partkey"))
    parts = p.select("p_brand", "p_partkey", F.when(n % 3 == 0, mark).otherwise(F.concat(mark, shown)).alias("h"))
    pages = parts.groupBy("p_brand").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "h"))), lambda x: x["h"]), "").alias("html"))

    def reply(code: Column, model: str, name: Column, html: Column) -> Column:
        data = F.struct(code.alias("id"), F.concat(F.lit("("), code, F.lit(") "), name).alias("name"), html.alias("html"))
        return F.to_json(F.struct(F.lit("success").alias("status"), F.struct(code.alias("id"), F.lit(model).alias("model"), F.lit(False).alias("is_leaf"), data.alias("data")).alias("data")))

    links = pages.agg(F.array_join(F.collect_list(F.concat(F.lit('<a href="type/'), "p_brand", F.lit('">'))), "").alias("html"))
    top = '{"status": "success", "data": [{"id": "I", "model": "chapter", "is_leaf": false, "data": {"id": "I", "name": "(I) Parts"}}]}'
    one = spark.range(1)
    replies = one.select(F.lit("root").alias("model"), F.lit("ROOT").alias("id"), F.lit(top).alias("payload"))
    replies = replies.union(one.select(F.lit("chapter"), F.lit("I"), reply(F.lit("I"), "chapter", F.lit("Parts"), F.lit('<a href="section/S">'))))
    replies = replies.union(links.select(F.lit("section"), F.lit("S"), reply(F.lit("S"), "section", F.lit("Brands"), F.col("html"))))
    replies = replies.union(pages.select(F.lit("type"), "p_brand", reply(F.col("p_brand"), "type", F.concat(F.lit("Brand "), "p_brand"), F.col("html"))))
    return files.crawl_tree(replies).select("code", "name", "parent_code", "level", "model", "aliases")


@query("""WITH a AS (SELECT p_brand AS code, p_name AS alias, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS n FROM part WHERE p_size % 2 = 0)
SELECT code, string_agg(alias, '|' ORDER BY n) AS aliases FROM a GROUP BY code""")
def manual_aliases(spark, sf_dir):
    """Rows of an alias table in their order; those without an alias are left out."""
    rows = table(spark, sf_dir, "part").orderBy("p_partkey").select(F.col("p_brand").alias("code"), F.when(F.col("p_size") % 2 == 0, F.concat(F.lit(" "), "p_name")).otherwise(" ").alias("alias"))
    got = files.alias_rows(rows)
    return got.groupBy("code").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "alias"))), lambda x: x["alias"]), "|").alias("aliases"))


@query("""SELECT p_partkey::VARCHAR AS code, unnest([p_name, p_type]) AS alias FROM part WHERE p_size % 2 = 0""")
def crawled_names(spark, sf_dir):
    """Names and aliases of crawled rows, without codes in brackets; chapters give none."""
    p = table(spark, sf_dir, "part")
    rows = p.select(F.col("p_partkey").cast("string").alias("code"), F.col("p_name").alias("name"), F.concat(F.lit("("), "p_partkey", F.lit(") "), "p_type", F.lit("|"), "p_partkey", F.lit("| "), "p_name").alias("aliases"), F.when(F.col("p_size") % 2 == 0, "disease").otherwise("chapter").alias("model"))
    return files.crawled_aliases(rows).select("code", "alias")


@query("""SELECT page_id, 'https://host/data/type?id=' || replace(replace(replace(url_encode(url), '%20', '+'), '~', '%7E'), '%2A', '*') || '&lang=dual' AS address, sha256(url) || '.json' AS file FROM pages""")
def reply_names(spark, sf_dir):
    """Addresses and file names of kept replies."""
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", files.payload_url("https://host", F.lit("type"), F.col("url")).alias("address"), files.cache_name(F.col("url")).alias("file"))


def full_prompt() -> tuple[str, str]:
    from termweave.operators.extract import PROMPT
    from termweave.schema import ASSERTIONS

    return tuple(x.format(types=", ".join(TYPES), assertions=", ".join(ASSERTIONS)) for x in PROMPT.split("{chunk}"))


@query("SELECT doc_id, sha256('{}' || coalesce(text, '') || '{}') AS prompt FROM documents".format(*[x.replace("'", "''") for x in full_prompt()]))
def prompts(spark, sf_dir):
    from termweave.operators.extract import prompt_for

    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(prompt_for(F.coalesce("text", F.lit(""))), 256).alias("prompt"))


@query(f"WITH {GEO_SQL} SELECT 'C' || c_custkey AS id, 'C' || c_custkey || ' ' || c_name || ' seg ' || c_mktsegment AS text, c_name || '|seg ' || c_mktsegment AS aliases FROM customer UNION ALL SELECT 'N' || n_nationkey, 'N' || n_nationkey || ' ' || n_name, n_name FROM nation")
def code_documents(spark, sf_dir):
    """Searchable texts of a tree; regions are groupings, so they and the root have none."""
    segments = table(spark, sf_dir, "customer").select(F.concat(F.lit("C"), "c_custkey").alias("code"), F.array(F.concat(F.lit("seg "), "c_mktsegment")).alias("a"))
    nodes = geography(spark, sf_dir).join(segments, "code", "left").withColumn("aliases", F.coalesce("a", "aliases")).drop("a")
    nodes = nodes.withColumn("code", F.when((F.col("level") == 1), F.concat(F.lit("SECTION_"), "code")).otherwise(F.col("code")))
    return tree.search_documents(nodes).select("id", "text", F.array_join("aliases", "|").alias("aliases"))


@query(f"""WITH {GEO_SQL}, o AS (SELECT o_orderkey AS k, o_custkey AS a, o_custkey % (SELECT count(*) FROM customer) + 1 AS b FROM orders), x AS (SELECT o.*, h1.n AS n1, h1.r AS r1, h2.n AS n2, h2.r AS r2 FROM o LEFT JOIN h h1 ON h1.k = a LEFT JOIN h h2 ON h2.k = b)
SELECT k AS ord, CASE WHEN k % 3 = 0 THEN 'C' || a || ',C' || b WHEN n1 = n2 AND a <> b THEN 'C' || a || ',C' || b ELSE 'C' || a END AS candidates FROM x""")
def prune_entities(spark, sf_dir):
    """Candidates of diagnoses pruned by distance, those of drugs left; two customers of one
    nation are near enough."""
    o, n = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer").count()
    codes = F.array(F.concat(F.lit("C"), "o_custkey"), F.concat(F.lit("C"), F.col("o_custkey") % n + 1))
    rows = o.select(F.lit("d").alias("doc_id"), F.col("o_orderkey").alias("ord"), F.lit("x").alias("text"), F.when(F.col("o_orderkey") % 3 == 0, DRUG).otherwise(DIAGNOSIS).alias("type"), codes.alias("candidates"))
    done = tree.prune_entities(rows, tree.tree_paths(geography(spark, sf_dir)))
    # the order of two equal scores is by code
    both = F.when(F.size("candidates") == 2, F.array_join(codes_in_order("candidates"), ",")).otherwise(F.array_join("candidates", ","))
    return done.join(o.select(F.col("o_orderkey").alias("ord"), F.concat(F.lit("C"), "o_custkey").alias("own")), "ord").select("ord", both.alias("candidates"))


def codes_in_order(name: str) -> Column:
    """The codes with the order's own customer first."""
    return F.concat(F.filter(name, lambda c: c == F.col("own")), F.filter(name, lambda c: c != F.col("own")))


@query("SELECT p_partkey, trim(p_name) AS first, 2::BIGINT AS n FROM part")
def list_fields(spark, sf_dir):
    """List fields: parted by '|', stripped, empty ones dropped."""
    p = table(spark, sf_dir, "part").select("p_partkey", text.split_list(F.concat(F.lit(" | "), "p_name", F.lit(" ||"), "p_type", F.lit(" | "))).alias("l"))
    return p.select("p_partkey", F.get("l", F.lit(0)).alias("first"), F.size("l").cast("long").alias("n"))


@query("""WITH p AS (SELECT l_orderkey, l_linenumber, l_partkey % 40 AS s, l_partkey % 40 + l_suppkey % 7 AS e FROM lineitem)
SELECT l_orderkey, l_linenumber, count(*) AS n, max(CASE WHEN s < e AND e <= 30 THEN s + 100 ELSE -1 END) AS "start", max(CASE WHEN s < e AND e <= 30 THEN e + 100 ELSE -1 END) AS "end" FROM p GROUP BY ALL""")
def span_globals(spark, sf_dir):
    """Places in a chunk [100, 130) as places in its source."""
    s = (F.col("l_partkey") % 40).cast("int")
    got = spans.to_global(F.lit(100), F.lit(130), s, (s + F.col("l_suppkey") % 7).cast("int"))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", got.alias("g"))
    at = [F.max(F.coalesce(f"g.{c}", F.lit(-1))).cast("long").alias(c) for c in ("start", "end")]
    return rows.groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n"), *at)


@query("SELECT p_partkey::VARCHAR AS id, length(p_name || ' ' || p_brand)::DOUBLE AS embedding FROM part")
def vector_tables(spark, sf_dir):
    """Embeddings (lengths of texts) written, checked against model and texts, read again."""
    path = scratch_path(spark, "vectors")
    docs = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("text"), F.array("p_brand").alias("aliases"))
    sinks.write_vectors(docs, lambda texts: [[float(len(t))] for t in texts], path, "lengths")
    assert files.kept_vectors(spark, path, "other", docs) is None
    return files.kept_vectors(spark, path, "lengths", docs).select("id", F.get("embedding", F.lit(0)).cast("double").alias("embedding"))


class FirstWord:
    """A model that finds the first word of a chunk, if it begins with a capital."""

    def load(self) -> None:
        pass

    def generate(self, prompts: list[str]) -> list[str]:
        out = []
        for p in prompts:
            word = p.split("CHUNK:\n")[1].split(" ")[0].split("\n")[0]
            out.append(json.dumps({"entities": [{"text": word, "position": [0, len(word)], "type": SYMPTOM, "assertions": [], "candidates": []}]} if word[:1].isupper() else {"entities": []}))
        return out


@query(CHUNK_SQL + r"""SELECT doc_id, chunk_index::BIGINT AS chunk_index, regexp_extract(substr(text, s + 1, e - s), '^[^ \n]+') AS word FROM c WHERE chunk_index >= 0 AND upper(substr(text, s + 1, 1)) = substr(text, s + 1, 1) AND lower(substr(text, s + 1, 1)) <> substr(text, s + 1, 1)""")
def model_entities(spark, sf_dir):
    """A model behind the extractor, on all chunks of all documents."""
    from termweave.operators.extract import ModelExtractor

    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    found = ModelExtractor(FirstWord()).extract(chunk.chunks(docs, chunk.NOTES))
    return found.select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), F.explode("entities").alias("e")).select("doc_id", "chunk_index", F.col("e.text").alias("word"))
