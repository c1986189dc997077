"""Reading texts, terminology tables and saved results."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from termweave.functions.text import natural_order, split_list, squeeze, strip
from termweave.sources.scratch import stage

BYTE_ORDER_MARK = "﻿"


def spread(table: DataFrame, part_rows: int | None = None) -> DataFrame:
    """A table that is read in fewer parts than there are cores, dealt out to all of them, for
    work that costs more than the copy. Larger tables stay as they are read, or are dealt out to
    parts of ``part_rows`` at most, where very many short rows fit into a part of the usual size."""
    parts = table.sparkSession.sparkContext.defaultParallelism
    if part_rows:
        parts = max(parts, -(-table.count() // part_rows))
    return table.repartition(parts) if table._jdf.toJavaRDD().getNumPartitions() < parts else table


def list_files(spark: SparkSession, folder: str, suffix: str) -> DataFrame:
    """(path, name, stem) of the files of a folder on any file system, empty ones too, which
    the content readers leave out. The listing alone is on the driver."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [s.getPath() for s in fs.listStatus(path) if s.isFile() and s.getPath().getName().endswith(suffix)]
    rows = [(p.toString(), p.getName(), p.getName()[: -len(suffix)]) for p in found]
    return spark.createDataFrame(rows, "path string, name string, stem string")


def first_files(files: DataFrame, limit: int | None) -> DataFrame:
    """The first ``limit`` files in natural order, or all."""
    return files if limit is None else files.orderBy(*natural_order("name")).limit(limit)


def unix_lines(text: Column) -> Column:
    """Text as Python reads it: CRLF and CR are line feeds."""
    return F.regexp_replace(text, "\r\n?", "\n")


def whole_texts(spark: SparkSession, folder: str, suffix: str) -> DataFrame:
    """(name, text) of each non-empty file."""
    read = spark.read.option("pathGlobFilter", f"*{suffix}").text(folder, wholetext=True)
    return read.select(F.col("_metadata.file_name").alias("name"), unix_lines(F.col("value")).alias("text"))


def read_documents(spark: SparkSession, folder: str, limit: int | None = None) -> DataFrame:
    """(doc_id, text) of the ``*.txt`` files; ``doc_id`` is the stem, empty files are empty
    texts."""
    names = first_files(list_files(spark, folder, ".txt"), limit).select("name", F.col("stem").alias("doc_id"))
    texts = whole_texts(spark, folder, ".txt").select(F.url_decode("name").alias("name"), "text")
    return names.join(texts, "name", "left").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with a header, all columns strings; a byte order mark is dropped."""
    read = spark.read.csv(path, header=True, escape='"', multiLine=True, encoding="UTF-8")
    return read.toDF(*[c.lstrip(BYTE_ORDER_MARK) for c in read.columns])


def optional(table: DataFrame, name: str) -> Column:
    return F.coalesce(F.col(name), F.lit("")) if name in table.columns else F.lit("")


def code_nodes(table: DataFrame) -> DataFrame:
    """(code, name, parent_code, level, aliases) from a table of strings."""
    parent = F.trim(optional(table, "parent_code"))
    return table.select(
        F.trim("code").alias("code"), F.trim(optional(table, "name")).alias("name"), F.when(parent != "", parent).alias("parent_code"),
        F.coalesce(F.trim(optional(table, "level")).try_cast("int"), F.lit(0)).alias("level"), split_list(optional(table, "aliases")).alias("aliases"),
    ).where("code <> ''")


def read_codes(spark: SparkSession, path: str) -> DataFrame:
    return code_nodes(read_table(spark, path))


def read_concepts(spark: SparkSession, path: str) -> DataFrame:
    """(rxcui, name, tty, synonyms) of a drug table."""
    t = read_table(spark, path)
    return t.select(F.trim("rxcui").alias("rxcui"), F.trim("name").alias("name"), F.trim(optional(t, "tty")).alias("tty"), split_list(optional(t, "synonyms")).alias("synonyms"))


# Places of the fields of a concept line, and values of its suppress field.
RRF_RXCUI, RRF_LANGUAGE, RRF_TTY, RRF_NAME, RRF_SUPPRESS = 0, 1, 12, 14, 16
SUPPRESSED = ["Y", "O"]


def rrf_terms(lines: DataFrame, keep_suppressed: bool = False) -> DataFrame:
    """(rxcui, tty, term) of English concept lines (column ``value``); lines of too few
    fields are skipped."""
    parts = F.split(F.regexp_replace("value", r"[\r\n]+$", ""), r"\|", -1)
    rows = lines.select(parts.alias("p")).where(F.size("p") > RRF_SUPPRESS)
    rows = rows.select(F.trim(F.col("p")[RRF_RXCUI]).alias("rxcui"), F.col("p")[RRF_LANGUAGE].alias("lang"), F.trim(F.col("p")[RRF_TTY]).alias("tty"), squeeze(F.col("p")[RRF_NAME]).alias("term"), F.col("p")[RRF_SUPPRESS].alias("suppress"))
    kept = rows.where((F.col("lang") == "ENG") & (F.col("rxcui") != "") & (F.col("term") != ""))
    return (kept if keep_suppressed else kept.where(~F.col("suppress").isin(SUPPRESSED))).select("rxcui", "tty", "term")


def read_rrf(spark: SparkSession, path: str, keep_suppressed: bool = False) -> DataFrame:
    return rrf_terms(spark.read.text(path), keep_suppressed)


def xml_nodes(documents: DataFrame) -> DataFrame:
    """(code, name, parent_code, level, aliases, ord) from classification XML (column
    ``text``): chapters, sections and nested diagnoses. One document is walked by one
    Python call, as nesting has no bound."""
    import xml.etree.ElementTree as ET

    def clean(text: str | None) -> str:
        return " ".join((text or "").split())

    def child(e: ET.Element, tag: str) -> str:
        found = e.find(tag)
        return "" if found is None else clean(found.text)

    def walk(text: str) -> Iterator[tuple]:
        yield "ROOT", "ICD-10-CM", "", 0, []
        for chapter in ET.fromstring(text).iterfind("chapter"):
            c_code = "CHAPTER_" + child(chapter, "name")
            yield c_code, child(chapter, "desc"), "ROOT", 1, []
            for section in chapter.iterfind("section"):
                if not (s_id := section.get("id", "").strip()):
                    continue
                yield "SECTION_" + s_id, child(section, "desc"), c_code, 2, []
                open_ = [(d, "SECTION_" + s_id, 3) for d in reversed(section.findall("diag"))]
                while open_:
                    diag, parent, level = open_.pop()
                    code, name = child(diag, "name"), child(diag, "desc")
                    if not (code and name):
                        continue
                    notes = (clean("".join(n.itertext())) for n in diag.iterfind("inclusionTerm/note"))
                    yield code, name, parent, level, list(dict.fromkeys(filter(None, notes)))
                    open_ += [(d, code, level + 1) for d in reversed(diag.findall("diag"))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for text in batch["text"]:
                yield pd.DataFrame([(*r, k) for k, r in enumerate(walk(text))], columns=["code", "name", "parent_code", "level", "aliases", "ord"])

    return documents.select("text").mapInPandas(run, "code string, name string, parent_code string, level int, aliases array<string>, ord long")


def read_xml_codes(spark: SparkSession, path: str) -> DataFrame:
    return xml_nodes(spark.read.text(path, wholetext=True).withColumnRenamed("value", "text"))


def alias_rows(table: DataFrame) -> DataFrame:
    """(code, alias, ord) from a manual alias table (code, alias); ``ord`` keeps the order."""
    rows = table.select(strip(F.coalesce("code", F.lit(""))).alias("code"), strip(F.coalesce("alias", F.lit(""))).alias("alias"), F.monotonically_increasing_id().alias("ord"))
    return rows.where("code <> '' AND alias <> ''")


def crawled_aliases(table: DataFrame) -> DataFrame:
    """(code, alias, ord) from crawled rows (code, name, aliases, model): names and aliases of
    types and diseases, without a code in brackets before them."""
    code, name = strip(F.coalesce("code", F.lit(""))), strip(F.coalesce("name", F.lit("")))
    rows = table.where(strip("model").isin("type", "disease")).select(code.alias("code"), name.alias("name"), optional(table, "aliases").alias("aliases"), F.monotonically_increasing_id().alias("ord")).where("code <> ''")
    listed = F.filter(split_list("aliases"), lambda a: (a != F.col("code")) & (a != F.col("name")))
    bare = F.transform(listed, lambda a: F.when(F.startswith(a, F.lit("(")) & F.contains(a, F.lit(")")), strip(F.regexp_replace(a, r"^\([^)]*\)", ""))).otherwise(a))
    own = F.when((F.col("name") != "") & (F.col("name") != F.col("code")), F.array("name")).otherwise(F.array().cast("array<string>"))
    every = F.concat(own, F.filter(bare, lambda a: a != ""))
    return rows.select("code", F.posexplode(every).alias("k", "alias"), "ord").select("code", "alias", (F.col("ord") * 1000 + F.col("k")).alias("ord"))


PAYLOAD_ITEM = "struct<id:string,model:string,is_leaf:boolean,data:struct<id:string,code:string,name:string>>"


def payload_url(base: str, model: Column, node: Column) -> Column:
    """The address of a node of a code browser."""
    return F.concat(F.lit(f"{base}/data/"), model, F.lit("?id="), F.url_encode(node), F.lit("&lang=dual"))


def cache_name(url: Column) -> Column:
    """The file name under which a reply is kept."""
    return F.concat(F.sha2(url, 256), F.lit(".json"))


def display_name(raw: Column, code: Column) -> Column:
    """A name without the bracketed code before it."""
    text = squeeze(F.coalesce(raw, F.lit("")))
    prefix = F.concat(F.lit("("), code, F.lit(") "))
    return F.when(F.startswith(text, prefix), F.substr(text, F.length(prefix) + 1)).otherwise(text)


def _unescape(text: Column) -> Column:
    for mark, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(mark), F.lit(sign))
    return text


def payload_items(payload: Column) -> Column:
    """Items of a successful reply: its data if a list, or the first list among children,
    childs, items and data; else none."""
    value = F.try_parse_json(payload)
    ok = F.try_variant_get(value, "$.status", "string") == "success"
    lists = [F.try_variant_get(value, p, "array<variant>") for p in ("$.data", "$.data.children", "$.data.childs", "$.data.items", "$.data.data")]
    items = F.coalesce(*lists, F.array().cast("array<variant>"))
    return F.transform(F.when(F.coalesce(ok, F.lit(False)), items).otherwise(F.array().cast("array<variant>")), lambda v: F.from_json(F.to_json(v), PAYLOAD_ITEM))


def item_row(item: Column, parent: Column, level: Column) -> Column:
    """A crawled row from an item."""
    data = item["data"]
    code = strip(F.coalesce(data["id"], item["id"], data["code"], F.lit("")))
    raw = strip(F.coalesce(data["name"], F.lit("")))
    name = display_name(raw, code)
    return F.struct(
        code.alias("code"), name.alias("name"), parent.alias("parent_code"), level.cast("string").alias("level"), F.when(raw != name, raw).otherwise("").alias("aliases"),
        strip(F.coalesce(item["id"], data["id"], F.lit(""))).alias("source_id"), F.coalesce(item["model"], F.lit("")).alias("model"), F.coalesce(item["is_leaf"], F.lit(False)).cast("string").alias("is_leaf"),
    )


# Models that may stand below a model.
CHILD_MODELS = {"root": ["chapter"], "chapter": ["section"], "section": ["type"], "type": ["type", "disease"]}


def _html(payload: Column) -> Column:
    value = F.try_parse_json(payload)
    ok = F.coalesce(F.try_variant_get(value, "$.status", "string") == "success", F.lit(False))
    return F.when(ok, F.coalesce(F.try_variant_get(value, "$.data.data.html", "string"), F.lit(""))).otherwise("")


def linked_children(payload: Column, model: Column) -> Column:
    """array<struct<model,id>> of the nodes that a reply's page links to, in order, once."""
    page = _html(payload)
    links = F.arrays_zip(F.regexp_extract_all(page, F.lit(r'href="(chapter|section|type)/([^"#?]+)"'), F.lit(1)).alias("model"), F.regexp_extract_all(page, F.lit(r'href="(chapter|section|type)/([^"#?]+)"'), F.lit(2)).alias("id"))
    clean = F.transform(links, lambda x: F.struct(x["model"].alias("model"), strip(_unescape(x["id"])).alias("id")))
    allowed = F.lit(None)
    for above, below in CHILD_MODELS.items():
        allowed = F.when(model == above, F.array(*map(F.lit, below))).otherwise(allowed)
    allowed = F.coalesce(allowed, F.array(*map(F.lit, ("chapter", "section", "type"))))
    return F.array_distinct(F.filter(clean, lambda x: F.array_contains(allowed, x["model"]) & (x["id"] != "")))


def embedded_diseases(payload: Column) -> Column:
    """array<struct<source_id,code,name>> of the diseases that a reply's page shows."""
    page = _html(payload)
    # The page's marks of a disease, and of its shown name in what follows.
    head = r'(?s)href="disease/([^"#?]+)"\s+name="([^"]+)".*?field" hidden>name</div>.*?<div class="id" hidden>\1</div>'
    name = r'(?s)^href="disease/([^"#?]+)".*?<div class="content d-inline-block" >([^<]+)</div><span class="icons">\s*<div class="content-raw" hidden>\1:'
    # the name may stand behind the next disease's beginning: it is looked at, not taken
    near = head + r"(?=(.{0,600}))"
    heads = F.arrays_zip(*[F.regexp_extract_all(page, F.lit(near), F.lit(k)).alias(n) for k, n in ((0, "all"), (1, "id"), (2, "code"), (3, "after"))])

    def one(m: Column) -> Column:
        source, code = (strip(_unescape(m[x])) for x in ("id", "code"))
        shown = F.regexp_extract(F.concat(m["all"], m["after"]), name, 2)
        return F.struct(source.alias("source_id"), code.alias("code"), F.when(shown != "", squeeze(_unescape(shown))).otherwise(code).alias("name"))

    return F.transform(heads, one)


#: Levels of a crawl; a deeper one is refused rather than cut.
MOST_LEVELS = 60


def crawl_tree(replies: DataFrame, root: str = "ROOT") -> DataFrame:
    """Rows (code, name, parent_code, level, aliases, source_id, model, is_leaf) of a crawl,
    from kept replies (model, id, payload) instead of a network. A page is followed once, at
    its least level (then parent), so pages may link in circles; levels are joined and written
    one after another. A code counts once, at its least level, then parent and name."""
    spark = replies.sparkSession
    known = replies.select("model", "id", "payload")
    tops = known.where(F.col("model") == "root").select(F.explode(payload_items(F.col("payload"))).alias("i")).select(item_row(F.col("i"), F.lit(root), F.lit(1)).alias("r")).select("r.*")
    nodes = known.where(F.col("model") != "root").select("model", "id", F.from_json(F.to_json(F.try_variant_get(F.try_parse_json("payload"), "$.data", "variant")), PAYLOAD_ITEM).alias("item"), linked_children(F.col("payload"), F.col("model")).alias("children"), embedded_diseases(F.col("payload")).alias("diseases"))
    nodes = stage(nodes, "crawl-nodes")
    links = stage(nodes.select(F.col("model").alias("from_model"), F.col("id").alias("parent"), F.explode("children").alias("c")).select("from_model", "parent", "c.model", "c.id").distinct(), "crawl-links")
    level = stage(tops.where("is_leaf <> 'true' AND code <> ''").select(F.lit("chapter").alias("model"), F.col("code").alias("id"), F.lit(root).alias("parent"), F.lit(1).alias("level")).distinct(), "crawl-level")
    levels = []
    while not level.isEmpty():
        if len(levels) == MOST_LEVELS:
            raise ValueError(f"pages of more than {MOST_LEVELS} levels")
        levels.append(level)
        seen = reduce(DataFrame.unionByName, levels).select("model", "id").distinct()
        above = level.select(F.col("model").alias("from_model"), F.col("id").alias("parent"), "level")
        found = links.join(above, ["from_model", "parent"]).groupBy("model", "id").agg(F.min("parent").alias("parent"), (F.min("level") + 1).alias("level"))
        level = stage(found.join(seen, ["model", "id"], "left_anti").select("model", "id", "parent", "level"), "crawl-level")
    reached = reduce(DataFrame.unionByName, levels or [level])
    below = reached.where("level > 1").join(nodes.select("model", "id", "item"), ["model", "id"]).where("item IS NOT NULL").select(item_row(F.col("item"), F.col("parent"), F.col("level")).alias("r")).select("r.*")
    shown = reached.join(nodes.select("model", "id", F.explode("diseases").alias("d")), ["model", "id"])
    shown = shown.select("d.code", "d.name", F.col("id").alias("parent_code"), (F.col("level") + 1).cast("string").alias("level"), F.lit("").alias("aliases"), "d.source_id", F.lit("disease").alias("model"), F.lit("true").alias("is_leaf"))
    every = tops.unionByName(below).unionByName(shown).where("code <> ''")
    w = W.partitionBy("code").orderBy(F.col("level").cast("int"), "parent_code", "name")
    first = spark.createDataFrame([(root, "ICD-10", "", "0", "", root, "root", "false")], every.schema)
    return first.unionByName(every.where(F.col("code") != root).withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n"))


def read_submissions(spark: SparkSession, folder: str, limit: int | None = None) -> DataFrame:
    """(file, body) of the ``*.json`` files of a run; the files come by the number that their
    whole stem is, others last."""
    files = list_files(spark, folder, ".json")
    if limit is not None:
        number = F.when(F.col("stem").rlike(r"^\s*[+-]?\d+\s*$"), F.col("stem").try_cast("decimal(38,0)"))
        files = files.orderBy(F.coalesce(number, F.lit(10**9)), "name").limit(limit)
    texts = whole_texts(spark, folder, ".json").select(F.url_decode("name").alias("name"), "text")
    return files.select("name").join(texts, "name", "left").select(F.col("name").alias("file"), F.coalesce("text", F.lit("")).alias("body"))


def saved_entities(submissions: DataFrame) -> DataFrame:
    """(file, ord, text, type, start, end, candidates) of saved results: a list, or a list
    under ``entities``. Broken files and items that are no objects are skipped; a place that
    is not two numbers is (-1, -1)."""
    value = F.try_parse_json("body")
    items = F.coalesce(F.try_variant_get(value, "$", "array<variant>"), F.try_variant_get(value, "$.entities", "array<variant>"))
    rows = submissions.select("file", F.posexplode(items).alias("ord", "v")).where(F.startswith(F.schema_of_variant("v"), F.lit("OBJECT")))

    def text(path: str) -> Column:
        return F.coalesce(F.try_variant_get("v", path, "string"), F.lit(""))

    place = F.try_variant_get("v", "$.position", "array<int>")
    good = F.coalesce((F.size(place) == 2) & F.get(place, F.lit(0)).isNotNull() & F.get(place, F.lit(1)).isNotNull(), F.lit(False))
    at = [F.when(good, F.get(place, F.lit(k))).otherwise(-1) for k in (0, 1)]
    return rows.select("file", "ord", text("$.text").alias("text"), text("$.type").alias("type"), at[0].alias("start"), at[1].alias("end"), F.coalesce(F.try_variant_get("v", "$.candidates", "array<string>"), F.array().cast("array<string>")).alias("candidates"))


def kept_vectors(spark: SparkSession, path: str, model_name: str, documents: DataFrame) -> DataFrame | None:
    """Embeddings (id, embedding) kept under ``path`` if they are of this model and of these
    documents (their ids and texts, by hash), else None: they must be made again."""
    try:
        kept = spark.read.parquet(path)
    except Exception:
        return None
    mark = documents.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("id", "text").cast("decimal(38,0)")).alias("h")).first()
    held = kept.where(F.col("model_name") == model_name).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("content").cast("decimal(38,0)")).alias("h")).first()
    return kept.select("id", "embedding") if (mark.n, mark.h) == (held.n, held.h) else None


def kept_expansions(spark: SparkSession, path: str) -> DataFrame | None:
    """(key, expansion) kept under ``path``; None if there are none or they can't be read."""
    try:
        return spark.read.parquet(path).select("key", "expansion")
    except Exception:
        return None
