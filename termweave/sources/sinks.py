"""Writing results."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termweave.schema import KEYS

DIAGNOSIS_KEYS = KEYS


def submission_entity(row: Column | None = None) -> Column:
    """An entity with its keys in the order of a submission."""
    none = F.array().cast("array<string>")
    values = {"candidates": F.coalesce("candidates", none), "assertions": F.coalesce("assertions", none)}
    return F.struct(*[values.get(k, F.col(k)).alias(k) for k in KEYS])


def submissions(documents: DataFrame, entities: DataFrame) -> DataFrame:
    """(doc_id, body): one JSON list per document, in order of ``ord``; a document without
    entities, or whose extraction failed, has an empty list."""
    listed = entities.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ord", submission_entity().alias("e")))).alias("l"))
    body = F.to_json(F.transform("l", lambda x: x["e"]))
    return documents.select("doc_id").join(listed, "doc_id", "left").select("doc_id", F.coalesce(body, F.lit("[]")).alias("body"))


def pretty(body: str) -> str:
    return json.dumps(json.loads(body), ensure_ascii=False, indent=2)


def write_submissions(bodies: DataFrame, folder: str) -> int:
    """Write ``{doc_id}.json`` files into ``folder``; the number of files."""
    return write_texts(bodies.select(F.concat("doc_id", F.lit(".json")).alias("name"), "body"), folder, lambda body: pretty(body) + "\n")


def write_texts(files: DataFrame, folder: str, form: Callable[[str], str] = str) -> int:
    """Write files (name, body) into ``folder``; their number. Executors write them, on a path
    that all of them see, through Arrow's file systems; a file is written beside its place
    and then moved there, so a task that is run again changes nothing."""
    from pyarrow import fs as arrow

    place = folder if "://" in folder else os.path.abspath(folder)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, at = arrow.FileSystem.from_uri(place)
        store.create_dir(at, recursive=True)
        for batch in batches:
            for name, body in zip(batch["name"], batch["body"]):
                temp = f"{at}/.{name}.{uuid.uuid4().hex}"
                with store.open_output_stream(temp) as out:
                    out.write(form(body).encode())
                store.move(temp, f"{at}/{name}")
            yield pd.DataFrame({"n": [len(batch)]})

    return files.select("name", "body").mapInPandas(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def write_table(table: DataFrame, path: str) -> None:
    """CSV with a header; lists are joined by '|'."""
    lists = [c for c, t in table.dtypes if t == "array<string>"]
    table.withColumns({c: F.array_join(c, "|") for c in lists}).write.csv(path, header=True, escape='"', mode="overwrite")


def graph_tables(nodes: DataFrame, paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (code, name, parent_code, level, depth, aliases) and edges (source, target)."""
    with_depth = nodes.join(paths.select("code", "depth"), "code", "left").select("code", "name", F.coalesce("parent_code", F.lit("")).alias("parent_code"), "level", "depth", "aliases")
    edges = nodes.where("parent_code IS NOT NULL").select(F.col("parent_code").alias("source"), F.col("code").alias("target"))
    return with_depth, edges


def graphml_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Lines (ord, line) of a GraphML document."""

    def quoted(x: Column) -> Column:
        out = F.coalesce(x.cast("string"), F.lit(""))
        for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
            out = F.replace(out, F.lit(a), F.lit(b))
        return out

    fields = ["name", "parent_code", "level", "aliases"]
    value = {"aliases": F.array_join("aliases", "|")}
    data = [F.concat(F.lit(f'<data key="{k}">'), quoted(value.get(k, F.col(k))), F.lit("</data>")) for k in fields]
    node = nodes.select(F.lit(1).alias("ord"), F.concat(F.lit('<node id="'), quoted(F.col("code")), F.lit('">'), *data, F.lit("</node>")).alias("line"))
    edge = edges.select(F.lit(2).alias("ord"), F.concat(F.lit('<edge source="'), quoted(F.col("source")), F.lit('" target="'), quoted(F.col("target")), F.lit('"/>')).alias("line"))
    keys = "".join(f'<key id="{k}" for="node" attr.name="{k}" attr.type="string"/>' for k in fields)
    ends = nodes.sparkSession.createDataFrame([(0, f'<graphml xmlns="http://graphml.graphdrawing.org/xmlns">{keys}<graph edgedefault="directed">'), (3, "</graph></graphml>")], "ord int, line string")
    return ends.unionByName(node).unionByName(edge)


def export_graph(nodes: DataFrame, folder: str, samples: list[str] = []) -> dict:
    """nodes, edges, graphml, summary and top levels of a tree under ``folder``; the summary."""
    from termweave.operators.tree import ROOT, tree_check, tree_paths

    paths = tree_paths(nodes)
    table, edges = graph_tables(nodes, paths)
    write_table(table, f"{folder}/nodes")
    write_table(edges, f"{folder}/edges")
    graphml_lines(nodes, edges).orderBy("ord").select("line").coalesce(1).write.mode("overwrite").text(f"{folder}/graphml")
    check = tree_check(nodes).first()
    shown = {r.code: r.path for r in paths.where(F.col("code").isin(samples)).collect()} if samples else {}
    summary = {"nodes": check.nodes, "edges": check.edges, "is_arborescence": check.is_tree, "root_code": ROOT, "max_depth": check.max_depth, "sample_paths": shown}
    nodes.sparkSession.createDataFrame([(json.dumps(summary, ensure_ascii=False, indent=2),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/summary")
    top_levels(nodes).coalesce(1).write.mode("overwrite").text(f"{folder}/top_levels")
    return summary


def top_levels(nodes: DataFrame, root: str = "ROOT", most: int = 20) -> DataFrame:
    """Markdown lines of the first two levels; at most ``most`` entries below each."""
    from pyspark.sql.window import Window as W

    one = nodes.where(F.col("parent_code") == root).select(F.col("code").alias("c1"), F.col("name").alias("n1"))
    two = nodes.select(F.col("parent_code").alias("c1"), "code", "name").withColumn("k", F.row_number().over(W.partitionBy("c1").orderBy("code"))).where(F.col("k") <= most)
    heads = one.select("c1", F.lit(0).alias("k"), F.concat(F.lit("- **"), "c1", F.lit("**: "), "n1").alias("value"))
    rest = two.join(one.select("c1"), "c1", "left_semi").select("c1", "k", F.concat(F.lit("  - `"), "code", F.lit("`: "), "name").alias("value"))
    return heads.unionByName(rest).orderBy("c1", "k").select("value")


def write_vectors(documents: DataFrame, encode, path: str, model_name: str) -> None:
    """Embeddings of documents (id, text, aliases) with what tells them apart from others.
    ``encode`` takes a list of texts and is called once per Arrow batch on a worker."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(embedding=[list(map(float, v)) for v in encode(batch["full"].tolist())]).drop(columns="full")

    full = F.concat_ws(" ", "text", "aliases").alias("full")
    rows = documents.select("id", F.xxhash64("id", "text").alias("content"), F.lit(model_name).alias("model_name"), full)
    rows.mapInPandas(run, "id string, content long, model_name string, embedding array<float>").write.mode("overwrite").parquet(path)
