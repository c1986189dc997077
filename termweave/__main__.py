"""Command line: ``python -m termweave link|validate|diff|export-graph|convert-xml|convert-rrf|merge-aliases|smoke``."""

from __future__ import annotations

import argparse
import importlib
import os
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from termweave.operators import diff, etl, validate
from termweave.operators.extract import ModelExtractor, RuleExtractor
from termweave.operators.link import Knowledge, LinkConfig
from termweave.plans.linking import link_files
from termweave.plans.smoke import smoke_report
from termweave.sources import files, sinks
from termweave.sources.scratch import stage


# Codes whose paths a graph's summary shows.
SAMPLE_CODES = ["M30.3", "A08.4", "D55.0", "N20.0"]


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="termweave")
    sub = p.add_subparsers(dest="what", required=True)
    link = sub.add_parser("link", help="texts to linked entities")
    link.add_argument("--input-dir", default="input")
    link.add_argument("--output-dir", default="output")
    link.add_argument("--extractor", choices=["rules", "model"], default="rules")
    link.add_argument("--model", default=None, help="module:factory of a model with load() and generate(prompts)")
    link.add_argument("--limit", type=int, default=None)
    link.add_argument("--debug-dir", default=None, help="folder for prompts and answers of chunks without an entity")
    link.add_argument("--safe", action="store_true", help="write an empty result for a text that fails, and go on")
    for q in (link, sub.add_parser("smoke"), sub.add_parser("export-graph")):
        q.add_argument("--icd-path", required=True)
        q.add_argument("--rxnorm-path")
    for q in (link, sub.choices["smoke"]):
        q.add_argument("--enable-dense", action="store_true", default=bool(os.environ.get("ENABLE_DENSE_SEARCH")))
        q.add_argument("--require-dense", action="store_true", default=os.environ.get("ENABLE_DENSE_SEARCH") in ("required", "strict"))
        q.add_argument("--dense-model", default=os.environ.get("DENSE_MODEL_NAME"), help="module:factory of an encoder, a function from texts to vectors")
        q.add_argument("--dense-cache", default=os.environ.get("DENSE_CACHE_PATH"))
        q.add_argument("--expansions", default=None, help="kept replies of the query expander")
    sub.choices["export-graph"].add_argument("--output-dir", required=True)
    sub.choices["export-graph"].add_argument("--sample-code", nargs="*", default=SAMPLE_CODES)
    check = sub.add_parser("validate")
    check.add_argument("--input-dir", default="input")
    check.add_argument("--output-dir", default="output")
    check.add_argument("--limit", type=int, default=None)
    check.add_argument("--max-issues", type=int, default=50)
    two = sub.add_parser("diff")
    two.add_argument("--before", required=True)
    two.add_argument("--after", required=True)
    two.add_argument("--report", default="data/processed/output_comparison.md")
    two.add_argument("--limit", type=int, default=None)
    two.add_argument("--max-items", type=int, default=200)
    for name in ("convert-xml", "convert-rrf", "merge-aliases"):
        q = sub.add_parser(name)
        q.add_argument("--input", required=True)
        q.add_argument("--output", required=True)
        q.add_argument("--aliases", default=None)
        q.add_argument("--kcb-path", default=None)
        q.add_argument("--include-suppressed", action="store_true")
    return p


def load(name: str):
    module, _, what = name.partition(":")
    return getattr(importlib.import_module(module), what)


def knowledge_of(spark: SparkSession, args: argparse.Namespace) -> Knowledge:
    nodes = files.read_codes(spark, args.icd_path)
    concepts = files.read_concepts(spark, args.rxnorm_path) if args.rxnorm_path else spark.createDataFrame([], "rxcui string, name string, tty string, synonyms array<string>")
    found = Knowledge(nodes, concepts, cache=files.kept_expansions(spark, args.expansions) if args.expansions else None)
    if not (args.enable_dense or args.require_dense):
        return found
    try:
        encode = load(args.dense_model)
        vectors = files.kept_vectors(spark, args.dense_cache, args.dense_model, found.documents)
        if vectors is None:
            sinks.write_vectors(found.documents, encode, args.dense_cache, args.dense_model)
            vectors = spark.read.parquet(args.dense_cache).select("id", "embedding")

        def embed(queries):
            def run(batches):
                for b in batches:
                    yield b.assign(embedding=[list(map(float, v)) for v in encode(b["text"].tolist())])

            return queries.mapInPandas(run, "query_id string, text string, embedding array<float>")

        found.vectors, found.encode = vectors, embed
    except Exception as bad:
        if args.require_dense:
            raise
        print(f"no dense search: {bad}", file=sys.stderr)
    return found


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("termweave").getOrCreate()
    if args.what == "link":
        documents = files.read_documents(spark, args.input_dir, args.limit)
        if documents.isEmpty():
            print(f"no .txt files in {args.input_dir}", file=sys.stderr)
            return 1
        extractor = ModelExtractor(load(args.model)(), debug_dir=args.debug_dir) if args.extractor == "model" else RuleExtractor()
        knowledge = knowledge_of(spark, args)
        if args.extractor == "model":
            knowledge.model, knowledge.keep = extractor.model, args.expansions
        n, failed = link_files(documents, knowledge, extractor, args.output_dir, args.safe)
        for name, reason in failed:
            print(f"{name}.txt failed: {reason}; wrote []", file=sys.stderr)
        print(f"{n} files")
    elif args.what == "smoke":
        for r in smoke_report(knowledge_of(spark, args), LinkConfig()).collect():
            print(r.kind, r.query, ", ".join(r.candidates), sep="\t")
    elif args.what == "export-graph":
        print(sinks.export_graph(files.read_codes(spark, args.icd_path), args.output_dir, args.sample_code))
    elif args.what == "validate":
        documents = files.read_documents(spark, args.input_dir, args.limit)
        bodies = files.read_submissions(spark, args.output_dir).select(F.regexp_replace("file", r"\.json$", "").alias("doc_id"), "body")
        issues = stage(validate.validate(documents, bodies), "issues")
        print(validate.summary(documents, issues).first().asDict())
        for r in issues.orderBy("file", "entity_index").limit(args.max_issues).collect():
            print(r.file, r.entity_index, r.code, r.message)
        return 0 if issues.isEmpty() else 1
    elif args.what == "diff":
        before, after = (files.saved_entities(files.read_submissions(spark, d, args.limit)) for d in (args.before, args.after))
        text = diff.report(before, after, (args.before, args.after), args.max_items)
        os.makedirs(os.path.dirname(os.path.abspath(args.report)), exist_ok=True)
        with open(args.report, "w", encoding="utf-8") as out:
            out.write(text)
    elif args.what == "convert-rrf":
        sinks.write_table(etl.group_terms(files.read_rrf(spark, args.input, args.include_suppressed)), args.output)
    else:
        nodes = files.read_xml_codes(spark, args.input) if args.what == "convert-xml" else files.read_codes(spark, args.input)
        fold = args.what != "convert-xml"
        if args.aliases:
            nodes = etl.merge_aliases(nodes, files.alias_rows(files.read_table(spark, args.aliases)), fold)
        if args.kcb_path:
            nodes = etl.merge_aliases(nodes, files.crawled_aliases(files.read_table(spark, args.kcb_path)), fold)
        sinks.write_table(nodes.drop("ord"), args.output)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
