"""Queries against their SQL on a small fixture of odd rows."""

import math

import duckdb
import pytest

from termweave.llm import queries

LINE = "This long line of a passage is found in several documents and it is longer than one hundred and twenty characters, surely so."
SHORT = ["alpha beta gamma", "delta epsilon", "zeta eta theta iota", "kappa lambda", "mu nu xi", "omicron pi rho", "sigma tau"]
TEXTS = [
    None, "", " \t\n\x0b ", "one", "one", "a\n\nb\n", "\n".join(SHORT), "x\n" + "\n".join(SHORT) + "\ny", LINE, "before\n" + LINE + "\nafter", LINE + "\n" + LINE,
    "mail a.b@c.de, x@y.z_w@q.rs. 1.2.3.4.5.6.7.8 300.1.1.1 0010.2.3.255", "card 4111 1111 1111 1111 and 4111111111111112 and 1-2-3", "+1 (743) 555-3824 +12 +1-2-3-4-5-6-7-8-9-0-1-2-3-4-5-6",
    "GB82WEST12345698765432 and DE89370400440532013000 and GB82WEST12345698765433", "my SSN: 123-45-6789 but 123-45-6789 alone is far from any word that would tell what it is 123-45-6789",
    "é😀 a@b.co 😀 +49 170 1234567", "word " * 30000, "9" * 5000 + "@" + "a" * 5000, "a.b@c.d.@e.f", "#!/bin/sh {a|b} <c> 1,000 5kg",
]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("odd")
    docs = [(i, t, ["en", "de", None][i % 3], [None, "src", "s", "é", "z"][i % 5], len(t or ""), "x") for i, t in enumerate(TEXTS)]
    docs += [(2 * len(TEXTS) + i, " ".join(f"w{i * j % 97}" for j in range(400 + i)), "en", f"s{i % 3}", 1, "x") for i in range(40)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, size string").repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(1, 1, 1), (3, 0, 1), (None, 1, 1), (4, None, None), (4, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    big = "<p>é" + "y" * 70000 + "WARC/1.1\r\n\r\n</p>"
    pages = [(1, "u", None), (2, "u", ""), (3, "u\r\nX: y", "short"), (4, "u", "short"), (5, None, big), (6, "u", big), (7, "u", "0\r\n\r\n" * 50), (8, "u", "0\r\n\r\n" * 50), (9, "u", "z" * 99), (10, "u", "z" * 99), (11, "u", "é" * 50), (12, "u", "é" * 50)]
    spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3).write.parquet(f"{at}/pages.parquet")
    return str(at)


def cell(v):
    return f"{v:.9g}" if isinstance(v, float) and not math.isnan(v) else str(v)


@pytest.mark.parametrize("name", [n for n in queries.ORACLES if n != "op9_chat_format"])
def test_against_sql(spark, folder, name):
    frame = queries.QUERIES[name](spark, folder)
    con = duckdb.connect()
    for t in ("documents", "labels", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    result = con.execute(queries.ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(frame.columns)
    want = sorted(tuple(map(cell, r)) for r in result.fetchall())
    got = sorted(tuple(cell(r[n]) for n in names) for r in frame.collect())
    assert got == want


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n not in ("pipeline",)])
def test_empty_tables(spark, folder, name, tmp_path):
    for t, schema in {
        "documents": "doc_id long, text string, lang string, source string, n_chars long", "labels": "doc_id long, quality int, toxic int",
        "pages": "page_id long, url string, html string", "benchmark": "item_id long, text string", "conversations": "conv_id long, turn long, role string, text string",
    }.items():
        spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{tmp_path}/{t}.parquet")
    assert queries.QUERIES[name](spark, str(tmp_path)).count() == (1 if name == "op9_chat_format" else 0)
