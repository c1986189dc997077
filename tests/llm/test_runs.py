"""Repeated runs of lines go whole, whatever the lengths of their lines."""

import hashlib
import random

import corpus_pipeline
from termweave.llm import line_dedup
from termweave.llm.common import stage


def line(chars, seed):
    rng = random.Random(seed)
    out = ""
    while len(out) < chars:
        out += "".join(rng.choices("klmnoprst", k=rng.randint(2, 7))) + " "
    return out[:chars - 1] + "."


def by_force(rows):
    """The texts after removal: a line goes if a pair of lines with words that it is in, or
    the line alone if it is long, came before."""
    seen, out = set(), []
    for d, text in sorted((r for r in rows if r[1] is not None), key=lambda r: r[0]):
        lines = text.split("\n")
        at = [i for i, x in enumerate(lines) if x.strip()]
        gone = set()
        for k, i in enumerate(at):
            for n, unit in ((2, tuple(lines[i : at[k + 1] + 1]) if k + 1 < len(at) else None), (1, lines[i] if len(lines[i]) >= 120 else None)):
                if unit in seen and unit is not None:
                    gone |= {k, k + n - 1}
                seen.add(unit)
        ends = [*at[1:], len(lines)]
        begins = [0, *at[1:]]
        out.append((d, text if not gone else "\n".join("\n".join(lines[begins[k] : ends[k]]) for k in range(len(at)) if k not in gone)))
    return sorted(out + [r for r in rows if r[1] is None])


def rows():
    out = []
    for i, n in enumerate(range(3, 9)):  # runs of 3 to 8 lines of 60 to 115 characters inside other short lines
        run = [line(60 + (37 * j + 11 * i) % 56, 1000 + 10 * i + j) for j in range(n)]
        out += [(10 * i + c, "\n".join([line(70, 5000 + 10 * i + c), *run, line(80, 6000 + 10 * i + c)])) for c in range(3)]
    mixed = "\n".join(line(n, 9000 + n) for n in (150, 113, 160, 114, 40, 200, 106, 30, 90))
    out += [(100, mixed), (101, mixed), (102, "own words here\n" + mixed), (103, "\n" + mixed.replace("\n", "\n\n") + "\n")]
    return [*out, (104, "\n" + mixed.replace("\n", "\n\n") + "\n"), (110, "x\nx\nx\nx"), (111, None), (112, ""), (113, " \n\n"), (114, " \n\n"), (115, "one"), (116, "one"), (117, "y\nx\nx")]


def test_runs(spark):
    frame = spark.createDataFrame([(d, t, "x") for d, t in rows()], "doc_id long, text string, k string").repartition(3)
    done = line_dedup.dedup_runs(frame)
    assert done.columns == frame.columns
    got = {r.doc_id: r.text for r in done.collect()}
    assert sorted(got.items()) == by_force(rows())
    for i in range(6):  # of each run the first stays, later ones leave their frame alone
        assert got[10 * i] == dict(rows())[10 * i]
        assert got[10 * i + 1] == line(70, 5000 + 10 * i + 1) + "\n" + line(80, 6000 + 10 * i + 1)
    assert got[101] == "" and got[102] == "own words here" and got[104] == ""


def test_same_rows_are_treated_alike(spark):
    text = "alpha beta\ngamma delta"
    frame = spark.createDataFrame([(None, text), (None, text), (1, "a b\nc d"), (1, "a b\nc d")], "doc_id long, text string")
    assert sorted(r.text for r in line_dedup.dedup_runs(frame).collect()) == ["a b\nc d"] * 2 + [text] * 2


def test_exact_copies_leave_one_document(spark):
    mixed = "\n".join(line(n, 9000 + n) for n in (150, 113, 160, 114, 40, 200, 106, 30, 90))
    docs = [(i, mixed if i in (3, 5, 8) else "\n".join(line(100, 100 * i + j) for j in range(4)), "en", "s", 1) for i in range(10)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    left = corpus_pipeline.keep_one_of_near_copies(spark, corpus_pipeline.dedup_lines(spark, frame, ""), "")
    assert sorted(r.doc_id for r in left.collect() if r.text) == [0, 1, 2, 3, 4, 6, 7, 9]


SENTENCES = "The first sentence of a paragraph stands here. The second one follows it at once! And a third one makes the line long enough?"


def test_clashing_names_and_hot_chunks(spark):
    """A passage in all of 3,000 documents, joined by shuffle, and columns with the names of
    own ones."""
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    few, line_dedup.BROADCAST_ROWS = line_dedup.BROADCAST_ROWS, 0
    try:
        docs = [(i, f"own line {i}\n{SENTENCES}\nother line {i}", i, "k", "h", 1) for i in range(3000)]
        frame = spark.createDataFrame(docs, "doc_id long, text string, ks long, k string, h string, n_rows int").repartition(4)
        for made in (line_dedup.dedup_lines(frame), line_dedup.dedup_runs(frame)):
            assert made.columns[:6] == frame.columns
            rows = sorted(made.collect())
            assert rows[0].text == docs[0][1] and [r.ks for r in rows] == list(range(3000))
            assert all(r.text == f"own line {r.doc_id}\nother line {r.doc_id}" for r in rows[1:])
    finally:
        line_dedup.BROADCAST_ROWS = few
        for k, v in before.items():
            spark.conf.set(k, v)


def test_chunks_have_several_lines(spark):
    """A long line is a chunk of several lines, be it of one sentence or of many, unless it is
    one word; a single short line is no chunk."""
    one, word = "word " * 30 + "end.", "x" * 200
    texts = [SENTENCES, one, "Short one. Short two.", "a b\n\nc d", word]
    frame = spark.createDataFrame([(2 * i + k, t) for i, t in enumerate(texts) for k in range(2)], "doc_id long, text string")
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(frame).collect()}
    assert [got[2 * i] for i in range(5)] == texts
    assert got[1] == got[3] == "" and got[5] == "Short one. Short two." and got[9] == word


def test_passages_of_over_50_words_go(spark):
    """Passages of one line, with and without sentence ends, between short and long own lines."""
    passages = [" ".join(f"p{n}w{i}" for i in range(60)) for n in range(4)]
    passages += [p.replace("w30", "w30.") for p in passages]
    docs = [(i, "\n".join([line(n, 100 * i + n) for n in (30, 130)] + [passages[i % 8]] + [line(n, 100 * i + n) for n in (40, 150)])) for i in range(40)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    texts = {r.doc_id: r.text for r in line_dedup.dedup_lines(frame).collect()}
    for i, text in docs:
        assert texts[i] == (text if i < 8 else text.replace(passages[i % 8] + "\n", ""))


def test_hashes_that_clash(spark, monkeypatch):
    """Texts of one hash are told apart by their bytes."""
    docs = [(i, "\n".join(f"{chr(97 + (i * j) % 7)} line {i * j % 5}\nand more" for j in range(1, 9))) for i in range(40)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    want = [sorted(map(tuple, f(frame).collect())) for f in (line_dedup.dedup_lines, line_dedup.dedup_runs)]
    monkeypatch.setattr(line_dedup, "number_of", lambda c: line_dedup.F.length(c) % 3)
    assert want == [sorted(map(tuple, f(frame).collect())) for f in (line_dedup.dedup_lines, line_dedup.dedup_runs)]
    assert want[1] == [tuple(r) for r in by_force(docs)]


def chunks_by_force(text):
    """(first line with words, such lines, counts, text) of the chunks between content-defined bounds."""

    def md5(x):
        return hashlib.md5(x.encode()).hexdigest()

    lines, out, own, k = text.split("\n"), [], [], 0
    for i, x in enumerate(lines):
        own.append(x)
        rolled = i > 0 and md5(md5(lines[i - 1]) + md5(x))[0] in "048c"
        if i == len(lines) - 1 or len(x) >= 120 or len(lines[i + 1]) >= 120 or rolled:
            n = sum(1 for y in own if y.strip())
            out.append((k, n, sum(2 if len(y) >= 120 and " " in y.strip() else 1 for y in own if y.strip()) >= 2, "\n".join(own)))
            k, own = k + n, []
    return out


def test_chunks_go_first(spark, monkeypatch):
    """Runs are removed by content-defined chunks, compared by their bytes; the exact check of
    pairs and long lines settles those that no removed chunk holds."""
    compared = []
    monkeypatch.setattr(line_dedup, "stage", lambda df, name: compared.append((name, stage(df, name))) or compared[-1][1])
    texts = {d: t for d, t in rows() if t is not None}
    frame = spark.createDataFrame(rows(), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.text for r in line_dedup.dedup_runs(frame).collect()}
    assert sorted(got.items()) == by_force(rows())
    seen, gone = set(), set()
    for d in sorted(texts):
        for k, n, counts, chunk in chunks_by_force(texts[d]):
            if counts and chunk in seen:
                gone.add((d, k, n))
            elif counts:
                seen.add(chunk)
    assert any(n > 2 for _, _, n in gone)
    tables = {name: {(r["__d"], r.k, r.n) for r in df.collect()} for name, df in compared if name in ("line-chunks", "line-removed", "line-open")}
    assert tables["line-removed"] == gone
    held = {(e, i, m) for e, i, m in tables["line-chunks"] for d, k, n in gone if d == e and k <= i and i + m <= k + n}
    assert held and tables["line-open"] == tables["line-chunks"] - held
