"""The engine on small fixtures."""

import json

import pytest
from pyspark.sql import functions as F

from termweave.functions import scores, spans, text
from termweave.operators import chunk, diff, etl, extract, link, metrics, model_json, postprocess, search, tree, validate
from termweave.operators.expand import RULES, expand, weighted_queries
from termweave.plans.linking import link_batch
from termweave.schema import DIAGNOSIS, DRUG, SYMPTOM
from termweave.sources import files, sinks

NODES = [
    ("ROOT", "ICD-10", None, 0, []), ("A00-B99", "Infectious diseases", "ROOT", 1, ["bệnh nhiễm trùng"]), ("A00", "Cholera", "A00-B99", 2, ["tả", "bệnh tả"]),
    ("E00-E90", "Endocrine diseases", "ROOT", 1, []), ("E10-E14", "Diabetes mellitus", "E00-E90", 2, []), ("E11", "Type 2 diabetes mellitus", "E10-E14", 3, []),
    ("E11.9", "Type 2 diabetes mellitus without complications", "E11", 4, []), ("E11.65", "Type 2 diabetes mellitus with hyperglycemia", "E11", 4, []),
    ("K00-K93", "Digestive diseases", "ROOT", 1, []), ("K20-K31", "Diseases of esophagus", "K00-K93", 2, []), ("K21", "Reflux disease", "K20-K31", 3, []), ("K21.9", "Reflux disease without esophagitis", "K21", 4, []),
]
CONCEPTS = [("1191", "Aspirin", "IN", ["ASA", "acetylsalicylic acid"]), ("243670", "aspirin 81 MG Oral Tablet", "SCD", ["aspirin 81 mg"]), ("313782", "acetaminophen 325 MG", "SCD", ["paracetamol"])]


@pytest.fixture(scope="module")
def nodes(spark):
    return spark.createDataFrame(NODES, "code string, name string, parent_code string, level int, aliases array<string>").cache()


@pytest.fixture(scope="module")
def knowledge(spark, nodes):
    return link.Knowledge(nodes, spark.createDataFrame(CONCEPTS, "rxcui string, name string, tty string, synonyms array<string>").cache())


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def queries(spark, *texts):
    return spark.createDataFrame([(t, t) for t in texts], "query_id string, text string")


def test_text(spark):
    assert one(spark, text.normalize_text(F.lit("  Straße ΣΑΣ \x1c x "))) == "strasse σασ x"
    assert one(spark, text.strip_diacritics(F.lit("Đái tháo ĐƯỜNG ế"))) == "dai thao duong e"
    assert one(spark, text.search_tokens(F.lit("A-b/C  d"))) == ["a", "b", "c", "d"]
    assert one(spark, text.split_list(F.lit(" a | |b"))) == ["a", "b"]
    assert sorted(one(spark, text.meaningful_tokens(F.lit("Viêm gan B cấp x1")))) == ["gan", "x1"]


def test_spans(spark):
    found = one(spark, spans.exact_matches(F.lit("ho rồi ho"), F.lit("ho")))
    assert [(m.start, m.end) for m in found] == [(0, 2), (7, 9)]
    assert [m.start for m in one(spark, spans.exact_matches(F.lit("aaa"), F.lit("aa")))] == [0, 1]
    assert one(spark, spans.exact_matches(F.lit("a"), F.lit(""))) == []
    assert [m.start for m in one(spark, spans.literal_matches(F.lit("😀ho ho"), "ho"))] == [1, 4]
    for t, m in (("aaaa", "aa"), ("x.y.\\E.y", ".y"), ("a\\Eb\\E", "\\E"), ("😀😀ho😀ho", "😀"), ("ab" * 3000, "ba"), ("abc", "abc"), ("abc", "d")):
        assert [x.start for x in one(spark, spans.exact_matches(F.lit(t), F.lit(m)))] == [k for k in range(len(t)) if t.startswith(m, k)]
    assert one(spark, spans.exact_matches(F.lit(None).cast("string"), F.lit("a"))) == []
    assert one(spark, spans.choose_match(spans.exact_matches(F.lit("ho        ho"), F.lit("ho")), F.lit(5))) is None
    assert one(spark, spans.correct_span(F.lit("Bệnh nhân ho."), F.lit("ho"), F.lit(0), F.lit(2))).start == 10
    assert one(spark, spans.to_global(F.lit(100), F.lit(113), F.lit(10), F.lit(12))).end == 112
    with pytest.raises(Exception, match="does not hold"):
        one(spark, spans.require_span(F.lit("abc"), F.lit("x"), F.lit(0), F.lit(1)))


def test_scores(spark):
    words = lambda s: F.array(*map(F.lit, s.split())).cast("array<string>")
    assert one(spark, scores.word_error_rate(words("đau ngực"), words("đau bụng"))) == 0.5
    assert one(spark, scores.word_error_rate(words("a b c"), words("x a c"))) == pytest.approx(2 / 3)
    assert one(spark, scores.word_error_rate(words(""), words("a"))) == 1 and one(spark, scores.word_error_rate(words("a"), words(""))) == 1
    assert one(spark, scores.jaccard(words("A B"), words("B C"))) == pytest.approx(1 / 3) and one(spark, scores.jaccard(words(""), words(""))) == 1
    assert metrics.overall(1, 0.5, 0.25, spark) == pytest.approx(0.55)
    pairs = spark.createDataFrame([(["A"], ["A"]), ([], ["A"])], "truth array<string>, prediction array<string>")
    assert metrics.average_jaccard(pairs).first().score == 0.5 and metrics.average_jaccard(pairs.limit(0)).first().score == 1
    assert metrics.weighted_jaccard(pairs).first().score == pytest.approx(2 / 3)
    texts = spark.createDataFrame([("a b", "a b"), ("a", "x y z")], "reference string, hypothesis string")
    assert metrics.text_score(texts).first().score == pytest.approx((1 + 1 - 3) / 2)


BLOCK = "Bệnh nhân ho và sốt. "


@pytest.mark.parametrize(
    ("source", "config", "check"),
    [
        ("Bệnh nhân ho.", (200, 150, 250), lambda c: len(c) == 1),
        (BLOCK * 40, (120, 80, 140), lambda c: len(c) > 1),
        ("a\tb\n\nc  d " * 9, (30, 15, 35), lambda c: len(c) > 1),
        (BLOCK * 20, (50, 30, 80, 0, 5000), lambda c: len(c) == 1),
        ("A" * 80 + "\n" + "B" * 80 + "\n\n" + "C" * 80, (140, 60, 170), lambda c: c[0][1] == 163),
        ("A" * 799 + "\n\n" + "B" * 900, (600, 300, 800), lambda c: c[0] == (0, 801)),
        ("x" * 500, (200, 150, 250), lambda c: c[0] == (0, 200)),
        (None, (200, 150, 250), lambda c: c == []),
    ],
)
def test_chunks(source, config, check):
    cfg = chunk.ChunkConfig(*config)
    found = chunk.split_text(source, cfg)
    assert check(found)
    if found:
        assert found[0][0] == 0 and found[-1][1] == len(source) and all(a[1] == b[0] for a, b in zip(found, found[1:]))
        assert all(b - a <= cfg.most + 1 for a, b in found) or cfg.no_split


def test_chunk_overlap(spark):
    cfg = chunk.ChunkConfig(80, 50, 90, 10)
    found = chunk.split_text(BLOCK * 12, cfg)
    assert all(a[0] < b[0] <= a[1] for a, b in zip(found, found[1:]))
    rows = chunk.chunks(spark.createDataFrame([("d", BLOCK * 12), ("e", ""), ("f", None)], "doc_id string, text string"), cfg).collect()
    assert [(r.start, r.end) for r in rows] == found and all((BLOCK * 12)[r.start : r.end] == r.text for r in rows)
    for bad in ((0, 1, 2), (5, 6, 7), (5, 4, 6, 4), (5, 4, 6, 0, -1)):
        with pytest.raises(ValueError):
            chunk.ChunkConfig(*bad)


def entities(spark, *rows):
    return spark.createDataFrame([("d", i, *r) for i, r in enumerate(rows)], "doc_id string, ord long, text string, position array<int>, type string, assertions array<string>, candidates array<string>")


def test_dedupe(spark):
    frame = entities(spark, ("ho", [0, 2], SYMPTOM, [], []), ("x", [5, 6], SYMPTOM, [], []), ("ho", [0, 2], SYMPTOM, ["isNegated"], []), ("ho", [0, 2], SYMPTOM, ["isFamily"], []))
    assert [(r.ord, r.assertions) for r in postprocess.dedupe_richest(frame).orderBy("ord").collect()] == [(0, ["isNegated"]), (1, [])]


def test_noise_and_nesting(spark):
    frame = entities(
        spark, ("Bé  Trai", [0, 7], SYMPTOM, [], []), ("khó thở", [8, 15], SYMPTOM, [], []), ("5,5 mg", [16, 20], DRUG, [], []), ("Phẫu thuật tim", [21, 30], DIAGNOSIS, [], []), ("Aspirin", [31, 38], DRUG, [], []), ("men G6PD", [40, 48], SYMPTOM, [], []),
        ("thiếu men G6PD", [34, 48], DIAGNOSIS, [], []), ("men G6PD x", [38, 48], DIAGNOSIS, [], []), ("rich", [39, 43], DIAGNOSIS, ["isNegated"], []), ("same", [34, 48], DIAGNOSIS, [], []), ("tail", [44, 48], DIAGNOSIS, [], []), ("head", [34, 36], DIAGNOSIS, [], []),
    )
    kept = {r.text for r in postprocess.clean(frame).collect()}
    assert kept == {"khó thở", "Aspirin", "thiếu men G6PD", "same", "rich"}


def test_model_answers(spark):
    good = {"text": "ho", "position": [0, 2], "type": SYMPTOM, "assertions": [], "candidates": []}
    cases = {
        "": ("empty", 0),
        "no json": ("salvaged", 0),
        json.dumps({"entities": [good]}): ("strict", 1),
        "text {x " + json.dumps({"entities": []}) + " tail": ("salvaged", 0),
        json.dumps({"entities": [good, {**good, "type": "NOPE"}]}): ("tolerant", 1),
        json.dumps({"entities": [{**good, "type": "TÊN_XÉT_NGHIỆM", "assertions": ["isNegated"]}]}): ("tolerant", 1),
        json.dumps({"entities": [{**good, "position": [2, 2]}, {**good, "position": ["a", 3]}, {**good, "text": ""}, 7]}): ("tolerant", 0),
        '{"entities": [' + json.dumps(good) + ", " + json.dumps(good) + ', {"text": "cut': ("salvaged", 2),
        '{"entities": 5}': ("failed", 0),
        json.dumps({"entities": [{**good, "type": DRUG, "candidates": [1191, "x"]}]}): ("strict", 1),
        "{}": ("strict", 0),
    }
    rows = model_json.parse_answers(spark.createDataFrame([(k,) for k in cases], "generated string")).collect()
    assert {r.generated: (r.outcome, len(r.entities)) for r in rows} == cases
    assert next(r.entities[0].candidates for r in rows if "1191" in r.generated) == ["1191", "x"]


def stub():
    class Stub:
        """A model that finds 'ho' and fails on one text."""

        def load(self):
            pass

        def generate(self, prompts):
            if any("bad" in p for p in prompts):
                raise RuntimeError
            out = []
            for p in prompts:
                chunk_text = p.split("CHUNK:\n")[1].split("\n\nJSON:")[0]
                out.append(json.dumps({"entities": [{"text": "ho", "position": [0, 2], "type": SYMPTOM, "assertions": [], "candidates": []}]}) if "ho" in chunk_text else "")
            return out

    return Stub()


def test_model_extractor(spark):
    docs = spark.createDataFrame([("a", "Bệnh nhân ho."), ("b", "bad"), ("c", "")], "doc_id string, text string")
    rows = extract.extract_entities(docs, extract.ModelExtractor(stub())).collect()
    assert [(r.doc_id, r.position) for r in rows] == [("a", [10, 12])]
    with pytest.raises(Exception, match="extraction failed"):
        extract.extract_entities(docs, extract.ModelExtractor(stub()), skip_failed=False).collect()


def test_tree(spark, nodes):
    paths = {r.code: r.path for r in tree.tree_paths(nodes).collect()}
    assert paths["E11.9"] == ["ROOT", "E00-E90", "E10-E14", "E11", "E11.9"]
    pair = lambda f, a, b: one(spark, f(F.array(*map(F.lit, paths[a])), F.array(*map(F.lit, paths[b]))))
    assert pair(scores.common_ancestor, "E11.9", "E11.65") == "E11" and pair(scores.tree_distance, "E11.9", "E11.65") == 2 and pair(scores.wu_palmer, "E11.9", "E11.65") == 0.75
    assert pair(scores.common_ancestor, "E11.9", "K21.9") == "ROOT" and pair(scores.tree_distance, "E11.9", "K21.9") == 8 and pair(scores.wu_palmer, "E11.9", "K21.9") == 0
    assert pair(scores.wu_palmer, "ROOT", "ROOT") == 1
    assert tree.tree_check(nodes).first().is_tree
    assert not tree.tree_check(nodes.union(spark.createDataFrame([("X", "x", "GONE", 1, [])], nodes.schema))).first().is_tree
    assert not tree.tree_check(nodes.union(spark.createDataFrame([("A00", "x", "K21", 1, [])], nodes.schema))).first().is_tree


def test_prune(spark, nodes):
    paths = tree.tree_paths(nodes)

    def run(rows, **config):
        frame = spark.createDataFrame([("q", i, *r) for i, r in enumerate(rows)], "query_id string, ord int, code string, score double")
        return [r.code for r in tree.prune(frame, paths, tree.PruneConfig(**config)).orderBy("rank").collect()]

    assert run([("E11.9", 1.0), ("E11.65", 1.0), ("K21.9", 1.0)]) == ["E11.9", "E11.65"]
    assert run([("K21.9", 0.5), ("E11.9", 0.9), (" E11.9 ", 0.1), ("", 1.0)]) == ["E11.9"]
    assert run([("E11.9", 1.0), ("BAD", 1.0)]) == ["E11.9"] and run([("E11.9", 1.0), ("BAD", 1.0)], keep_unknown=True) == ["E11.9", "BAD"]
    assert run([("BAD", 1.0)]) == [] and run([("WORSE", 0.1), ("BAD", 0.2)], keep_unknown=True) == ["WORSE", "BAD"]
    frame = entities(spark, ("a", [0, 1], DIAGNOSIS, [], ["E11.9", "K21.9"]), ("b", [0, 1], DRUG, [], ["1191"]), ("c", [0, 1], DIAGNOSIS, [], []))
    assert [r.candidates for r in tree.prune_entities(frame, paths).orderBy("ord").collect()] == [["E11.9"], ["1191"], []]
    with pytest.raises(ValueError):
        tree.PruneConfig(alpha=2)


def test_drug_search(spark, knowledge):
    got = {}
    for r in search.term_search(queries(spark, "ASA", "aspirin 81 mg po daily", "paracetamol", "zzz", " "), knowledge.concepts).orderBy("query_id", F.desc("score"), "id").collect():
        got.setdefault(r.query_id, []).append((r.id, r.score))
    assert got["ASA"][0] == ("1191", 1.0) and got["aspirin 81 mg po daily"][0][0] == "1191" or got["aspirin 81 mg po daily"][0][0] == "243670"
    assert got["paracetamol"][0][0] == "313782" and "zzz" not in got
    assert [r.rxcui for r in search.exact_terms(queries(spark, " asa "), knowledge.concepts).collect()] == ["1191"]


def test_lexical_against_force(spark):
    import random

    rng = random.Random(1)
    make = lambda: " ".join("".join(rng.choices("ab-/c", k=rng.randint(1, 4))) for _ in range(rng.randint(1, 4)))
    asked, terms = [make() for _ in range(60)], [(str(i % 40), make()) for i in range(120)]

    def tok(s):
        return set(s.replace("/", " ").replace("-", " ").split())

    def score(q, t):
        q, t = " ".join(q.split()), " ".join(t.split())
        best = len(tok(q) & tok(t)) / (len(tok(q) | tok(t)) or 1)
        return max(best, 1.0 if q == t else 0.85 if q in t or t in q else 0)

    want = {}
    for q in asked:
        for i, t in terms:
            if tok(q) and (s := score(q, t)) > 0:
                want[q, i] = max(want.get((q, i), 0), s)
    frame = spark.createDataFrame(terms, "id string, term string")
    got = {(r.query_id, r.id): r.score for r in search.lexical_scores(queries(spark, *set(asked)), frame).collect()}
    assert got == pytest.approx(want)


def test_bm25_by_hand(spark):
    import math

    docs = spark.createDataFrame([("1", "a b", []), ("2", "a c c", []), ("3", "d", []), ("4", "e f g h", [])], "id string, text string, aliases array<string>")
    got = {(r.query_id, r.id): r.score for r in search.Bm25Index.build(docs).scores(queries(spark, "c a a")).collect()}
    mean = (2 + 3 + 1 + 4) / 4
    idf = {t: math.log(4 - n + 0.5) - math.log(n + 0.5) for t, n in {"a": 2, "b": 1, "c": 1, "d": 1, "e": 1, "f": 1, "g": 1, "h": 1}.items()}
    part = lambda t, n, size: idf[t] * n * 2.5 / (n + 1.5 * (0.25 + 0.75 * size / mean))
    assert got["c a a", "2"] == pytest.approx(part("c", 2, 3) + 2 * part("a", 1, 3)) and got["c a a", "1"] == pytest.approx(2 * part("a", 1, 2))


def test_vectors(spark):
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 1.0]), ("c", [0.0, 0.0]), ("d", [-1.0, 0.0]), ("e", [2.0, 0.0])], "id string, embedding array<double>")
    asked = spark.createDataFrame([("q", [1.0, 0.0]), ("z", [0.0, 0.0])], "query_id string, embedding array<double>")
    rows = search.vector_search(asked, vectors.repartition(3), 3).orderBy(F.desc("score"), "id").collect()
    assert [(r.id, round(r.score, 6)) for r in rows] == [("a", 1.0), ("e", 1.0), ("b", 0.707107)]


def test_vector_blocks(spark, monkeypatch):
    """Blocks of queries and vectors find what one block finds."""
    import random

    rng = random.Random(4)
    vectors = spark.createDataFrame([(str(i), [rng.gauss(0, 1) for _ in range(4)]) for i in range(90)], "id string, embedding array<double>")
    asked = vectors.where("id % 5 = 0").withColumnRenamed("id", "query_id")
    rows = [sorted(map(tuple, search.vector_search(asked, vectors, 3).collect()))]
    monkeypatch.setattr(search, "QUERY_BLOCK", 5)
    monkeypatch.setattr(search, "VECTOR_BLOCK", 40)
    rows.append(sorted(map(tuple, search.vector_search(asked, vectors, 3).collect())))
    assert [(r[0], r[1], round(r[2], 9)) for r in rows[0]] == [(r[0], r[1], round(r[2], 9)) for r in rows[1]] and len(rows[0]) > 50


def test_results(spark):
    schema = "query_id string, id string, score double, text string, source string"
    rows = spark.createDataFrame([("q", "A", 0.95, "t", "s"), ("q", "B", 0.9, "t", "s"), ("q", "C", 0.87, "t", "s"), ("p", "A", 0.95, "t", "s"), ("p", "B", 0.7, "t", "s"), ("o", "A", 0.05, "t", "s"), ("n", "A", 1.0, "t", "s"), ("n", "B", 0.85, "t", "s")], schema)
    kept = {}
    for r in search.dynamic_threshold(rows).orderBy("query_id", "rank").collect():
        kept.setdefault(r.query_id, []).append(r.id)
    assert kept == {"q": ["A", "B", "C"], "p": ["A"], "n": ["A"]}
    other = spark.createDataFrame([("q", "A", 0.5, "later", "dense"), ("q", "Z", 0.4, "", "dense")], schema)
    both = {r.id: r for r in search.ensemble(rows.where("query_id = 'q'"), other).collect()}
    assert (both["A"].score, both["A"].text, both["A"].source) == (0.95, "later", "ensemble") and both["B"].source == "s" and both["Z"].source == "dense"
    must = spark.createDataFrame([("q", ["Later"]), ("p", [])], "query_id string, must_have array<string>")
    assert search.must_have(rows.where("query_id in ('q', 'p')"), must).count() == 2


def test_expansion(spark, tmp_path):
    assert len(RULES) == 68
    mentions = queries(spark, "Viêm mô tế bào", "cholesterol cao", "Bệnh lạ", "TĂNG HUYẾT ÁP", "pes planus")
    got = {r.query_id: r.expansion for r in expand(mentions).collect()}
    assert got["Viêm mô tế bào"].english == "cellulitis" and got["TĂNG HUYẾT ÁP"].english == "hypertension" and got["pes planus"].site == "foot"
    assert got["cholesterol cao"].english == "rabies" and got["Bệnh lạ"].confidence == "low"
    strict = {r.query_id: r.expansion.english for r in expand(mentions, strict=True).collect()}
    assert strict["cholesterol cao"] == "" and strict["TĂNG HUYẾT ÁP"] == "hypertension"
    asked = [(r.q_text, r.q_weight) for r in weighted_queries(expand(queries(spark, "viêm mô tế bào"))).orderBy("q_ord").collect()]
    assert asked == [("cellulitis", 1.0), ("skin infection", 0.9), ("cellulitis skin", 0.75), ("viêm mô tế bào", 0.2)]

    class Model:
        def load(self):
            pass

        def generate(self, prompts):
            return ['{"normalized_english": "odd disease", "synonyms": ["od"], "confidence": "medium"}' if "lạ" in p else "no" for p in prompts]

    keep = str(tmp_path / "replies")
    layered = {r.query_id: r.expansion for r in expand(queries(spark, "Bệnh lạ", "khác"), model=Model(), keep=keep).collect()}
    assert layered["Bệnh lạ"].english == "odd disease" and layered["khác"].confidence == "low"
    # a later run takes the reply from the table
    again = {r.query_id: r.expansion for r in expand(queries(spark, "bệnh  LẠ"), files.kept_expansions(spark, keep)).collect()}
    assert again["bệnh  LẠ"].english == "odd disease" and files.kept_expansions(spark, keep).count() == 1


def test_linking(spark, knowledge):
    sentence = "Bệnh nhân có tiền sử đái tháo đường tuýp 2, hiện không ho và dùng Aspirin."
    docs = spark.createDataFrame([("1", sentence), ("2", "")], "doc_id string, text string")
    bodies = {r.doc_id: json.loads(r.body) for r in link_batch(docs, knowledge).collect()}
    assert bodies["2"] == []
    by_text = {e["text"]: e for e in bodies["1"]}
    assert list(by_text["Aspirin"]) == ["text", "type", "candidates", "assertions", "position"]
    assert by_text["Aspirin"]["candidates"] == ["1191"] and "đái tháo đường tuýp 2" in by_text and "đái tháo đường" not in by_text
    assert by_text["ho"]["assertions"] == ["isNegated"]
    assert all(sentence[slice(*e["position"])] == e["text"] for e in bodies["1"])
    frame = entities(spark, ("Type 2 diabetes mellitus", [0, 1], DIAGNOSIS, [], []), ("men G6PD", [0, 1], DRUG, [], []), ("bệnh tả", [0, 1], DIAGNOSIS, [], []), ("ho", [0, 1], SYMPTOM, [], ["x"]))
    got = {r.text: r.candidates for r in link.link_entities(frame, knowledge).collect()}
    assert got["Type 2 diabetes mellitus"][0] == "E10-E14" and got["bệnh tả"] == ["A00"] and got["ho"] == [] and "men G6PD" not in got


def issues_of(spark, source, *bodies):
    docs = spark.createDataFrame([(str(i), source) for i in range(len(bodies))], "doc_id string, text string")
    subs = spark.createDataFrame([(str(i), b) for i, b in enumerate(bodies) if b is not None], "doc_id string, body string")
    found = validate.validate(docs, subs)
    out = {}
    for r in found.orderBy("file", "entity_index").collect():
        out.setdefault(int(r.file[:-5]), []).append(r.code)
    return out, validate.summary(docs, found).first().asDict()


def test_validation(spark):
    good = {"text": "ho", "type": SYMPTOM, "candidates": [], "assertions": [], "position": [0, 2]}
    bad = [
        good, {**good, "text": ""}, {**good, "type": "X"}, {**good, "position": [0]}, {**good, "position": [0, 99]}, {**good, "position": [1, 3]}, {**good, "assertions": "x"}, {**good, "assertions": ["x", 1]},
        {**good, "type": "TÊN_XÉT_NGHIỆM", "assertions": ["isNegated"]}, {**good, "candidates": [1]}, {**good, "candidates": ["x"]}, {**good, "extra": 1}, {k: v for k, v in good.items() if k != "text"}, 7, {**good, "position": [False, 2]}, {**good, "position": [0.0, 2]},
    ]
    codes, total = issues_of(spark, "ho x", *[json.dumps([b]) for b in bad], None, "{", "{}", "[]")
    assert codes == {
        1: ["invalid_text", "span_text_mismatch"], 2: ["invalid_type"], 3: ["invalid_position"], 4: ["position_out_of_bounds"], 5: ["span_text_mismatch"], 6: ["invalid_assertions"], 7: ["invalid_assertion"] * 2,
        8: ["assertions_not_allowed"], 9: ["invalid_candidates"], 10: ["candidates_not_allowed"], 11: ["extra_keys"], 12: ["missing_keys", "invalid_text"], 13: ["entity_not_object"], 15: ["invalid_position"],
        16: ["missing_output"], 17: ["invalid_json"], 18: ["root_not_array"],
    }
    assert total == {"checked_files": 20, "valid_files": 3, "invalid_files": 17, "issues": 20}


def test_diff(spark):
    schema = "file string, ord int, text string, type string, start int, end int, candidates array<string>"
    before = spark.createDataFrame([("1", 0, "a", DIAGNOSIS, 0, 1, ["x"]), ("1", 1, "a", DIAGNOSIS, 0, 1, ["y"]), ("1", 2, "b", DRUG, 2, 3, [])], schema)
    after = spark.createDataFrame([("1", 0, "a", DIAGNOSIS, 0, 1, ["x"]), ("1", 1, "gan", DIAGNOSIS, 5, 8, []), ("2", 0, "Hội chứng x", DIAGNOSIS, 0, 5, ["G20.C"])], schema)
    assert [(r.text, r.old) for r in diff.changed(before, after).collect()] == [("a", ["y"])]
    assert {r.text for r in diff.added(before, after).collect()} == {"gan", "Hội chứng x"} and [r.text for r in diff.dropped(before, after).collect()] == ["b"]
    assert {r.reason for r in diff.suspicious(after).collect()} == {"generic diagnosis", "syndrome mapped to Parkinson"}
    assert {r.type: (r.before, r.after, r.delta) for r in diff.type_counts(before, after).collect()} == {DIAGNOSIS: (2, 3, 1), DRUG: (1, 0, -1)}
    text_ = diff.report(before, after)
    assert "| **TOTAL** | **3** | **3** | **+0** |" in text_ and "## Added" in text_


def test_tables(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿code,name,parent_code,level,aliases\nROOT,ICD,,0,\nA,\"x, y\",ROOT,1,p| q \n", encoding="utf-8")
    rows = {r.code: r for r in files.read_codes(spark, str(tmp_path / "a.csv")).collect()}
    assert rows["A"].name == "x, y" and rows["A"].aliases == ["p", "q"] and rows["ROOT"].parent_code is None
    line = lambda *f: "|".join({0: f[0], 1: f[1], 12: f[2], 14: f[3], 16: f[4]}.get(i, "") for i in range(18))
    (tmp_path / "r.rrf").write_text("\n".join([line("7", "ENG", "SCD", "asp  81", "N"), line("7", "ENG", "IN", "Aspirin", "N"), line("7", "ENG", "BN", "ASPIRIN", "N"), line("7", "ENG", "BN", "Bayer", "O"), line("7", "SPA", "IN", "x", "N"), "short|ENG"]), encoding="utf-8")
    grouped = etl.group_terms(files.read_rrf(spark, str(tmp_path / "r.rrf"))).collect()
    assert [(r.rxcui, r.name, r.tty, r.synonyms) for r in grouped] == [("7", "Aspirin", "IN", ["asp 81"])]
    xml = "<t><chapter><name>1</name><desc>C  1</desc><section id='A00-A09'><desc>S</desc><diag><name>A00</name><desc>Cholera</desc><inclusionTerm><note>n <b>1</b></note><note>n 1</note></inclusionTerm><diag><name>A00.0</name><desc>d</desc></diag></diag><diag><name>B</name></diag></section></chapter></t>"
    (tmp_path / "x.xml").write_text(xml)
    got = [(r.code, r.parent_code, r.level, r.aliases) for r in files.read_xml_codes(spark, str(tmp_path / "x.xml")).orderBy("ord").collect()]
    assert got == [("ROOT", "", 0, []), ("CHAPTER_1", "ROOT", 1, []), ("SECTION_A00-A09", "CHAPTER_1", 2, []), ("A00", "SECTION_A00-A09", 3, ["n 1"]), ("A00.0", "A00", 4, [])]
    nodes = spark.createDataFrame([("A", ["x"]), ("B", [])], "code string, aliases array<string>")
    extra = spark.createDataFrame([("A", "X", 0), ("A", "y", 1), ("A", "Y", 2), ("C", "z", 3)], "code string, alias string, ord int")
    assert {r.code: r.aliases for r in etl.merge_aliases(nodes, extra).collect()} == {"A": ["x", "y"], "B": []}
    assert {r.code: r.aliases for r in etl.merge_aliases(nodes, extra, fold=False).collect()} == {"A": ["x", "X", "y", "Y"], "B": []}
    crawled = spark.createDataFrame([("A", "tên", "(A) tên khác|A", "type"), ("A", "no", "", "chapter")], "code string, name string, aliases string, model string")
    assert [r.alias for r in files.crawled_aliases(crawled).orderBy("ord").collect()] == ["tên", "tên khác"]


def test_crawl(spark):
    page = lambda html: json.dumps({"status": "success", "data": {"id": "x", "data": {"html": html}}})
    node = lambda i, m, name, html="": json.dumps({"status": "success", "data": {"id": i, "model": m, "is_leaf": False, "data": {"id": i, "name": name, "html": html}}})
    disease = 'href="disease/d1" name="A00.0" field" hidden>name</div><div class="id" hidden>d1</div><div class="content d-inline-block" >Tả &amp; x</div><span class="icons"> <div class="content-raw" hidden>d1:'
    replies = [
        ("root", "ROOT", json.dumps({"status": "success", "data": [{"id": "I", "model": "chapter", "is_leaf": False, "data": {"id": "I", "name": "(I) Chương"}}]})),
        ("chapter", "I", node("I", "chapter", "(I) Chương", '<a href="section/A00-A09"> <a href="type/skip">')),
        ("section", "A00-A09", node("A00-A09", "section", "(A00-A09) Mục", '<a href="type/A00">')),
        ("type", "A00", node("A00", "type", "(A00) Bệnh tả", disease)),
    ]
    rows = {r.code: r for r in files.crawl_tree(spark.createDataFrame(replies, "model string, id string, payload string")).collect()}
    assert {k: (r.parent_code, r.level, r.name) for k, r in rows.items()} == {"ROOT": ("", "0", "ICD-10"), "I": ("ROOT", "1", "Chương"), "A00-A09": ("I", "2", "Mục"), "A00": ("A00-A09", "3", "Bệnh tả"), "A00.0": ("A00", "4", "Tả & x")}
    assert rows["A00"].aliases == "(A00) Bệnh tả" and page("")
    # neighbours within the looked-at signs, one without a shown name, pages that link in a circle
    one = lambda i, shown: f'href="disease/d{i}" name="A00.{i}" field" hidden>name</div><div class="id" hidden>d{i}</div>' + (f'<div class="content d-inline-block" >{shown}</div><span class="icons"> <div class="content-raw" hidden>d{i}:' if shown else "")
    html = '<a href="type/A01"><a href="type/A00">' + "".join(one(i, "" if i == 3 else f"Tên  {i}") for i in range(1, 6))
    more = [*replies[:3], ("type", "A00", node("A00", "type", "(A00) Bệnh tả", html)), ("type", "A01", node("A01", "type", "(A01) x", '<a href="type/A00">' + one(9, "y")))]
    rows = {r.code: (r.parent_code, r.level, r.name) for r in files.crawl_tree(spark.createDataFrame(more, "model string, id string, payload string")).collect()}
    assert {k: v for k, v in rows.items() if k.startswith("A00.")} == {**{f"A00.{i}": ("A00", "4", "A00.3" if i == 3 else f"Tên {i}") for i in range(1, 6)}, "A00.9": ("A01", "5", "y")}
    assert rows["A01"] == ("A00", "4", "x")


def test_files(spark, tmp_path, knowledge):
    source, out = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    for name, body in {"10.txt": "dùng Aspirin\r\nx", "2.txt": "không ho", "3.txt": "", "x.md": "no"}.items():
        (source / name).write_bytes(body.encode())
    docs = files.read_documents(spark, str(source))
    assert {r.doc_id: r.text for r in docs.collect()} == {"10": "dùng Aspirin\nx", "2": "không ho", "3": ""}
    assert [r.doc_id for r in files.read_documents(spark, str(source), 1).collect()] == ["2"]
    assert sinks.write_submissions(link_batch(docs, knowledge), str(out)) == 3
    assert json.loads((out / "2.json").read_text())[0]["assertions"] == ["isNegated"] and json.loads((out / "3.json").read_text()) == []
    saved = files.read_submissions(spark, str(out))
    assert validate.validate(docs, saved.select(F.regexp_replace("file", r"\.json$", "").alias("doc_id"), "body")).isEmpty()
    rows = {(r.file, r.text, r.start) for r in files.saved_entities(saved).collect()}
    assert rows == {("2.json", "ho", 6), ("10.json", "Aspirin", 5)}
    summary = sinks.export_graph(knowledge.nodes, str(tmp_path / "graph"), ["E11"])
    assert summary["is_arborescence"] and summary["nodes"] == len(NODES) and summary["sample_paths"]["E11"][-1] == "E11"


class Poisoned:
    """An extractor that fails on one word."""

    def extract(self, chunks):
        bad = F.raise_error(F.lit("poisoned text")).cast("string")
        return extract.RuleExtractor().extract(chunks.withColumn("text", F.when(F.contains("text", F.lit("poison")), bad).otherwise(F.col("text"))))


def test_safe_mode(spark, tmp_path, knowledge):
    """A text that fails leaves the others their results."""
    from termweave.plans.linking import link_files

    docs = spark.createDataFrame([(str(i), "poison" if i == 3 else "không ho") for i in range(6)], "doc_id string, text string")
    n, failed = link_files(docs, knowledge, Poisoned(), str(tmp_path / "out"), safe=True)
    assert n == 6 and [i for i, _ in failed] == ["3"] and "poisoned" in failed[0][1]
    found = {p.stem: json.loads(p.read_text()) for p in (tmp_path / "out").glob("*.json")}
    assert found.pop("3") == [] and len(found) == 5 and all(len(f) == 1 for f in found.values())
    with pytest.raises(Exception, match="poisoned"):
        link_files(docs, knowledge, Poisoned(), str(tmp_path / "out"))


def test_debug_files(spark, tmp_path):
    """Prompt and answer of chunks without an entity are written for inspection."""
    docs = spark.createDataFrame([("a", "Bệnh nhân ho."), ("b", "sốt")], "doc_id string, text string")
    found = extract.extract_entities(docs, extract.ModelExtractor(stub(), debug_dir=str(tmp_path / "debug"))).collect()
    assert [r.doc_id for r in found] == ["a"]
    written = {p.name: p.read_text() for p in (tmp_path / "debug").iterdir()}
    assert list(written) == ["b_chunk_0_0_3.txt"]
    assert "sốt" in written["b_chunk_0_0_3.txt"] and "<empty>" in written["b_chunk_0_0_3.txt"]


def test_stream(spark, tmp_path, knowledge):
    from termweave.streaming.linking import arriving_documents, link_stream

    source = tmp_path / "in"
    source.mkdir()
    (source / "a.txt").write_text("không ho")
    query = link_stream(arriving_documents(spark, str(source)), knowledge, str(tmp_path / "out"), str(tmp_path / "mark"))
    query.awaitTermination()
    assert [r.doc_id for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["a"]


def test_kept_vectors(spark, tmp_path, knowledge):
    sinks.write_vectors(knowledge.documents, lambda texts: [[float(len(t)), 1.0] for t in texts], str(tmp_path / "v"), "m")
    assert files.kept_vectors(spark, str(tmp_path / "v"), "m", knowledge.documents).count() == knowledge.documents.count()
    assert files.kept_vectors(spark, str(tmp_path / "v"), "other", knowledge.documents) is None
    assert files.kept_vectors(spark, str(tmp_path / "v"), "m", knowledge.documents.limit(2)) is None


def test_search_of_equal_documents(spark):
    """Of very many equal documents only the lowest ids take part, and the best are the same."""
    names = ["red ring", "Red  ring", "red bolt", "ring/red", "cold ring bolt"]
    docs = spark.createDataFrame([(str(i), names[i % 5], [f"brand {i % 3}", "tiny ring"][: i % 3]) for i in range(600)], "id string, text string, aliases array<string>")
    asked = queries(spark, "red ring", "brand 1", "bolt", "tiny")
    every = search.lexical_scores(asked, search.terms_of(docs))
    few = search.lexical_scores(asked, search.terms_of(docs), k=4)
    assert few.count() < 200 < every.count()
    best = lambda scored: sorted(search.top_k(scored, 4).select("query_id", "id", "score").collect())
    assert best(few) == best(every) == sorted(search.sparse_search(asked, docs, 4, bm25=False).select("query_id", "id", "score").collect())
    assert search.candidates(docs, 4).count() == 15 * 4


def test_vector_scores_in_tiles():
    """A block of queries and a block of vectors never give all their scores at once."""
    import tracemalloc

    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(3)
    vectors, asked = rng.integers(-2, 3, (5000, 8)).astype(float), rng.integers(-2, 3, (1000, 8)).astype(float)
    batch = pd.DataFrame({"id": [str(i) for i in range(5000)], "embedding": list(vectors)})
    tracemalloc.start()
    got = search.best_of(np.array([str(i) for i in range(1000)], dtype=object), asked, batch, 3, 6)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 70e6  # all scores take 40 MB, and each step on them as much again
    norms = np.where((n := np.linalg.norm(vectors, axis=1)) == 0, 1e-9, n)
    for q in range(0, 1000, 50):
        if (size := np.linalg.norm(asked[q])) > 0:
            scores = (vectors @ asked[q] / norms / size).round(6)
            want = sorted((-s, str(i)) for i, s in enumerate(scores) if s > 0)[:3]
            assert [(-s, i) for s, i in zip(*got[got["query_id"] == str(q)][["score", "id"]].values.T)] == want


def test_chunks_leave_in_small_batches(spark, monkeypatch):
    """What a worker holds of its chunks doesn't grow with the documents of a batch."""
    import pyarrow as pa

    texts = ["", None, *["Một câu ngắn. " * n for n in (1, 40, 200, 90, 3) * 8]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").coalesce(1)
    want = [(i, k, a, b, t[a:b]) for i, t in enumerate(texts) for k, (a, b) in enumerate(chunk.split_text(t, chunk.NOTES))]
    rows = chunk.chunks(docs).select("doc_id", "chunk_index", "start", "end", "text")
    assert rows.schema["doc_id"].dataType.simpleString() == "int" and [tuple(r) for r in rows.collect()] == want
    monkeypatch.setattr(chunk, "HELD_CHARS", 2000)
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": texts})
    parts = [b.to_pylist() for b in chunk.chunk_batches(iter([batch]), chunk.NOTES)]
    assert [tuple(r.values()) for p in parts for r in p] == want
    assert max(sum(len(r["text"]) for r in p) for p in parts) < 2000 + 200 * 14 and len(parts) > 8


def test_short_rows_make_many_parts(spark, tmp_path):
    """Parts of a table of short rows grow in number, not in size; fields of answers are read
    once, with nulls and mixed lists as before."""
    spark.range(200000).write.parquet(str(tmp_path / "t"))
    assert files.spread(spark.read.parquet(str(tmp_path / "t")), 50_000).rdd.getNumPartitions() > 8
    item = '{"entities": [{"text": "ho", "type": "THUỐC", "position": %s, "assertions": %s, "candidates": %s}]}'
    cases = [("[0, 2]", "[]", "null"), ("[0, null]", "[]", "[]"), ("[0, 2.5]", "[]", "[]"), ("[0, 2]", "[null]", "[]"), ("[0, 2]", "null", "[]"), ("[0, 3000000000]", "[]", "[]"), ("[0, 2]", '["isFamily", "isFamily"]', '["1", 2]')]
    rows = spark.createDataFrame([(k, item % c) for k, c in enumerate(cases)], "k int, generated string")
    got = [r.entities[0].asDict() if r.entities else None for r in model_json.parse_answers(rows).orderBy("k").collect()]
    assert [g and (g["position"], g["assertions"], g["candidates"]) for g in got] == [([0, 2], [], []), None, None, None, None, None, ([0, 2], ["isFamily"], ["1", "2"])]


def test_bm25_best_is_taken_where_documents_are(spark, monkeypatch):
    docs = spark.createDataFrame([(str(i), " ".join("abcdefgh"[(i * j) % 8] for j in range(1, i % 7 + 2)), []) for i in range(300)], "id string, text string, aliases array<string>")
    index, asked = search.Bm25Index.build(docs), queries(spark, "a b", "c c-d", "h", "zz", "a a e g")
    best = lambda: sorted(tuple(r) for r in index.best(asked, 4, 6).select("query_id", "id", "score").collect())
    want = sorted(tuple(r) for r in search.top_k(index.scores(asked).withColumn("score", F.round("score", 6)), 4).select("query_id", "id", "score").collect())
    monkeypatch.setattr(search, "BM25_DOCUMENTS", 7)
    assert best() == want and len(want) == 16
    monkeypatch.setattr(search, "BM25_QUERIES", 2)
    assert best() == want
