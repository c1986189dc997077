"""The pipeline's stages against what each must do, worked out plainly from its own input."""

import json
import random
from collections import Counter, defaultdict

import corpus_pipeline
from termweave.llm.common import stage

rng = random.Random(11)
WORDS = ["".join(rng.choices("klmnoprst", k=rng.randint(2, 7))) for _ in range(2000)]


def sentence(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n)).capitalize() + "."


def body(seed, n=4):
    return "\n".join(sentence(18, seed * 50 + i) for i in range(n))


def corpus():
    item = sentence(30, 777777)
    passage = sentence(60, 888888)
    docs = [(i, body(i), "en", f"s{i % 3}", 1) for i in range(150)]
    docs += [(200 + i, "\n".join(" ".join(w + "***" for w in x.split()) for x in body(900 + i).split("\n")), "en", "s0", 1) for i in range(40)]
    docs += [(300 + i, body(1000 + i) + "\n" + passage, "en", "s1", 1) for i in range(4)]
    near = sentence(120, 5)
    docs += [(400 + i, near.replace(near.split()[7 + 9 * i], "changed"), "de", None, 1) for i in range(5)]
    docs += [(500, body(2000) + "\n" + item.replace(".", "") + " tail", "en", "s2", 1), (501, None, "en", "s2", 1), (502, "", None, None, 1), (503, body(3), "en", "s0", 1)]
    labels = [(i, 1, 0) for i in range(0, 150)] + [(200 + i, 0, 1) for i in range(40)]
    return docs, labels, [(1, item)]


def test_stages(spark, tmp_path):
    docs, labels, bench = corpus()
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    frame = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for name, step in corpus_pipeline.STAGES:
        frame = stage(step(spark, frame, str(tmp_path)), f"test-{name}")
        seen[name] = {r.doc_id: r.asDict() for r in frame.collect()}
        if name != "mixing":
            assert frame.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    texts = {d: t for d, t, *_ in docs}
    kept = seen["quality"]
    assert not any(200 <= d < 240 for d in kept) and all(d in kept for d in [*range(150), *range(300, 304), *range(400, 405), 500, 503])
    # line dedup: every repeated long line stays in the first document alone
    first = {}
    for d in sorted(kept):
        for line in (texts[d] or "").split("\n"):
            if len(line) >= 120:
                first.setdefault(line, d)
    for d, r in seen["line_dedup"].items():
        for line in (r["text"] or "").split("\n"):
            assert len(line) < 120 or first[line] == d
        assert r["n_chars"] == (None if r["text"] is None else len(r["text"]))
    assert seen["line_dedup"].keys() == kept.keys() and seen["line_dedup"][300]["text"] == texts[300]
    # near copies: one of each class, by force
    before = seen["line_dedup"]

    def grams(t):
        w = (t or "").split()
        k = min(5, len(w))
        return Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else Counter()

    sets = {d: grams(r["text"]) for d, r in before.items()}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b:
                both = sum((sets[a] & sets[b]).values())
                total = sum(sets[a].values()) + sum(sets[b].values()) - both
                if (before[a]["text"] or "") == (before[b]["text"] or "") or (both and both / total >= 0.8):
                    parent[max(find(a), find(b))] = min(find(a), find(b))
    assert set(seen["near_dedup"]) == {find(d) for d in ids}
    assert set(seen["decontaminate"]) == set(seen["near_dedup"]) - {500}
    mixed, sizes = seen["mixing"], defaultdict(int)
    for d, r in seen["decontaminate"].items():
        sizes[r["source"]] += len((r["text"] or "").split())
    for source in sizes:
        rows = [r for r in mixed.values() if r["source"] == source]
        assert abs(sum(r["taken"] for r in rows) - rows[0]["target"]) <= 0.02 * rows[0]["target"] + 1
        assert all(0 < r["taken"] <= 3 * r["size"] and r["source_size"] == sizes[source] for r in rows)
    assert json.dumps(sorted(map(str, corpus_pipeline.run(spark, str(tmp_path)).toPandas()["doc_id"]))) == json.dumps(sorted(map(str, mixed)))
