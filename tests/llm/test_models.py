"""Operators without SQL, against brute force or held-out accuracy."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from termweave.llm import decontaminate, line_labels, mixing, near_dedup, pii, quality, token_counts, warc

random.seed(5)
WORDS = ["".join(random.choices("abcdefghij", k=random.randint(2, 7))) for _ in range(3000)]


def prose(n, seed):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) for _ in range(n))


def changed(text, n, seed):
    rng, words = random.Random(seed), text.split()
    for _ in range(n):
        words[rng.randrange(len(words))] = rng.choice(WORDS)
    return " ".join(words)


def corpus():
    rows = [(i, prose(120, i)) for i in range(60)]
    rows += [(100 + i, changed(prose(120, 7), i % 6, i)) for i in range(60)]  # a group of near copies of all degrees
    rows += [(200 + i, prose(120, 3)) for i in range(5)] + [(300, None), (301, ""), (302, "two words"), (303, "two words"), (304, "other words"), (305, "a b c d e " * 500), (200, prose(120, 3)), (200, "else"), (None, prose(50, 999)), (None, prose(50, 998)), (None, prose(50, 998))]
    return rows


def classes_by_force(rows):
    def shingles(t):
        w = (t or "").split()
        k = min(5, len(w))
        return Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else Counter()

    sets = [(d, t or "", shingles(t)) for d, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (_, t, a) in enumerate(sets):
        for j, (_, u, b) in enumerate(sets[:i]):
            both = sum((a & b).values())
            union = sum(a.values()) + sum(b.values()) - both
            if t == u or (both and both / union >= 0.8):
                parent[find(i)] = find(j)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(i)
    out = []
    for members in groups.values():
        ids = [rows[i][0] for i in members if rows[i][0] is not None]
        out += [(rows[i][0], min(ids, default=None)) for i in members]
    return sorted(out, key=str)


def test_near_classes(spark):
    rows = corpus()
    frame = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, node string").repartition(3)
    got = sorted(((r.doc_id, r.class_id) for r in near_dedup.classes(frame.select("doc_id", "text")).collect()), key=str)
    assert got == classes_by_force(rows)
    kept = near_dedup.keep_one(frame).collect()
    assert len(kept) == len({c for _, c in got if c is not None}) + 2
    assert kept[0].node == "x"


def test_near_blocks(spark, monkeypatch):
    """Buckets cut into blocks give the same classes."""
    monkeypatch.setattr(near_dedup, "BLOCK", 4)
    monkeypatch.setattr(near_dedup, "WIDE", 5)
    rows = [(i, changed(prose(60, 1), i % 9, i)) for i in range(70)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    assert sorted(((r.doc_id, r.class_id) for r in near_dedup.classes(frame).collect()), key=str) == classes_by_force(rows)


def test_near_rounds(spark, monkeypatch):
    """Buckets of several groups, with more hubs, give the same classes."""
    monkeypatch.setattr(near_dedup, "BLOCK", 2)
    monkeypatch.setattr(near_dedup, "BLOCK_BYTES", 4000)
    base = prose(60, 1).split()
    rows = [(100 * g + i, changed(" ".join(base[: 60 - 7 * g]) + " " + prose(7 * g, 50 + g), i % 3, 7 * i + g)) for g in range(4) for i in range(14)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    assert sorted(((r.doc_id, r.class_id) for r in near_dedup.classes(frame).collect()), key=str) == classes_by_force(rows)


def test_long_texts(spark):
    long = prose(300_000, 9)
    rows = [(1, long), (2, long + " more"), (3, "a " * 200_000), (4, "a " * 190_000), (5, "a " * 100_000), (6, long[: len(long) // 2])]
    got = near_dedup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.class_id) for r in got) == [(1, 1), (2, 1), (3, 3), (4, 3), (5, 5), (6, 6)]


def test_darts_estimate_weighted_jaccard():
    def of(text):
        return near_dedup.weighted(near_dedup.shingles(text))

    a, b = prose(400, 1), changed(prose(400, 1), 25, 2)
    x, y = of(a), of(b)
    m = near_dedup.dart_minima([x, y, x])
    assert (m[0] == m[2]).all()
    assert abs((m[0] == m[1]).mean() - near_dedup.similarity(near_dedup.cells_of(a), near_dedup.cells_of(b))) < 0.15
    # a batch does not change a text's darts, nor does a higher bound
    assert (near_dedup.dart_minima([x]) == m[0]).all() and (near_dedup.dart_minima([x], 4 * near_dedup.DARTS) == m[0]).all()
    # weights far apart, over many draws: the share of equal minima is the weighted index
    rng = np.random.default_rng(3)
    want, same = [], []
    for _ in range(60):
        key = rng.integers(0, 1 << 63, 12, dtype=np.uint64)
        v, w = rng.integers(1, 200, 12), rng.integers(1, 200, 12)
        want.append(np.minimum(v, w).sum() / np.maximum(v, w).sum())
        m = near_dedup.dart_minima([(key, v), (key, w)])
        same.append((m[0] == m[1]).mean())
    assert abs(np.mean(want) - np.mean(same)) < 0.02
    assert np.corrcoef(want, same)[0, 1] > 0.7


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(200 + i, 260) for i in range(20)] + [(5, 5)]
    code = lambda n: n.to_bytes(2, "big")
    got = near_dedup.components(spark.createDataFrame([(bytearray(code(a)), bytearray(code(b))) for a, b in edges], "a binary, b binary"))
    found = {int.from_bytes(r.node, "big"): int.from_bytes(r.comp, "big") for r in got.collect()}
    assert found == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}, **{200 + i: 200 for i in range(20)}, 260: 200}


@pytest.mark.parametrize("few", [0, 10, 100])
def test_few_links_are_united_at_once(spark, monkeypatch, few):
    """Rounds alone, rounds and a task for the rest, and one task write the same components;
    the last writes one table, whatever the diameter."""
    edges = [(i, i + 1) for i in range(9)] + [(100 + i, 140) for i in range(20)] + [(7, 3), (100, 99), (150, 150)]
    frame = spark.createDataFrame([(bytearray([a]), bytearray([b])) for a, b in edges], "a binary, b binary")
    staged = []
    monkeypatch.setattr(near_dedup, "FEW_LINKS", few, raising=False)
    monkeypatch.setattr(near_dedup, "stage", lambda df, name, f=near_dedup.stage: staged.append(name) or f(df, name))
    found = {r.node[0]: r.comp[0] for r in near_dedup.components(frame).collect()}
    assert found == {**{i: 0 for i in range(10)}, **{100 + i: 99 for i in range(20)}, 99: 99, 140: 99}
    assert few < len(edges) or staged == ["cc-labels"]


def test_decontamination(spark):
    item = "Mary has 5 apples and gives 2 kg to Peter before she walks home with 5 friends along the river bank."
    plain = prose(40, 11)
    bench = spark.createDataFrame([(1, item), (2, plain), (3, "six words make up an item"), (4, None), (5, "too short"), (6, plain)], "item_id long, text string")
    docs = [
        (0, prose(50, 1) + " " + plain + " " + prose(50, 2), [2, 6]),
        (1, "Intro. Anna has 7 apples and gives 3 kg to Oscar before she walks home with 7 friends along the river bank. End", [1]),
        (2, "Intro. Anna has 7 apples and gives 3 kg to Oscar before she walks home with 8 friends along the river bank. End", []),
        (3, prose(200, 3), []),
        (4, None, []),
        (5, "", []),
        (6, "here six words make up an item again", [3]),
        (7, prose(10, 4) + " " + " ".join(plain.split()[:9]), []),
        (7, plain, [2, 6]),
        (None, plain.upper() + " " + " ".join(plain.split()[5:30]), [2, 6]),
        (9, "7 " * 3000, []),
    ]
    frame = spark.createDataFrame([(d, t, "x") for d, t, _ in docs], "doc_id long, text string, item_id string")
    got = [(r.doc_id, r.text, [x.item_id for x in r["__items"]]) for r in decontaminate.find_items(frame, bench).collect()]
    key = lambda r: (str(r[0]), str(r[1]))
    assert sorted(got, key=key) == sorted(docs, key=key)
    kept = decontaminate.clean(frame, bench)
    assert kept.columns == frame.columns and kept.count() == sum(not i for *_, i in docs)


def test_decontamination_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 50)
    bench = spark.createDataFrame([(i, prose(30, i)) for i in range(6)], "item_id long, text string")
    docs = spark.createDataFrame([(i, prose(20, 100) + " " + prose(30, i) + " " + prose(30, (i + 1) % 6)) for i in range(6)], "doc_id long, text string")
    for r in decontaminate.find_items(docs, bench).collect():
        assert [x.item_id for x in r["__items"]] == sorted([r.doc_id, (r.doc_id + 1) % 6])


def junk(n, seed):
    return " ".join(w + random.Random(seed).choice(["***", "&&&", "$$$"]) for w in prose(n, seed).split())


def lines(make, n, seed):
    return "\n".join(make(20, seed * 100 + i).capitalize() + "." for i in range(n))


def labelled(spark):
    docs = [(i, lines(junk, 5, i) if i % 3 == 0 else lines(prose, 5, i)) for i in range(600)]
    labels = [(i, int(i % 3 != 0), 0) for i in range(600)]
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality(spark):
    docs, labels = labelled(spark)
    odd = spark.createDataFrame([(1000, None), (1001, ""), (1002, "x" * 300000), (None, "a b")], "doc_id long, text string")
    x = quality.features(docs.union(odd))
    out = {r.doc_id: r.score for r in quality.scored(x, quality.fit(x, labels)).collect()}
    assert len(out) == 604 and all(0 <= s <= 1 for s in out.values()) and out[1000] == out[1001]
    for i in range(600):
        assert (out[i] >= 0.5) == (i % 3 != 0)
    # labels of held-out rows are not looked at
    other = labels.withColumn("quality", quality.F.when(quality.fold(quality.F.col("doc_id")) == 0, 1 - quality.F.col("quality")).otherwise(quality.F.col("quality")))
    again = {r.doc_id: r.score for r in quality.scored(x, quality.fit(x, other)).collect()}
    assert again == out
    assert {r.score for r in quality.scored(x, quality.fit(x, labels.where("quality = 1"))).collect()} != set()


def test_quality_by_force(spark):
    """The fitted model against ridge and calibration worked out at once from all rows."""
    docs, labels = labelled(spark)
    noisy = labels.withColumn("quality", F.when(F.col("doc_id") % 7 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    for most in (600, 30):
        x = quality.features(docs).where(F.col("doc_id") < most)
        model = quality.fit(x, noisy)
        y = {r.doc_id: r.quality for r in noisy.collect()}
        rows = sorted((r.doc_id, r.x) for r in x.collect())
        fold = {i: __import__("zlib").crc32(str(i).encode()) % 5 for i, _ in rows}
        train = [(i, v) for i, v in rows if fold[i]]
        stats = np.array([v for _, v in train])
        mean, std = np.round(stats.mean(axis=0), 6), np.maximum(1e-3, np.round(stats.std(axis=0), 6))
        assert np.allclose(model.mean, mean, atol=2e-6) and np.allclose(model.std, std, atol=2e-6)
        phi, target, own = quality.fourier((stats - model.mean) / model.std), np.array([y[i] for i, _ in train], dtype=float), np.array([fold[i] for i, _ in train])

        def weights(keep):
            a, b = phi[keep], target[keep]
            return np.linalg.solve(a.T @ a + quality.RIDGE * max(1.0, keep.sum()) / quality.N_FEATURES * np.eye(a.shape[1]), a.T @ b)

        assert np.allclose(phi @ model.weights, phi @ weights(own > 0), atol=1e-3)
        raw = np.zeros(len(train))
        for f in (1, 2, 3, 4):
            raw[own == f] = phi[own == f] @ weights(own != f)
        # isotonic regression by its formula: the greatest mean from below of least means to above
        bins = quality.bin_of(raw)
        places = sorted(set(bins.tolist()))
        sums = {b: (target[bins == b].sum(), (bins == b).sum()) for b in places}
        ones, count = (np.concatenate([[0], np.cumsum([sums[b][k] for b in places])]) for k in (0, 1))
        fitted = []
        for k in range(len(places)):
            means = (ones[None, k + 1 :] - ones[: k + 1, None]) / (count[None, k + 1 :] - count[: k + 1, None])
            fitted.append(means.min(axis=1).max())
        n = np.array([float(sums[b][1]) for b in places])
        _, values = quality.isotonic(np.array([(b + 0.5) * 2 / quality.BINS - 0.5 for b in places]), n, np.array([sums[b][0] for b in places]))
        # equal neighbours of the formula are one block
        assert np.allclose(values, [v for v, _ in __import__("itertools").groupby(np.round(fitted, 9))], atol=1e-6)
        got = model.score(stats)
        assert abs(got - target).mean() < 0.35 and len(model.values) == len(values)


def test_isotonic():
    knots, values = quality.isotonic(np.array([0.0, 1.0, 2.0, 3.0]), np.array([1.0, 1.0, 1.0, 1.0]), np.array([0.0, 1.0, 0.0, 1.0]))
    assert values.tolist() == [0.0, 0.5, 1.0] and knots.tolist() == [0.0, 1.5, 3.0]


def base_by_force(text):
    words = [w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", text)]
    grams = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {i + k for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] > 1 for k in range(5)}
    full = [x for x in text.split("\n") if __import__("re").search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(full) - len(set(full)), len(covered)


def test_quality_rules(spark):
    docs, labels = labelled(spark)
    model = line_labels.train(line_labels.training_rows(docs, labels))
    odd = [(1000, None), (1001, ""), (1002, "a b c d e f " * 40), (1003, "x\nx\n\n \nx  y\x1cz"), (1004, "é#" * 50000), (1005, prose(9, 1)), (1005, prose(9, 1)), (None, prose(30, 2))]
    frame = docs.union(spark.createDataFrame(odd, "doc_id long, text string")).withColumn("kept", line_labels.F.lit("x"))
    texts = defaultdict(list)
    for r in frame.collect():
        texts[r.doc_id].append(r.text or "")
    for r in line_labels.quality_rules(frame, model).collect():
        n, chars, symbols, dup, repeated = base_by_force(texts[r.doc_id][0])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, repeated)
        assert r.base_failed == (n < 10 or 100 * repeated > 20 * n)
        if r.doc_id is not None and r.doc_id < 600:
            assert r.kept == (r.doc_id % 3 != 0)


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(1)
    for n in (1, 2, 6):
        emit, trans = rng.normal(size=(n, 2)), rng.normal(size=(2, 2))
        score = lambda p: sum(emit[i, x] for i, x in enumerate(p)) + sum(trans[a, b] for a, b in zip(p, p[1:]))
        best = max((score(p), p) for p in np.ndindex(*[2] * n))
        assert math.isclose(score(line_labels.viterbi(emit, trans)), best[0])


def test_apportion(spark):
    """All groups, of weights of all sizes, against giving seat by seat."""
    rng = random.Random(3)
    rows = [(g, i, rng.choice([0, 1, 5, 33, 1000]) * rng.random(), seats) for g, seats in (("a", 0), ("b", 1), ("c", 7), ("d", 100)) for i in range(9)]
    rows += [("e", i, 1.0, 50) for i in range(120)]
    frame = spark.createDataFrame(rows, "g string, e long, w double, s long")
    got = {(r.g, r.e): r.quota for r in mixing.apportion(frame, "g", "e", "w", "s").collect()}
    want = Counter()
    for g in "abcde":
        own = [r for r in rows if r[0] == g]
        for _ in range(own[0][3]):
            want[max(own, key=lambda r: (r[2] / (2 * want[r[:2]] + 1), -r[1]))[:2]] += 1
    assert got == {r[:2]: want[r[:2]] for r in rows}
    alone = {r.e: r.quota for r in mixing.apportion(frame.where("g = 'd'"), None, "e", "w", "s").collect()}
    assert alone == {e: n for (g, e), n in got.items() if g == "d"}


def test_mix_of_many_sources_and_empty_texts(spark, monkeypatch):
    """Thousands of sources, and one of empty texts: its rows are dealt to shards too."""
    monkeypatch.setattr(mixing, "SHARD_ROWS", 100)
    rows = [(i, prose(10 + i % 7, i), f"host{i % 1500}") for i in range(3000)] + [(10_000 + i, "", "empty") for i in range(2000)] + [(None, "", None)] * 3 + [(None, prose(30, 1), None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(frame).collect()
    assert len(got) == len(rows) and all(r.taken == 0 for r in got if not r.size)
    by = defaultdict(list)
    for r in got:
        by[r.target, r.source_size].append(r)
        assert 0 <= r.taken <= 3 * r.size and r.target <= 3 * r.source_size
    assert math.isclose(sum(r.taken for r in got), sum(r.size for r in got), rel_tol=0.02)
    carried = mixing.mix(frame, carry=True).where("doc_id IS NULL").collect()
    assert len(carried) == 4 and {r.text for r in carried} == {"", prose(30, 1)}


def test_mix_in_shards(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_WORDS", 3000)
    rows = [(i, prose(20 + i % 90, i), ["a", "b", None, "d"][min(i % 7, 3)], "x") for i in range(600)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, taken string")
    got = mixing.mix(frame).collect()
    by = defaultdict(list)
    for r in got:
        by[r.target, r.source_size].append(r)
        assert 0 <= r.taken <= 3 * r.size
    assert math.isclose(sum(t for t, _ in by), sum(r.size for r in got))
    for (target, _), members in by.items():
        assert abs(sum(r.taken for r in members) - target) <= 0.02 * target
        assert target <= 3 * members[0].source_size
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix(frame.repartition(7)).collect()))
    carried = mixing.mix(frame, carry=True)
    assert carried.columns == ["doc_id", "text", "source", "size", "source_size", "target", "taken"] and carried.count() == 600


COUNTS = "source string, lang string, tokenizer string, n_tokens long, old_tokens long"


def test_rollup(spark, tmp_path):
    store = token_counts.Rollup(spark, f"file://{tmp_path}/rollup")
    a = spark.createDataFrame([("s", "en", "t", 5, 0), ("s", "en", "t", 5, 0), (None, None, "t", None, 0)], COUNTS)
    assert store.totals().count() == 0
    assert store.commit("1", token_counts.inserts(a)) and not store.commit("1", token_counts.inserts(a))
    with pytest.raises(ValueError):
        store.commit("1", token_counts.inserts(a.limit(1)))
    assert store.commit("2", token_counts.revisions(spark.createDataFrame([("s", "en", "t", 9, 5)], COUNTS)))
    store.compact()
    # replays after compaction: the same content is known, other content is an error
    assert not store.commit("1", token_counts.inserts(a))
    with pytest.raises(ValueError):
        store.commit("2", token_counts.inserts(a))
    assert store.commit("3", token_counts.deletes(a.limit(1))) and store.commit("4", token_counts.inserts(a.limit(0)))
    for _ in range(3):
        store.compact()
    assert store.batches() == ["1", "2", "3", "4"]
    totals = {r.source: (r.n_docs, r.n_tokens) for r in store.totals().collect()}
    assert sum(n for n, _ in totals.values()) == 2 and sum(n for _, n in totals.values()) in (9, 14)
    assert not store.commit("3", token_counts.deletes(a.limit(1)))


def test_commit_during_compaction(spark, tmp_path):
    """A batch that is committed while a snapshot is made counts once."""
    store = token_counts.Rollup(spark, f"file://{tmp_path}/rollup")
    one = token_counts.inserts(spark.createDataFrame([("s", "en", "t", 4, 0)], COUNTS))
    two = token_counts.inserts(spark.createDataFrame([("s", "en", "t", 100, 0)], COUNTS))
    store.commit("1", one)
    listing = store.batches
    for moment in range(3):
        calls = iter(range(9))

        def racing():
            if moment == 0 and next(calls) == 0:
                store.commit("2", two)
            found = listing()
            if moment == 1 and next(calls) == 0:
                store.commit("3", two)
            return found

        store.batches = racing
        if moment == 2:
            summed = store._sum

            def late(names):
                out = summed(names)
                store.commit("4", two)
                return out

            store._sum = late
            store.compact()
            store._sum = summed
        else:
            store.compact()
        store.batches = listing
        assert [(r.n_docs, r.n_tokens) for r in store.totals().collect()] == [(2 + moment, 104 + 100 * moment)]


def test_claims_are_exclusive(spark, tmp_path):
    """Writers that race for one id: one wins, and one delta counts."""
    from concurrent.futures import ThreadPoolExecutor

    store = token_counts.Rollup(spark, f"file://{tmp_path}/rollup")
    with ThreadPoolExecutor(8) as pool:
        won = list(pool.map(lambda k: store._claim("claims/x", {"data": f"data/{k}", "mark": []}), range(40)))
    assert sum(won) == 1 and store._read("claims/x")["data"] == f"data/{won.index(True)}"
    two = token_counts.inserts(spark.createDataFrame([("s", "en", "t", 7, 0)], COUNTS))
    with ThreadPoolExecutor(4) as pool:
        assert sum(pool.map(lambda _: store.commit("y", two), range(4))) == 1


def test_bpe_counts(spark, tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    model = Tokenizer(models.WordLevel({"a": 0, "b": 1, "?": 2}, unk_token="?"))
    model.pre_tokenizer = pre_tokenizers.Whitespace()
    model.save(str(tmp_path / "t.json"))
    docs = spark.createDataFrame([(1, "s", "en", "a b c"), (2, None, None, None)], "doc_id long, source string, lang string, text string")
    assert [r.n_tokens for r in token_counts.bpe_counts(docs, str(tmp_path / "t.json"), "w-1").orderBy("doc_id").collect()] == [3, 0]


def test_broken_archives(spark):
    def segment(origin, number, total, block, several=True):
        return (origin, number, total, "response", {"warc-segment-number": "1"} if several else {}, bytearray(block))

    rows = [segment("ok", 2, 6, b"def"), segment("ok", 1, None, b"abc"), segment("ok", 1, None, b"abc"), segment("gap", 1, None, b"a"), segment("gap", 3, 3, b"c"), segment("sum", 1, None, b"a"), segment("sum", 2, 9, b"b"), segment("one", 1, None, b"x", False)]
    got = {r.origin: (r.block and bytes(r.block), r.error) for r in warc.reassemble(spark.createDataFrame(rows, warc.SEGMENTS)).collect()}
    assert got == {"ok": (b"abcdef", None), "gap": (None, "missing segment"), "sum": (None, "wrong total length"), "one": (b"x", None)}
    assert warc.dechunk(b"3;x=y\r\nabc\r\n2\r\nde\r\n0\r\n\r\n") == b"abcde"
    with pytest.raises(ValueError):
        warc.dechunk(b"5\r\nabc\r\n0\r\n\r\n")


def rows_of(spark, text, folder, compressed):
    import gzip

    folder.mkdir()
    data = text if isinstance(text, bytes) else text.encode()
    (folder / ("a.warc.gz" if compressed else "a.warc")).write_bytes(gzip.compress(data[: len(data) // 2]) + gzip.compress(data[len(data) // 2 :]) if compressed else data)
    return warc.read_segments(spark, f"file://{folder}", compressed).collect()


@pytest.mark.parametrize("compressed", [True, False])
def test_reading_archives(spark, tmp_path, compressed):
    """Records of other writers, with payloads that look like records or are no text."""
    blocks = [b"", b"\r\n", b"WARC/1.1\r\nWARC-Type: response\r\n\r\nWARC/1.0 WARC/1.", bytes(range(256)) * 50, b"x\r\n\r\n"]
    made = [b"WARC/1.0\r\nWARC-Record-ID: <urn:%d:http://a/WARC/1.1/b>\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (i, len(b), b) for i, b in enumerate(blocks)]
    got = rows_of(spark, b"".join(made), tmp_path / "whole", compressed)
    assert [bytes(r.block) for r in sorted(got, key=lambda r: r.origin)] == blocks
    for k, bad in enumerate((b"".join(made)[:-9], b"junk" + made[0], made[0][:-4] + b"junk\r\n\r\n" + made[1])):
        with pytest.raises(Exception, match="cut short|begin with a record|between records"):
            rows_of(spark, bad, tmp_path / f"bad{k}", compressed)


def test_long_record_is_reassembled_in_linear_time(spark, tmp_path):
    """A record of 128 MB in 8,192 segments."""
    n, size = 8192, 16384
    made = spark.range(n).select(F.lit("o").alias("origin"), (n - F.col("id")).cast("int").alias("number"), F.when(F.col("id") == 0, n * size).cast("long").alias("total"), F.lit("response").alias("type"), F.create_map(F.lit("warc-segment-number"), F.lit("1")).alias("fields"), F.expr(f"cast(repeat(char(65 + id % 26), {size}) as binary)").alias("block"))
    got = warc.reassemble(made).select("error", F.octet_length("block").alias("n"), F.sha2("block", 256).alias("h")).collect()
    import hashlib

    whole = b"".join(bytes([65 + (n - number) % 26]) * size for number in range(1, n + 1))
    assert [(r.error, r.n, r.h) for r in got] == [(None, n * size, hashlib.sha256(whole).hexdigest())]


def test_revisits_are_checked(spark):
    def row(name, page, kind, refers, stated, digest, error=None):
        return (name, page, kind, refers, 3, stated, 3 if digest else None, digest, error)

    rows = [row("r1", 1, "response", None, "d", "d"), row("r2", 2, "revisit", "r1", "d", None), row("r3", 3, "revisit", "r1", "other", None), row("r4", 4, "revisit", "none", "d", None), row("r5", 5, "response", None, "d", "e")]
    got = {r.page_id: (r.refers_to_page, r.payload_digest, r.error) for r in warc.resolved(spark.createDataFrame(rows, warc.PAYLOADS)).collect()}
    assert got[1] == (None, "d", None) and got[2] == (1, "d", None)
    assert got[3][2] == got[5][2] == "digest differs from the stated one" and got[4][2] == "no record for a revisit"


def test_redaction(spark):
    frame = spark.createDataFrame([(1, "to a@b.co or 4111 1111 1111 1111."), (2, None), (3, "none")], "doc_id long, text string")
    out = pii.redact(pii.pii_spans(frame))
    assert out.columns == ["doc_id", "text", "spans"]
    assert [r.text for r in out.orderBy("doc_id").collect()] == ["to <email> or <card>.", None, "none"]
    spans = "array(named_struct('kind', 'a', 'start', 0, 'end', 4, 'score', 9), named_struct('kind', 'b', 'start', 2, 'end', 8, 'score', 9), named_struct('kind', 'c', 'start', 5, 'end', 10, 'score', 9))"
    chain = spark.createDataFrame([(1, "abcdefghijkl")], "doc_id long, text string").withColumn("spans", F.expr(spans))
    assert [r.text for r in pii.redact(chain).collect()] == ["<a>kl"]


def test_added_kinds(spark):
    texts = {
        "IBAN: DE89 3704 0044 0532 0130 00 AND MORE": "iban:6:33",
        "pay GB82WEST12345698765432, now": "iban:4:26",
        "xDE89370400440532013000 DE893704004405320130001": "",
        "DE89 3704 0044 0532 0130 01": "",
        "SSN: 123-45-6789, 223-45-6789, 900-45-6789": "ssn:5:16,ssn:18:29",
        "123-45-6789 is the SSN": "ssn:0:11",
        "123-45-6789 is a number": "",
        'token = "' + "ab12" * 10 + '"': "secret:9:49",
        "commit " + "ab12" * 10: "",
        "token " + "abcd" * 10: "",
    }
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = [r.s for r in pii.pii_spans(frame).orderBy("doc_id").select(pii.joined(F.col("spans")).alias("s")).collect()]
    assert got == list(texts.values())


def test_many_spans_in_linear_time(spark):
    import time

    seconds = {}
    for n in (1000, 40_000, 80_000):
        text = " ".join(f"user{i}@host{i % 7}.example.com" for i in range(n))
        frame = spark.createDataFrame([(1, text)], "doc_id long, text string")
        begin = time.time()
        r = pii.pii_spans(frame).select(F.size("spans").alias("n"), F.element_at("spans", -1).alias("last")).first()
        seconds[n] = time.time() - begin
        assert r.n == n and r.last.end == len(text)
    assert seconds[80_000] < 2.5 * seconds[40_000] + 1
