"""Quality rules with line sequence labelling (operator 10).

Each line of a text is marked content or boilerplate by Viterbi decoding of a linear-chain
conditional random field; the share of words in content lines decides retention. Fixed
rules on the whole text come first.

The field is trained here: two labels, a bias and line statistics as emission features and
a tied transition weight, by gradient ascent on the conditional likelihood. Line labels for
training come from document labels: every line of a document of quality 1 counts as
content, every line of one of quality 0 as boilerplate, except short lines, which are
unknown and summed out (a hidden label, as clean lines occur in bad documents and boiler
lines in good ones). Training takes a bounded sample of the labelled documents: in order of
their crc32, at most ``TRAIN_DOCS``, as long as their lines are ``TRAIN_LINES`` in sum at most
(a document that would lead beyond is passed over). It takes whole documents, with the features that
scoring has, worked out on the executors. Chains of lines are trained in links of ``LINK``
lines, each for itself (piecewise training), of which every line is part.
Without usable labels a fixed start model is taken.

Defined results: a null text is an empty one; an empty text has no words, so it fails the
base rule; lines without a word carry no label; repeated documents are scored alike; an
empty table gives no rows; other columns are ignored. Work per text is linear in its
length and each text is handled whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termweave.llm.common import stage, table, unstage
from termweave.llm.words import mix, word_hashes

TRAIN_DOCS = 2000
TRAIN_LINES = 200_000
LINK = 64
KEEP_SHARE = 0.5
MIN_WORDS = 10
SYMBOLS = "#*$%&|<>"
#: A word this short a line leaves its label open in training.
KNOWN_WORDS = 8
N_FEATURES = 10
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def line_features(words: list[bytes], line: str, repeated: bool) -> list[float]:
    """Statistics of one line that has a word; all in 0..1."""
    chars = sum(map(len, words)) or 1
    upper = sum(map(str.isupper, line))
    letters = sum(map(str.isalpha, line)) or 1
    symbols = sum(map(line.count, SYMBOLS))
    odd = line.count("!") + line.count("=") + line.count("{") + line.count("}") + line.count("/") + line.count("_")
    ends = line.rstrip()[-1:] in ".?!:;\"'"
    digits = sum(map(str.isdigit, line))
    return [
        1.0,
        min(1.0, len(words) / 40),
        1.0 if len(words) < 4 else 0.0,
        min(1.0, chars / len(words) / 12),
        min(1.0, upper / letters),
        min(1.0, 4.0 * symbols / chars),
        min(1.0, 4.0 * odd / chars),
        1.0 if ends else 0.0,
        min(1.0, 4.0 * digits / chars),
        (1.0 if repeated else 0.0) + (1.0 - len(set(words)) / len(words)),
    ]


def text_lines(text: str) -> tuple[np.ndarray, np.ndarray, int]:
    """Features and word counts of the lines with a word, and how many of them repeat an
    earlier one."""
    seen: set[str] = set()
    feats, counts, dup = [], [], 0
    for line in text.split("\n"):
        words = line.encode("utf-8", "surrogatepass").split()
        if not words:
            continue
        again = line in seen
        seen.add(line)
        dup += again
        feats.append(line_features(words, line, again))
        counts.append(len(words))
    return np.array(feats, dtype=float).reshape(-1, N_FEATURES), np.array(counts, dtype=np.int64), dup


def viterbi(emit: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """The best label (1: content) of each line; ``emit`` is (lines, 2). Ties take the
    smaller label."""
    n = len(emit)
    if not n:
        return np.zeros(0, dtype=int)
    e = emit.tolist()
    (t00, t01), (t10, t11) = trans.tolist()
    a, b = e[0]
    back = []
    for x, y in e[1:]:
        from0, from1 = (0 if a + t00 >= b + t10 else 1), (0 if a + t01 >= b + t11 else 1)
        a, b = max(a + t00, b + t10) + x, max(a + t01, b + t11) + y
        back.append((from0, from1))
    label = 0 if a >= b else 1
    out = [label]
    for step in reversed(back):
        label = step[label]
        out.append(label)
    return np.array(out[::-1])


def _forward_backward(emit: np.ndarray, real: np.ndarray, trans: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Batched over chains: log-partition, label marginals, expected transitions (summed
    with the chains' weights). ``emit`` is (chains, steps, 2); ``real`` marks the steps that exist."""
    n, steps, _ = emit.shape
    alpha, beta = np.zeros_like(emit), np.zeros_like(emit)
    alpha[:, 0] = emit[:, 0]
    for t in range(1, steps):
        nxt = np.logaddexp(alpha[:, t - 1, 0, None] + trans[0], alpha[:, t - 1, 1, None] + trans[1]) + emit[:, t]
        alpha[:, t] = np.where(real[:, t, None], nxt, alpha[:, t - 1])
    for t in range(steps - 2, -1, -1):
        x = emit[:, t + 1] + beta[:, t + 1]
        prev = np.logaddexp(trans[:, 0][None] + x[:, 0, None], trans[:, 1][None] + x[:, 1, None])
        beta[:, t] = np.where(real[:, t + 1, None], prev, beta[:, t + 1])
    log_z = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])
    single = np.exp(alpha + beta - log_z[:, None, None]) * real[..., None]
    pairs = np.zeros((2, 2))
    for i in range(2):
        for j in range(2):
            p = alpha[:, :-1, i] + trans[i, j] + emit[:, 1:, j] + beta[:, 1:, j] - log_z[:, None]
            pairs[i, j] = (np.exp(np.where(real[:, 1:], p, -np.inf)) * weight[:, None]).sum()
    return log_z, single, pairs


#: Transitions are tied: one weight for keeping a label, its negative for a change. As the
#: training labels hold for whole documents, the weight is kept small.
STICK, MOST_STICK = np.array([[1.0, -1.0], [-1.0, 1.0]]), 0.4
START = (np.zeros((N_FEATURES, 2)), np.array([[0.5, -0.5], [-0.5, 0.5]]))
START[0][0, 1] = 1.0
START[0][4:7, 0] = 3.0


def likelihood(links: list[tuple[np.ndarray, ...]], w: np.ndarray, trans: np.ndarray, l2: float) -> tuple[float, np.ndarray, np.ndarray]:
    """The penalised conditional log-likelihood of the held labels, weighted by chain, and
    its gradients by features and by the tied transition weight."""
    value, gw, gt = 0.0, np.zeros_like(w), 0.0
    for x, real, bar, total in links:
        emit = np.einsum("ntf,fk->ntk", x, w) * real[..., None]
        z_free, free, pairs_free = _forward_backward(emit, real, trans, total)
        z_held, held, pairs_held = _forward_backward(emit + bar, real, trans, total)
        value += (total * (z_held - z_free)).sum()
        gw += np.einsum("ntf,ntk->fk", x, (held - free) * total[:, None, None])
        gt += ((pairs_held - pairs_free) * STICK).sum()
    stick = trans[0, 0]
    return value - l2 / 2 * ((w**2).sum() + stick**2), gw - l2 * w, gt - l2 * stick


def links_of(docs: list[tuple[np.ndarray, np.ndarray, int]]) -> list[tuple[np.ndarray, ...]]:
    """Links of the chains (features, word counts, quality), by length: features, which steps are real, bars
    against labels that are ruled out, and the weight of a link. Both qualities weigh the
    same, and within one all documents do."""
    share = np.array([sum(1 for *_, q in docs if q == k) for k in (0, 1)], dtype=float)
    cut: dict[int, list[tuple[np.ndarray, np.ndarray, int, float]]] = {}
    for f, c, q in docs:
        each = 0.5 / share[int(q)] / len(f)
        for at in range(0, len(f), LINK):
            part = f[at : at + LINK]
            # padded to a power of two
            cut.setdefault(1 << (len(part) - 1).bit_length(), []).append((part, c[at : at + LINK], int(q), each))
    out = []
    for steps, group in sorted(cut.items()):
        x, real, bar = np.zeros((len(group), steps, N_FEATURES)), np.zeros((len(group), steps), dtype=bool), np.zeros((len(group), steps, 2))
        for k, (f, c, q, _) in enumerate(group):
            x[k, : len(f)], real[k, : len(f)] = f, True
            bar[k, : len(f), 1 - q] = np.where(c >= KNOWN_WORDS, -30.0, 0.0)
        out.append((x, real, bar, np.array([e for *_, e in group])))
    return out


def train(docs: list[tuple[np.ndarray, np.ndarray, int]], rounds: int = 80, rate: float = 0.5, l2: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Weights (features, 2) and transitions (2, 2) from (features, word counts, quality)
    rows, by gradient ascent with momentum; deterministic."""
    chains = [row for row in docs if len(row[0])]
    if not any(q for *_, q in chains) or all(q for *_, q in chains):
        return START
    links = links_of(chains)
    w, stick = np.zeros((N_FEATURES, 2)), 0.0
    vw, vt = np.zeros_like(w), 0.0
    for _ in range(rounds):
        _, gw, gt = likelihood(links, w, stick * STICK, l2)
        vw, vt = 0.9 * vw + gw, 0.9 * vt + gt
        w, stick = w + rate * vw, float(np.clip(stick + rate * vt, -MOST_STICK, MOST_STICK))
    return np.round(w, 6), np.round(stick * STICK, 6)


def training_rows(docs: DataFrame, labels: DataFrame) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """The bounded sample of labelled rows whose crc32 mod 5 is not 0, as features and word
    counts of all their lines."""
    known = labels.where(F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    key = F.crc32(F.col("doc_id").cast("string"))
    picked = known.where(key % 5 != 0).orderBy(key, "doc_id").limit(TRAIN_DOCS)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(picked), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [text_lines(text.as_py())[:2] for text in batch.column(3)]
            columns = [pa.array([f.ravel() for f, _ in made], pa.list_(pa.float64())), pa.array([c for _, c in made], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in range(3)], *columns], ["doc_id", "quality", "seed", "feats", "counts"])

    made = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"), key.alias("seed"), "text")
    made = stage(made.mapInArrow(run, "doc_id long, quality int, seed long, feats array<double>, counts array<long>"), "rules-lines")
    taken, lines = [], 0
    for r in made.select("doc_id", F.size("counts").alias("n")).orderBy("seed", "doc_id").collect():  # TRAIN_DOCS rows at most
        if lines + r.n <= TRAIN_LINES:
            taken.append(r.doc_id)
            lines += r.n
    some = made.join(F.broadcast(made.sparkSession.createDataFrame([(d,) for d in taken], "doc_id long")), "doc_id", "left_semi")
    out = [(np.array(r.feats, dtype=float).reshape(-1, N_FEATURES), np.array(r.counts, dtype=np.int64), r.quality) for r in some.orderBy("doc_id").collect()]
    unstage(made)
    return out


def repeat_words(ids: np.ndarray) -> int:
    """Words that lie in a 5-word window found twice or more in the same text."""
    n = len(ids) - 4
    if n < 2:
        return 0
    key = np.zeros(n, dtype=np.uint64)
    for j in range(5):
        key = mix(key * GOLDEN + ids[j : j + n])
    _, back, counts = np.unique(key, return_inverse=True, return_counts=True)
    starts = np.flatnonzero(counts[back] > 1)
    if not len(starts):
        return 0
    cover = np.zeros(len(ids) + 1, dtype=np.int64)
    np.add.at(cover, starts, 1)
    np.add.at(cover, starts + 5, -1)
    return int((np.cumsum(cover)[:-1] > 0).sum())


COLUMNS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_share double, n_lines long, n_content long"
ARROW = [(n, {"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}[t]) for n, t in (c.split() for c in COLUMNS.split(", "))]


def measure(text: str, weights: np.ndarray, trans: np.ndarray, share: float) -> tuple:
    words = word_hashes(text)
    n = len(words)
    blank = sum(map(text.count, " \t\n\x0b\x0c\r"))
    feats, counts, dup = text_lines(text)
    repeated = repeat_words(words)
    failed = n < MIN_WORDS or 100 * repeated > 20 * n
    labels = viterbi(feats @ weights, trans)
    content = float(counts[labels == 1].sum()) / n if n else 0.0
    return n, len(text) - blank, sum(map(text.count, SYMBOLS)), dup, repeated, failed, not failed and content >= share, content, len(counts), int(labels.sum())


def quality_rules(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], share: float = KEEP_SHARE) -> DataFrame:
    """doc_id and, for each row, the base measures, the verdict and the content share."""
    weights, trans = model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [measure(t.as_py(), weights, trans, share) for t in batch.column(1)]
            columns = [pa.array([r[k] for r in rows], type=t) for k, (_, t) in enumerate(ARROW)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", *[n for n, _ in ARROW]])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, f"doc_id long, {COLUMNS}")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(training_rows(docs, table(spark, sf_dir, "labels")))
    return quality_rules(docs, model)
