"""MinHash near-dedup with DartMinHash (operator 2).

A text is the multiset of its shingles of five words; similarity is the weighted Jaccard
index of two multisets. DartMinHash throws hashed darts at the plane of weights and ranks.
The plane of an element is parted into dyadic regions: weights [0, 1), [1, 2), [2, 4), ... by
strips of ranks, each region of the area ``AREA``, with a Poisson number of darts that depends
on the hash of element and region alone. An element of weight w has the darts whose weight is
below w, so two texts share those below their lesser weight. Each dart belongs to one of ``K``
coordinates; the dart of least rank of a coordinate is its minimum, and two sets have the
same one with the chance of their weighted Jaccard index. Only regions below a rank of about
K (ln K + 4) / (total weight) are looked at, so the work is the number of different shingles and
of darts, whatever the weights; texts that leave a coordinate empty get a higher bound.

Coordinates are banded (``BANDS`` of ``ROWS``); texts that share a band meet in a bucket.

1. Equal texts are one node; only different texts are compared.
2. Hub rounds: each node is compared with the least node of each of its buckets; as long as
   a bucket holds over 4 ``BLOCK`` nodes that no hub has claimed, it gets another hub from
   among them, ``ROUNDS`` more at most.
3. Buckets that still hold nodes of several components are searched in blocks: the nodes
   outside the component of the bucket's first hub, ``BLOCK`` at a time, against all nodes of
   the bucket, ``WIDE`` at a time (fewer if texts are long: a block has about
   ``BLOCK_BYTES``), so that no task holds a bucket and a large group of near copies
   costs its size times its stragglers. A task compares a node with all others of the
   block at once, takes a pair only in the first band that it shares, skips nodes that it
   has connected already and gives only the links that connect two components; pairs are
   not emitted. A bucket of n nodes that are all unlike each other costs
   n * n / (BLOCK * WIDE) blocks.
4. Every link comes from a comparison of the shingle multisets themselves, as sets of 32-bit
   numbers, which moves a similarity by the share words / 2**32 at most. No pair that
   shares a band is left out on an estimate.

Links of ``THRESHOLD`` or more make classes, their connected components; a class is named
by its least doc_id. A pair of similarity 0.8 shares no band with chance (1 - 0.8**5)**20,
under 0.0004; that is all that can lose a link.

Defined results: words are runs of anything but ASCII white space; a text of one to four
words is one shingle; texts without words are alike only if equal; null counts as empty;
rows of one doc_id with different texts can have different classes; a null doc_id names a
class only if the class has no other; an empty table gives no rows; other columns are kept
by ``keep_one``, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termweave.llm.common import attach, attach_counted, stage, table, text_of, unstage
from termweave.llm.words import mix, word_hashes

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 20, 5
K = BANDS * ROWS
DARTS = K * (np.log(K) + 4)
#: Darts that are expected in a region.
AREA = 1.0
BLOCK, WIDE, BLOCK_BYTES, ROUNDS = 192, 384, 8_000_000, 2
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
BATCH_DARTS = 400_000
#: Up to so many pairs of a node are compared one by one, more all at once.
FEW_PAIRS = 16
BROADCAST_ROWS = 500_000
#: Up to so many links are united by one task, more are contracted in rounds first.
FEW_LINKS = 200_000


def shingles(text: str) -> np.ndarray:
    """Hashes of the shingles of a text, in order."""
    codes = word_hashes(text)
    width = min(SHINGLE, len(codes))
    n = len(codes) - width + 1
    key = np.full(n if width else 0, width, dtype=np.uint64)
    for j in range(width):
        key = mix(key * GOLDEN + codes[j : j + n])
    return key


def weighted(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different shingles and their weights, the numbers of their copies."""
    return np.unique(key, return_counts=True)


def cells_of(text: str) -> np.ndarray:
    """Unit cells of the shingles for exact comparison: one sorted 32-bit number for each
    copy of a shingle, so that the weighted Jaccard index is the plain one of cells."""
    key, n = weighted(shingles(text))
    copy = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    cells = mix(np.repeat(key, n) + copy.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return np.sort((cells >> np.uint64(32)).astype(np.uint32))


def unit(h: np.ndarray) -> np.ndarray:
    """Hashes as numbers of [0, 1)."""
    return (h >> np.uint64(11)).astype(float) * 2.0**-53


POISSON = np.cumsum([math.exp(-AREA) * AREA**k / math.factorial(k) for k in range(24)])


def thrown(key: np.ndarray, weight: np.ndarray, limit: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(place of the element, rank, dart) of the darts below each element's weight and rank
    limit, by levels of weight."""
    level, low = 0, 0.0
    at = np.arange(len(key))
    while len(at):
        width = max(low, 1.0)
        strip = AREA / width
        n = np.ceil(limit[at] / strip).astype(np.int64)
        own = np.repeat(at, n)
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        region = mix(key[own] + np.uint64(level * 0x8CB92BA72F3D8DD7 % (1 << 64)) + (step.astype(np.uint64) + np.uint64(1)) * GOLDEN)
        darts = np.searchsorted(POISSON, unit(region), side="right")
        own, step, region = (np.repeat(x, darts) for x in (own, step, region))
        number = np.arange(darts.sum()) - np.repeat(np.cumsum(darts) - darts, darts)
        dart = mix(region + (number.astype(np.uint64) + np.uint64(1)) * np.uint64(0xA24BAED4963EE407))
        rank = (step + unit(dart)) * strip
        keep = rank <= limit[own]
        if level:
            keep &= low + width * unit(mix(dart ^ np.uint64(0x9FB21C651E98DF25))) < weight[own]
        yield own[keep], rank[keep], dart[keep]
        level, low = level + 1, low + width
        at = at[weight[at] > low]


def dart_minima(texts: list[tuple[np.ndarray, np.ndarray]], bound: float = DARTS) -> np.ndarray:
    """(texts, K) hashes of the darts of least rank; a text is (shingles, weights), of one
    shingle at least."""
    key, weight = (np.concatenate([t[j] for t in texts]) for j in (0, 1))
    owner = np.repeat(np.arange(len(texts)), [len(t[0]) for t in texts])
    limit = (bound / np.array([t[1].sum() for t in texts]))[owner]
    best, ids = np.full(len(texts) * K, np.inf), np.zeros(len(texts) * K, dtype=np.uint64)
    got = list(thrown(key, weight, limit))
    own, rank, dart = (np.concatenate([g[k] for g in got]) for k in range(3))
    at = owner[own] * K + (mix(dart ^ np.uint64(0xA0761D6478BD642F)) % np.uint64(K)).astype(np.int64)
    np.minimum.at(best, at, rank)
    win = rank == best[at]
    ids[at[win]] = dart[win]
    out = ids.reshape(len(texts), K)
    short = np.flatnonzero(np.isinf(best).reshape(len(texts), K).any(axis=1))
    if len(short):
        out[short] = dart_minima([texts[i] for i in short], 4 * bound)
    return out


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard index of two sorted arrays of distinct cells; 0 if their sizes alone keep it
    under the threshold."""
    if min(len(a), len(b)) < THRESHOLD * max(len(a), len(b), 1):
        return 0.0
    every = np.sort(np.concatenate([a, b]), kind="stable")
    both = int((every[1:] == every[:-1]).sum())
    return both / (len(a) + len(b) - both)


def node_of(text: str | Column) -> Column:
    """The identity of a text: 16 bytes of its SHA-256."""
    return F.substring(F.unhex(F.sha2(text_of(text), 256)), 1, 16)


SIGNED = "doc_id long, node binary, bands array<long>"


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, node, bands) of each row; bands are empty if the text has no word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bands: list = [[]] * batch.num_rows
            held: list[tuple[int, tuple[np.ndarray, np.ndarray]]] = []
            size = 0

            def flush() -> None:
                darts = dart_minima([c for _, c in held])
                keys = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64) * GOLDEN, (len(held), 1))
                for r in range(ROWS):
                    keys = mix(keys * GOLDEN + darts[:, r::ROWS])
                for k, (i, _) in enumerate(held):
                    bands[i] = keys[k].view(np.int64)

            for i, text in enumerate(batch.column(2)):
                key = shingles(text.as_py())
                if len(key):
                    held.append((i, weighted(key)))
                    size += len(key) + DARTS
                if size > BATCH_DARTS:
                    flush()
                    held, size = [], 0
            if held:
                flush()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "node", "bands"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), node_of("text").alias("node"), text_of("text").alias("text")).mapInArrow(run, SIGNED)


def check(pairs: DataFrame, cells: DataFrame) -> DataFrame:
    """The pairs (a, b) whose exact similarity is THRESHOLD or more. Many pairs may share
    their ``a`` (a hub), so its cells are attached last, salted."""
    once = stage(pairs.join(cells.select(F.col("node").alias("b"), F.col("cells").alias("cb")), "b"), "near-cells")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (map(lambda s: np.frombuffer(s.as_py(), dtype=np.uint32), batch.column(k)) for k in (2, 3))
            good = [similarity(p, q) >= THRESHOLD for p, q in zip(x, y)]
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    both = attach_counted(once, cells.select(F.col("node").alias("a"), F.col("cells").alias("ca")), "a", "inner").select("a", "b", "ca", "cb")
    out = stage(both.mapInArrow(run, "a binary, b binary"), "near-links")
    unstage(once)
    return out


def runs(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[list[tuple]]:
    """Rows of a sorted partition, run by run of equal leading columns."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if held and held[-1][:n_keys] != row[:n_keys]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def block_links(rows: list[tuple]) -> Iterator[tuple[bytes, bytes]]:
    """Links between different components in one block of (key, p, q, all, node, comp, outside,
    bands, cells) rows: those with ``all`` = 0 against those with ``all`` = 1."""
    key = rows[0][0]
    mine, every = [r for r in rows if not r[3]], [r for r in rows if r[3]]
    if not mine or not every:
        return
    parent: dict[bytes, bytes] = {}

    def find(x: bytes) -> bytes:
        while (up := parent.get(x, x)) != x:
            parent[x] = x = parent.get(up, up)
        return x

    cells = [np.frombuffer(r[8], dtype=np.uint32) for r in every]
    sizes, outside, bands = np.array([len(c) for c in cells]), np.array([r[6] for r in every]), np.array([r[7] for r in every])
    table = np.concatenate(cells)
    order = np.argsort(table, kind="stable")
    table, owner = table[order], np.repeat(np.arange(len(every)), sizes)[order]
    nodes, comps = [r[4] for r in every], [r[5] for r in every]
    names = np.array(nodes, dtype=object)
    for _, _, _, _, node, comp, _, own_bands, own_cells in mine:
        own = np.frombuffer(own_cells, dtype=np.uint32)
        # pairs of fitting sizes, in the first band that they share; of two nodes outside, which
        # meet twice, the smaller one asks
        fit = np.minimum(sizes, len(own)) >= THRESHOLD * np.maximum(sizes, len(own))
        fit &= np.take_along_axis(bands, (bands == np.array(own_bands)).argmax(axis=1)[:, None], 1)[:, 0] == key
        fit &= ~(outside & (names <= node))
        home = find(comp)
        at = [j for j in np.flatnonzero(fit).tolist() if find(comps[j]) != home]
        if not at:
            continue
        if len(at) <= FEW_PAIRS:
            near = np.array([similarity(own, cells[j]) for j in at])
        else:
            left = np.searchsorted(table, own)
            n = np.searchsorted(table, own, side="right") - left
            hits = np.repeat(left - np.cumsum(n) + n, n) + np.arange(n.sum())
            both = np.bincount(owner[hits], minlength=len(every))[at]
            near = both / (sizes[at] + len(own) - both)
        for k in np.argsort(-near, kind="stable").tolist():
            j = at[k]
            if near[k] >= THRESHOLD and find(comps[j]) != find(comp):
                parent[find(comp)] = find(comps[j])
                yield (node, nodes[j]) if node < nodes[j] else (nodes[j], node)


def search_buckets(members: DataFrame, comps: DataFrame, nodes: DataFrame, cells: DataFrame) -> DataFrame:
    """Links (a, b) that connect components within buckets. ``members`` is (key, node, hub),
    ``comps`` (node, comp) of linked nodes."""
    spark = members.sparkSession
    named = stage(members.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node")), "near-named")
    # buckets of one component have nothing to add
    main = F.max(F.when(F.col("node") == F.col("hub"), F.col("comp"))).alias("main")
    open_ = stage(named.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), main).where("low <> high").select("key", "main"), "near-open")
    live = attach_counted(named, open_, "key", "inner").select("key", "node", "comp", (F.col("comp") != F.col("main")).alias("outside"))
    live = stage(live.join(cells.select("node", F.octet_length("cells").cast("long").alias("bytes")), "node"), "near-live")
    away = F.col("outside").cast("int")
    counts = live.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum(away).alias("r"), F.sum("bytes").alias("nb"), F.sum(away * F.col("bytes")).alias("rb"))
    counts = stage(counts.select("key", *[F.greatest(F.ceil(F.col(a) / most), F.ceil(F.col(b) / BLOCK_BYTES)).cast("int").alias(x) for x, a, b, most in (("ps", "r", "rb", BLOCK), ("qs", "n", "nb", WIDE))]), "near-counts")
    unstage(named, open_)
    sized = stage(attach_counted(live, counts, "key", "inner"), "near-sized")
    p, q = F.pmod(F.xxhash64("node", F.lit(7)), "ps").cast("int"), F.pmod(F.xxhash64("node", F.lit(11)), "qs").cast("int")
    mine = sized.where("outside").select("key", p.alias("p"), F.explode(F.sequence(F.lit(0), F.col("qs") - 1)).alias("q"), F.lit(0).alias("all"), "node", "comp", "outside")
    every = sized.select("key", F.explode(F.sequence(F.lit(0), F.col("ps") - 1)).alias("p"), q.alias("q"), F.lit(1).alias("all"), "node", "comp", "outside")
    rows = stage(mine.unionByName(every), "near-rows")
    data = stage(nodes.select("node", "bands").join(cells, "node"), "near-data")
    full = rows.join(data, "node").select("key", "p", "q", "all", "node", "comp", "outside", "bands", "cells")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in runs(batches, 3):
            if found := list(block_links(block)):
                yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in found], pa.binary()) for c in (0, 1)], ["a", "b"])

    # a few blocks for each task
    tasks = min(100_000, max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows.count() // (4 * (BLOCK + WIDE))))
    dealt = full.repartition(tasks, "key", "p", "q").sortWithinPartitions("key", "p", "q")
    out = stage(dealt.mapInArrow(run, "a binary, b binary"), "near-links")
    unstage(live, counts, sized, rows, data)
    return out


def united(edges: DataFrame) -> DataFrame:
    """(u, to) of the nodes of (a, b) edges; ``to`` is the least node of the component. One
    task takes them all, so they are FEW_LINKS at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[bytes, bytes] = {}

        def find(x: bytes) -> bytes:
            while (up := parent.setdefault(x, x)) != x:
                parent[x] = x = parent[up]
            return x

        for batch in batches:
            for a, b in zip(*(c.to_pylist() for c in batch.columns)):
                low, high = sorted((find(a), find(b)))
                parent[high] = low
        nodes = list(parent)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in (nodes, [find(x) for x in nodes])], ["u", "to"])

    return edges.select("a", "b").repartition(1).mapInArrow(run, "u binary, to binary")


def components(links: DataFrame) -> DataFrame:
    """(node, comp) of the nodes of (a, b) links; comp is the least node of a component.

    As long as there are more than FEW_LINKS links, every node points at its least neighbour or
    itself, and links are contracted along the pointers; one task unites the rest. All tables
    are written between steps; the nodes of many links are salted.
    """
    apart = links.where("a <> b")
    if apart.count() <= FEW_LINKS:
        return stage(united(apart).select(F.col("u").alias("node"), F.col("to").alias("comp")), "cc-labels")
    edges = stage(apart.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "cc-edges")
    both = edges.select("a").union(edges.select(F.col("b").alias("a"))).distinct()
    labels = stage(both.select(F.col("a").alias("node"), F.col("a").alias("comp")), "cc-labels")
    while (n := edges.count()) > FEW_LINKS:
        ends = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        point = stage(ends.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("to")), "cc-point")
        jump = stage(attach_counted(point, point.select(F.col("u").alias("to"), F.col("to").alias("next")), "to").select("u", F.col("next").alias("to")), "cc-jump")
        moved = stage(attach_counted(edges, jump.select(F.col("u").alias("a"), F.col("to").alias("x")), "a").select("x", "b"), "cc-moved")
        nxt = attach_counted(moved, jump.select(F.col("u").alias("b"), F.col("to").alias("y")), "b").where("x <> y")
        nxt = stage(nxt.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "cc-edges")
        named = renamed(labels, jump)
        unstage(edges, labels, point, jump, moved)
        edges, labels = nxt, named
    if n:
        last = stage(united(edges), "cc-jump")
        named = renamed(labels, last)
        unstage(labels, last)
        labels = named
    unstage(edges)
    return labels


def renamed(labels: DataFrame, jump: DataFrame) -> DataFrame:
    """(node, comp) with the components moved along (u, to)."""
    moved = attach_counted(labels, jump.select(F.col("u").alias("comp"), "to"), "comp")
    return stage(moved.select("node", F.coalesce("to", "comp").alias("comp")), "cc-labels")


def classes(docs: DataFrame) -> DataFrame:
    """(doc_id, node, comp, class_id) of each row of ``docs``; ``comp`` tells classes apart
    that have no doc_id."""
    signed = stage(signatures(docs), "near-signed")
    nodes = stage(signed.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("least"), F.min("bands").alias("bands")), "near-nodes")
    buckets = nodes.select("node", F.explode("bands").alias("key"))
    shared = stage(buckets.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("hub")).where("n > 1"), "near-buckets")
    total = shared.agg(F.sum("n")).first()[0] or 0
    members = stage(attach(buckets, shared.withColumn("w", F.col("n")), "key", "w", total, "inner"), "near-members")
    links, comps = _link(docs, nodes, members)
    # names of classes: the least doc_id of all copies of all members
    linked = stage(nodes.select("node", "n", "least").join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node")), "near-linked")
    names = stage(linked.groupBy("comp").agg(F.min("least").alias("class_id"), F.count(F.lit(1)).alias("w")), "near-names")
    named = stage(attach(linked, names, "comp", "w", linked.count()).select("node", "n", "comp", "class_id"), "near-classes")
    out = attach(signed.select("doc_id", "node"), named, "node", "n", signed.count())
    unstage(nodes, shared, members, links, comps, linked, names)
    return out


def _link(docs: DataFrame, nodes: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Exact links (a, b), enough to connect the classes, and their components."""
    wide = stage(members.select("node").distinct().join(nodes.select("node", "least"), "node"), "near-wide")
    # the cells of all nodes that a check may need, made once
    cells = stage(shingle_cells(docs, wide), "near-shingles")
    links = check(members.where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct(), cells)
    comps = components(links)
    big = stage(members.where("n > 2").select("key", "node", "hub"), "near-big")
    links, comps = hub_rounds(big, links, comps, cells)
    more = search_buckets(big, comps, nodes, cells)
    if not more.isEmpty():
        every = stage(links.union(more), "near-every")
        unstage(links, comps)
        links, comps = every, components(every)
    unstage(wide, cells, big, more)
    return links, comps


def hub_rounds(big: DataFrame, links: DataFrame, comps: DataFrame, cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """More links and components, by further hubs of buckets of which many nodes belong to
    no hub so far."""
    open_ = big
    for _ in range(ROUNDS):
        comp = stage(open_.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node")), "near-round")
        of_hub = comp.where("node = hub").select("key", F.col("comp").alias("main"))
        left = stage(attach_counted(comp, of_hub, "key", "inner").where("comp <> main").select("key", "node"), "near-left")
        many = left.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("hub")).where(F.col("n") > 4 * BLOCK)
        many = stage(many, "near-many")
        unstage(comp, *([open_] if open_ is not big else []))
        if many.isEmpty():
            unstage(left, many)
            return links, comps
        open_ = stage(attach(left, many, "key", "n", left.count(), "inner"), "near-open")
        found = check(open_.where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct(), cells)
        every = stage(links.union(found), "near-every")
        unstage(links, comps, left, many, found)
        links, comps = every, components(every)
    unstage(open_)
    return links, comps


def shingle_cells(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, cells) of the wanted nodes, from one row of each text."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of("text").alias("text")).withColumn("node", node_of("text"))
    few = wanted.count() <= BROADCAST_ROWS
    keys = wanted.select("node", "least")
    picked = rows.join(F.broadcast(keys) if few else keys, "node").where("doc_id <=> least").select("node", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([cells_of(t.as_py()).tobytes() for t in batch.column(1)], pa.binary())], ["node", "cells"])

    made = picked.mapInArrow(run, "node binary, cells binary")
    # rows repeated as a whole (same doc_id and text) give the same cells
    return made.groupBy("node").agg(F.min("cells").alias("cells"))


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each class: that of least doc_id (then least node)."""
    found = stage(classes(docs).select(F.col("doc_id").alias("__d"), F.col("node").alias("__n"), "comp", "class_id"), "near-found")
    first = found.where("__d <=> class_id").groupBy("comp").agg(F.min("__d").alias("__d"), F.min("__n").alias("__n"), F.count(F.lit(1)).alias("__rows"))
    keep = stage(first.select("__d", "__n", "__rows"), "near-keep")
    rows = docs.withColumns({"__d2": F.col("doc_id").cast("long"), "__n2": node_of("text")})
    kept = rows.join(keep, F.col("__d2").eqNullSafe(F.col("__d")) & (F.col("__n2") == F.col("__n")))
    single = kept.where("__rows = 1").select(*docs.columns)
    # copies that share doc_id and text: one of them
    several = kept.where("__rows > 1").groupBy("__d2", "__n2").agg(F.first(F.struct(*docs.columns)).alias("r")).select("r.*")
    return single.unionByName(several)


OP2_SQL = r"""
WITH RECURSIVE d AS (SELECT CAST(doc_id AS BIGINT) AS doc_id, coalesce(text, '') AS t FROM documents),
n AS (SELECT t, row_number() OVER (ORDER BY t) AS node, min(doc_id) AS least FROM d GROUP BY t),
w AS (SELECT node, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM n),
s AS (SELECT node, unnest(list_transform(range(1, greatest(len(w) - 3, least(len(w), 1) + 1)), lambda i: array_to_string(w[i:i + 4], ' '))) AS g FROM w),
c AS (SELECT node, g, row_number() OVER (PARTITION BY node, g) AS k FROM s),
z AS (SELECT node, count(*) AS n FROM c GROUP BY node),
p AS (SELECT a.node AS x, b.node AS y, count(*) AS m FROM c a JOIN c b ON a.g = b.g AND a.k = b.k AND a.node < b.node GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN z u ON u.node = x JOIN z v ON v.node = y WHERE 5 * m >= 4 * (u.n + v.n - m)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(node, other) AS (SELECT node, node FROM n UNION SELECT r.node, e.y FROM r JOIN e ON e.x = r.other),
k AS (SELECT r.node, min(n.least) AS class_id FROM r JOIN n ON n.node = r.other GROUP BY r.node)
SELECT d.doc_id, k.class_id FROM d JOIN n USING (t) JOIN k ON k.node = n.node
"""


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return classes(docs).select("doc_id", "class_id")
