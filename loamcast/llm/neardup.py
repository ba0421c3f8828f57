"""Near-duplicate documents by improved consistent weighted sampling.

A document is a weighted set of five-word shingles: how often one occurs,
times the mean smoothed inverse document frequency of its words. Samples of it
are banded; documents that share a band are compared by their exact weighted
Jaccard similarity; documents linked at 0.8 or more form classes.

The frequencies are those of words, not of shingles. Copies raise the count of
every shingle that they share, so shingle frequencies would weigh down just
what near copies have in common, and large groups would fall below the bar.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words
from .common import Scratch, sized, table, text_blocks, unused, written
from .links import SIMILAR, components, frequent, link, shared, spread

SIZE = 5  # words of a shingle
COARSE = (10, 3)  # bands, rows: finds 0.999 of pairs at 0.8
COUNTERS, PARTS, MOST = 1 << 22, 64, 65535  # of the table of edit frequencies, which orders edits, of its pieces, and where they end
APART = (1 - SIMILAR) / (1 + SIMILAR)  # of both weights together: what similar texts may differ by
SKETCH, ALIKE = 64, 38  # samples kept of a text that shares a band; so many agree in all but 1 of 10 000 pairs at 0.8
BUCKETS = 1 << 16  # of the table of word frequencies
SMOOTH = 10  # added to each logarithm, so that rare words don't outweigh the rest of a text
BLOCK = 4 << 20
SEED = 2


@functools.cache
def draws() -> tuple[np.ndarray, np.ndarray]:
    """Quantised Gamma(2, 1) draws r, and logarithms of such draws c."""
    rng = np.random.default_rng(SEED)
    return rng.gamma(2, size=BUCKETS), np.log(rng.gamma(2, size=BUCKETS))


def weighted(texts: list[bytes], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, weights, bounds): the shingles of all texts; those of text i are
    keys[bounds[i]:bounds[i + 1]], ascending. A text of fewer words than a
    shingle, but not none, is one shingle."""
    hashes, _, _, counts = words.split(texts)
    offsets = np.cumsum(counts) - counts
    own = np.repeat(np.arange(len(texts)), counts)
    left = np.repeat(offsets + counts, counts) - np.arange(len(hashes))
    sums = np.append(0.0, np.cumsum(idf[(hashes & np.uint64(BUCKETS - 1)).astype(np.int64)]))
    at = np.flatnonzero(left[: max(0, len(hashes) - SIZE + 1)] >= SIZE)
    found, weight, owner = words.shingles(hashes, SIZE)[at], (sums[at + SIZE] - sums[at]) / SIZE, own[at]
    for n in range(1, SIZE):
        short = np.flatnonzero(counts == n)
        if len(short):
            key = hashes[offsets[short]].copy()
            for k in range(1, n):
                key = words.mix(key * words.M1 ^ hashes[offsets[short] + k])
            found, owner = np.append(found, words.mix(key)), np.append(owner, short)
            weight = np.append(weight, (sums[offsets[short] + n] - sums[offsets[short]]) / n)
    keys, first, times = np.unique(owner.astype(np.uint64) << np.uint64(40) | found >> np.uint64(24), return_index=True, return_counts=True)
    bounds = np.searchsorted(keys, np.arange(len(texts) + 1, dtype=np.uint64) << np.uint64(40))
    return keys & np.uint64((1 << 40) - 1), times * weight[first], bounds


def samples(texts: list[bytes], idf: np.ndarray, n: int, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """(full, found): the texts with words, and n samples of each of them."""
    keys, weights, bounds = weighted(texts, idf)
    full = np.flatnonzero(np.diff(bounds))
    result = np.zeros((len(full), n), np.uint64)
    if not len(full):
        return full, result
    starts = bounds[full]
    own = np.repeat(np.arange(len(full)), np.diff(np.append(starts, len(keys))))
    log_w, (gamma, log_c) = np.log(weights), draws()
    mask = np.uint64(BUCKETS - 1)
    for k in range(n):
        seed = np.array([(salt << 32) + k + 1], np.uint64)
        h = words.mix(keys ^ seed * words.M1)
        r = gamma[(h & mask).astype(np.int64)]
        beta = (h >> np.uint64(32) & mask).astype(np.float64) / BUCKETS
        t = np.floor(log_w / r + beta)
        log_a = log_c[(h >> np.uint64(16) & mask).astype(np.int64)] - r * (t - beta + 1)
        hit = np.flatnonzero(log_a == np.minimum.reduceat(log_a, starts)[own])
        hit = hit[np.append(True, own[hit][1:] != own[hit][:-1])]
        result[:, k] = words.mix(keys[hit] ^ t[hit].astype(np.int64).astype(np.uint64) * words.M2)
    return full, result


def bands(texts: list[bytes], idf: np.ndarray, shape: tuple[int, int], salt: int) -> list[list[int]]:
    """Band keys of each text; none for a text without words."""
    full, found = samples(texts, idf, shape[0] * shape[1], salt)
    out: list[list[int]] = [[] for _ in texts]
    key = np.broadcast_to(words.mix(np.arange(shape[0], dtype=np.uint64)), (len(full), shape[0]))
    for row in range(shape[1]):
        key = words.mix(key * words.M1 ^ found[:, row :: shape[1]])
    for i, row in zip(full.tolist(), key.view(np.int64).tolist()):
        out[i] = row
    return out


def sketches(texts: list[bytes], idf: np.ndarray) -> list[bytes]:
    """The low byte of each of SKETCH samples."""
    full, found = samples(texts, idf, SKETCH, 2)
    out = [b""] * len(texts)
    for i, row in zip(full.tolist(), found.astype(np.uint8)):
        out[i] = row.tobytes()
    return out


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two ascending weighted sets."""
    if len(a[0]) > len(b[0]):
        a, b = b, a
    at = np.minimum(np.searchsorted(b[0], a[0]), len(b[0]) - 1)
    both = b[0][at] == a[0]
    common = np.minimum(a[1][both], b[1][at[both]]).sum()
    return float(common / (a[1].sum() + b[1].sum() - common))


Weighted = tuple[np.ndarray, np.ndarray]  # ascending keys and their weights


def differences(text: Weighted, pivot: Weighted, salt: int) -> Weighted:
    """(keys, weights): what a text has more of than the pivot, and what it has
    less of; keys depend on the pivot, by its salt, and on the direction."""
    every = np.union1d(text[0], pivot[0])
    change = np.zeros(len(every))
    change[np.searchsorted(every, text[0])] = text[1]
    change[np.searchsorted(every, pivot[0])] -= pivot[1]
    at = np.flatnonzero(np.abs(change) > 1e-9)
    more = (change[at] > 0).astype(np.uint64)
    return words.mix(every[at] << np.uint64(1) ^ more ^ np.array([salt], np.uint64) * words.M1), np.abs(change[at])


def ordered(keys: np.ndarray, weights: np.ndarray, counts: np.ndarray) -> Weighted:
    """The rarest first, by (count, key)."""
    order = np.lexsort((keys, counts[(keys & np.uint64(COUNTERS - 1)).astype(np.int64)]))
    return keys[order], weights[order]


def repeated(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Which keys more than one text may have; no two texts meet by others,
    so leaving those out loses nothing."""
    return counts[(keys & np.uint64(COUNTERS - 1)).astype(np.int64)] > 1


def prefix(weights: np.ndarray, own: float, pivot: float) -> tuple[int, np.ndarray, float]:
    """(n, short, apart): the first n ordered() differences of a text,
    which of them are short; own and pivot are the weights of the two texts.

    Texts x and y of weights |x| and |y| hold if they differ by at most T =
    APART (|x| + |y|). With differences Dx and Dy from the pivot they differ by
    Dx + Dy - 2c, where c is what the two have in common of these. With apart
    gx = Dx - APART |x| it follows that c is (gx + gy) / 2 at least. So for
    gx <= gy it is gx at least, and, as y doesn't hold with the pivot where gy
    is more than APART |pivot|, else more than (gx + APART |pivot|) / 2. Two
    sets with so much in common share one of the first of each, in an order
    that is the same for all, that weigh more than the rest: of x, the short
    ones, the smaller of APART |x| and (Dx + APART (|x| - |pivot|)) / 2, and of
    y, by Dy - T, no more than |y| / 4. A text that holds with the pivot is y
    only of those that do too, so its short ones are all it needs.
    """
    before = np.cumsum(weights) - weights
    total = float(weights.sum())
    n = int(np.searchsorted(before, own / 4 * (1 + 1e-9), side="right"))
    short = (before[:n] <= APART * own * (1 + 1e-9)) & (before[:n] < (total + APART * (own - pivot)) / 2 * (1 - 1e-9))
    if total - APART * own < APART * pivot * (1 - 1e-9):
        n = int(short.sum())
    return n, short[:n], total - APART * own


def _bytes(column) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(BUCKETS, np.int64)
    for batch in text_blocks(batches, "text", BLOCK):
        hashes, _, _, counts = words.split(_bytes(batch.column("text")))
        own = np.repeat(np.arange(len(counts), dtype=np.int64), counts)
        pairs = np.unique(own * BUCKETS + (hashes & np.uint64(BUCKETS - 1)).astype(np.int64))
        total += np.bincount(pairs % BUCKETS, minlength=BUCKETS)
    seen = np.flatnonzero(total)
    yield pa.record_batch([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], names=["bucket", "n"])


def word_weights(documents: DataFrame) -> np.ndarray:
    """Smoothed inverse document frequency by word bucket, over all texts.
    BUCKETS numbers reach the driver, whatever the corpus."""
    n = documents.select("text").count()
    rows = documents.select("text").mapInArrow(_frequencies, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(BUCKETS)
    counts[rows.column("bucket").to_numpy()] = rows.column("n").to_numpy()
    return np.log((1 + n) / (1 + counts)) + SMOOTH


SIGNED = "doc_id long, node binary, bands array<long>"


def classes(documents: DataFrame, scope: Scratch | None = None) -> DataFrame:
    """(doc_id, text) to (doc_id, node, class_id, class_size), one row a row.

    class_id is the smallest doc_id of the class; node is a digest of the
    text, the same for equal texts. Texts without words (null and empty too)
    are only in the class of texts that equal them; each null text is alone:
    its class_id is its own doc_id. Repeated rows count as copies; null ids
    are ignored in class_id unless a class has no other; further columns are
    ignored; no rows give no rows.

    Equal texts are one node, so copies cost one row each. Nodes are compared
    by links.link(); only texts of nodes that share a bucket are moved.
    """
    scope = scope or Scratch()
    spark = documents.sparkSession
    idf = spark.sparkContext.broadcast(word_weights(documents))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_blocks(batches, "text", BLOCK):
            column = batch.column("text").cast(pa.binary())
            texts = column.to_pylist()
            nodes = [None if t is None else hashlib.md5(t, usedforsecurity=False).digest() for t in texts]
            found = bands([t or b"" for t in texts], idf.value, COARSE, 1)
            yield pa.record_batch([batch.column("doc_id"), pa.array(nodes, pa.binary()), pa.array(found, pa.list_(pa.int64()))], names=["doc_id", "node", "bands"])

    signed = written(documents.select("doc_id", "text").mapInArrow(sign, SIGNED), scope)
    nodes = written(signed.where("node is not null").groupBy("node").agg(F.first("bands").alias("bands"), F.min("doc_id").alias("doc_id"), F.count("*").alias("n")), scope)
    keys = nodes.select("node", F.explode("bands").alias("key"))
    hashed = documents.where("text is not null").select(F.unhex(F.md5(F.col("text").cast("binary"))).alias("node"), "text")
    kept: list[DataFrame] = []  # the texts of nodes that share a bucket, once they are known

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_blocks(batches, "text_b", 2 << 20):
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            bodies = dict(zip(a, _bytes(batch.column("text_a")))) | dict(zip(b, _bytes(batch.column("text_b"))))
            place = {node: i for i, node in enumerate(bodies)}
            sets, weights, bounds = weighted(list(bodies.values()), idf.value)

            def of(node: bytes) -> tuple[np.ndarray, np.ndarray]:
                part = slice(bounds[place[node]], bounds[place[node] + 1])
                return sets[part], weights[part]

            good = [similarity(of(x), of(y)) >= SIMILAR for x, y in zip(a, b)]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_blocks(batches, "text", BLOCK):
            bodies = _bytes(batch.column("text"))
            _, weights, bounds = weighted(bodies, idf.value)
            total = np.append(0.0, np.cumsum(weights))
            yield pa.record_batch([batch.column("node"), pa.array(sketches(bodies, idf.value), pa.binary()), pa.array(total[bounds[1:]] - total[bounds[:-1]])], names=["node", "sketch", "weight"])

    def measures(nodes: DataFrame) -> DataFrame:
        kept.append(written(shared(hashed, written(nodes, scope), ["node"]).groupBy("node").agg(F.any_value("text").alias("text")), scope))
        return kept[0].mapInArrow(sketch, "node binary, sketch binary, weight double")

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, SKETCH) for c in ("sketch_a", "sketch_b"))
            yield batch.select(["a", "b"]).filter(pa.array((a == b).sum(axis=1) >= ALIKE, pa.bool_()))

    def with_texts(rows: DataFrame, sides: dict[str, str]) -> DataFrame:
        """Written rows with the texts of their nodes; many may have the same
        node, a pivot. Only texts that rows need are moved."""
        total, out = rows.count(), rows
        for side, column in sides.items():
            bodies = shared(kept[0].select(F.col("node").alias(side), F.col("text").cast("binary").alias(column)), rows, [side])
            out = spread(out, bodies, [side], frequent(rows.groupBy(side).agg(F.count("*").alias("n")), total, [side]), scope)
        return out

    def verify(pairs: DataFrame) -> DataFrame:
        return with_texts(pairs, {"b": "text_b", "a": "text_a"}).select("a", "b", "text_a", "text_b").mapInArrow(compare, "a binary, b binary")

    def edits(apart: DataFrame) -> DataFrame:
        # Written with their texts, as they are read twice.
        apart = written(with_texts(written(apart, scope), {"node": "text_a", "pivot": "text_b"}), scope)

        def changed(batch: pa.RecordBatch) -> list[tuple]:
            """(keys, weights, weight of the text, weight of the pivot) of each row."""
            nodes, pivots = batch.column("node").to_pylist(), batch.column("pivot").to_pylist()
            bodies = dict(zip(nodes, _bytes(batch.column("text_a")))) | dict(zip(pivots, _bytes(batch.column("text_b"))))
            sets, weights, bounds = weighted(list(bodies.values()), idf.value)
            of = {node: (sets[i:j], weights[i:j]) for node, i, j in zip(bodies, bounds, bounds[1:])}
            return [(*differences(of[x], of[p], int.from_bytes(p[:8], "little")), of[x][1].sum(), of[p][1].sum()) for x, p in zip(nodes, pivots)]

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = np.zeros(COUNTERS, np.int32)
            for batch in text_blocks(batches, "text_a", 1 << 20):
                keys = np.concatenate([keys for keys, *_ in changed(batch)])
                np.add.at(table, (keys & np.uint64(COUNTERS - 1)).astype(np.int64), 1)
            pieces = [(p, *(x.tolist() for x in (np.flatnonzero(t), t[t > 0]))) for p, t in enumerate(table.reshape(PARTS, -1)) if t.any()]
            yield pa.record_batch([pa.array([x[i] for x in pieces], t) for i, t in enumerate((pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int64())))], names=["part", "place", "n"])

        def add(key: tuple, pieces: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = np.zeros(COUNTERS // PARTS, np.int64)
            for batch in pieces:
                np.add.at(table, batch.column("place").flatten().to_numpy(), batch.column("n").flatten().to_numpy())
            yield pa.record_batch([pa.array([key[0].as_py()], pa.int32()), pa.array([np.minimum(table, MOST).astype(np.uint16).tobytes()], pa.binary())], names=["part", "n"])

        # COUNTERS numbers of two bytes reach the driver, whatever the corpus.
        summed = apart.mapInArrow(count, "part int, place array<int>, n array<long>").groupBy("part").applyInArrow(add, "part int, n binary").toArrow()
        table = np.zeros((PARTS, COUNTERS // PARTS), np.uint16)
        for part, n in zip(summed.column("part").to_pylist(), summed.column("n").to_pylist()):
            table[part] = np.frombuffer(n, np.uint16)
        counts = spark.sparkContext.broadcast(table.ravel())

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in text_blocks(batches, "text_a", 1 << 20):
                out: list[list] = [[], [], [], []]
                for i, (keys, change, own, pivot) in enumerate(changed(batch)):
                    keys, change = ordered(keys, change, counts.value)
                    n, short, far = prefix(change, own, pivot)
                    again = np.flatnonzero(repeated(keys[:n], counts.value))
                    for column, part in zip(out, (keys[again], np.full(len(again), i), short[again], np.full(len(again), far))):
                        column.append(part)
                keys, at, short, far = (np.concatenate(c) for c in out)
                rows = batch.select(["node", "component"]).take(pa.array(at))
                yield pa.record_batch([pa.array(keys.view(np.int64)), *rows.columns, pa.array(short), pa.array(far)], names=["key", "node", "component", "short", "apart"])

        return apart.mapInArrow(cut, "key long, node binary, component binary, short boolean, apart double")

    links = link(keys, measures, alike, verify, edits, scope)
    labels = components(links.select(F.col("a").alias("u"), F.col("b").alias("v")), scope)
    named = nodes.join(labels, "node", "left").select("node", "doc_id", "n", F.coalesce("component", "node").alias("component"))
    whole = named.groupBy("component").agg(F.min("doc_id").alias("class_id"), F.sum("n").alias("class_size"))
    per_node = named.join(whole, "component").select("node", "class_id", "class_size")
    found = signed.select("doc_id", "node").join(per_node, "node", "left")
    alone = F.col("node").isNull()
    return found.select("doc_id", "node", F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.when(alone, F.lit(1)).otherwise(F.col("class_size")).alias("class_size"))


def deduplicated(documents: DataFrame, scope: Scratch | None = None) -> DataFrame:
    """`documents` with one row of each class, all columns kept: the smallest
    doc_id, and of rows with one id and text any one. Rows with a null text
    all stay, as nothing can be said of them; so do classes without an id.
    Columns may have any names."""
    scope = scope or Scratch()
    found = written(classes(documents, scope), scope)
    doc, node, own = (unused(documents, n) for n in ("__doc", "__node", "__own"))
    same = (F.col("doc_id").eqNullSafe(F.col(doc))) & (F.col(own) == F.col(node))
    copies = found.where("class_id is not null and (doc_id is null or doc_id != class_id)").select(F.col("doc_id").alias(doc), F.col("node").alias(node)).distinct()
    marked = documents.withColumn(own, F.unhex(F.md5(F.col("text").cast("binary"))))
    kept = marked.join(sized(copies), same, "left_anti")
    again = found.where("node is not null").groupBy(F.col("doc_id").alias(doc), F.col("node").alias(node)).agg(F.count("*").alias("n")).where("n > 1").drop("n")
    if not again.isEmpty():
        either = kept.join(sized(again), same, "left").drop(doc)
        once = either.where(F.col(node).isNotNull()).dropDuplicates(["doc_id", own])
        kept = either.where(F.col(node).isNull()).unionByName(once).drop(node)
    return kept.drop(own)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents", "doc_id", "text")).select("doc_id", "class_id", "class_size")
