"""Benchmark decontamination by suffix arrays over shards of documents."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession

from . import words
from .common import table, text_blocks

WINDOW = 13
SHARD = 4 << 20  # bytes of text that one suffix array covers, if no text is longer
BLOCK = 32 << 20  # bytes of benchmark text in one broadcast


class Suffixes:
    """Suffix array over word numbers, in order of the first `depth` words.

    Sequences of the shard are joined with a word 0 between them, that no
    query has, so a match never runs from one document into the next.
    """

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, depth: int) -> None:
        self.vocabulary, numbers = np.unique(hashes, return_inverse=True)
        self.owner = np.repeat(np.arange(len(counts)), counts)
        places = np.arange(len(hashes)) + self.owner
        self.text = np.zeros(len(hashes) + len(counts) + depth, np.int64)
        self.text[places] = numbers + 1
        self.base = np.cumsum(counts + 1) - counts - 1  # of each document in text
        bits = int(len(self.vocabulary) + 1).bit_length()
        per = min(depth, max(1, 63 // bits))
        key = np.zeros(len(self.text), np.uint64)
        for k in range(per):
            key = key << np.uint64(bits)
            key[: len(key) - k] |= self.text[k:].astype(np.uint64)
        first = key[places]
        order = np.argsort(first)
        array, first = places[order], first[order]
        fresh = np.append(True, first[1:] != first[:-1]) if len(first) else np.zeros(0, bool)
        done = per
        while done < depth:
            tied = ~fresh
            tied[:-1] |= ~fresh[1:]
            at = np.flatnonzero(tied)
            if not len(at):
                break
            group = np.cumsum(fresh)[at]
            start = np.minimum(array[at] + done, len(key) - 1)
            _, later = np.unique(key[start], return_inverse=True)
            both = group.astype(np.int64) << 32 | later
            inner = np.argsort(both)
            array[at] = array[at][inner]
            both = both[inner]
            fresh[at] = np.append(True, both[1:] != both[:-1])
            done += per
        self.array = array

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Word numbers of a query; 0 to -1 for words the shard has not."""
        if not len(self.vocabulary):
            return np.full(len(hashes), -1, np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at + 1, -1)

    def _bound(self, lo: np.ndarray, hi: np.ndarray, word: np.ndarray, depth: int, right: bool) -> np.ndarray:
        lo, hi = lo.copy(), hi.copy()
        while len(at := np.flatnonzero(lo < hi)):
            mid = (lo[at] + hi[at]) // 2
            found = self.text[self.array[mid] + depth]
            go = found <= word[at] if right else found < word[at]
            lo[at] = np.where(go, mid + 1, lo[at])
            hi[at] = np.where(go, hi[at], mid)
        return lo

    def search(self, query: np.ndarray, starts: np.ndarray, need: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(reached, lo, hi) for the suffixes of `query` at `starts`: their
        longest match here, up to `need` words, and the range of the array
        that holds it."""
        lo, hi = np.zeros(len(starts), np.int64), np.full(len(starts), len(self.array), np.int64)
        reached = np.zeros(len(starts), np.int64)
        alive = np.arange(len(starts))
        depth = 0
        while len(alive := alive[need[alive] > depth]):
            word = query[starts[alive] + depth]
            a = self._bound(lo[alive], hi[alive], word, depth, False)
            b = self._bound(a, hi[alive], word, depth, True)
            fits = (a < b) & (word > 0)
            alive = alive[fits]
            lo[alive], hi[alive] = a[fits], b[fits]
            depth += 1
            reached[alive] = depth
        return reached, lo, hi


def windows(ids: list[str], texts: list[bytes], window: int) -> tuple:
    """Query side: word hashes, starts of full-length suffixes, the length of
    each (fewer words only for an item shorter than a window), and its item."""
    hashes, _, _, counts = words.split(texts)
    base = np.cumsum(counts) - counts
    slots = np.where(counts > 0, np.maximum(counts - window + 1, 1), 0)
    item = np.repeat(np.arange(len(counts)), slots)
    inner = np.arange(len(item)) - np.repeat(np.cumsum(slots) - slots, slots)
    return hashes, base[item] + inner, np.minimum(window, counts[item]), item, inner


def matches(shard: Suffixes, query: tuple, ids: list[str]) -> tuple:
    """Maximal verbatim matches: (document, item, document word, item word,
    words), from the located suffixes joined along their diagonals."""
    hashes, starts, need, item, inner = query
    numbers = shard.numbers(hashes)
    reached, lo, hi = shard.search(numbers, starts, need)
    full = np.flatnonzero(reached == need)
    n = hi[full] - lo[full]
    which = np.repeat(full, n)
    place = shard.array[np.repeat(lo[full], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
    doc = np.searchsorted(shard.base, place, side="right") - 1
    at = place - shard.base[doc]
    order = np.lexsort((at, at - inner[which], item[which], doc))
    doc, at, which = doc[order], at[order], which[order]
    diagonal = at - inner[which]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (item[which][1:] != item[which][:-1]) | (diagonal[1:] != diagonal[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(doc))[: len(first)] - 1
    return doc[first], item[which[first]], at[first], inner[which[first]], at[last] + need[which[last]] - at[first]


def judge(texts: list[bytes], blocks: list, window: int) -> list[dict]:
    """One result for each text; blocks: lists of (item id, item text)."""
    hashes, _, _, counts = words.split(texts)
    shard = Suffixes(hashes, counts, window)
    offsets = np.cumsum(counts) - counts
    delta = np.zeros(len(hashes) + 1, np.int64)
    items: list[set] = [set() for _ in texts]
    found: list[list] = [[] for _ in texts]
    for block in blocks:
        ids, bodies = block.value if isinstance(block, Broadcast) else block
        doc, item, at, inner, n = matches(shard, windows(ids, bodies, window), ids)
        np.add.at(delta, offsets[doc] + at, 1)
        np.add.at(delta, offsets[doc] + at + n, -1)
        for d, i, a, b, k in zip(doc.tolist(), item.tolist(), at.tolist(), inner.tolist(), n.tolist()):
            items[d].add(ids[i])
            found[d].append({"item_id": ids[i], "start": a, "item_start": b, "words": k})
        if len(blocks) > 1 and isinstance(block, Broadcast):
            del block._value  # one block in memory at a time; the file stays
    hit = np.append(0, np.cumsum(np.cumsum(delta[:-1]) > 0))
    n_hit = hit[offsets + counts] - hit[offsets]
    return [
        {
            "n_words": int(n), "n_hit": int(h), "n_items": len(s), "items_sha256": hashlib.sha256(",".join(sorted(s)).encode()).hexdigest(),
            "contaminated": bool(h > 0 and 20 * h >= n), "longest_match": max((m["words"] for m in f), default=0), "matches": f,
        }
        for n, h, s, f in zip(counts, n_hit, items, found)
    ]


def broadcast_items(benchmark: DataFrame) -> list[Broadcast]:
    """(item_id, text) in blocks of about BLOCK bytes, each one broadcast."""
    from pyspark.sql import functions as F

    spark = benchmark.sparkSession
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text").where("text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // BLOCK)
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(max(1, blocks)))
    out = []
    for k in range(blocks):
        rows = (items.where(part == k) if blocks > 1 else items).collect()
        out.append(spark.sparkContext.broadcast(([r[0] for r in rows], [r[1].encode("utf-8", "surrogatepass") for r in rows])))
    return out


MATCH = "array<struct<item_id:string,start:long,item_start:long,words:long>>"
RESULT = f"doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, longest_match long, matches {MATCH}"


def _bodies(batch: pa.RecordBatch) -> list[bytes]:
    return [x or b"" for x in batch.column("text").cast(pa.binary()).to_pylist()]


def contamination(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Verbatim overlap of each document with the benchmark items.

    documents (doc_id, text), benchmark (item_id, text). Returns one row per
    document row: the columns of RESULT; matches holds the maximal verbatim
    matches of at least a window (a whole item, if it is shorter), with word
    offsets on both sides. contaminated: a hit, and hits are at least a
    twentieth of the words.

    Null and empty texts have no words; null items are left out; a null
    item_id counts as the empty string, and repeated item_ids as one item;
    repeated documents are judged each; further columns are ignored; an empty
    benchmark leaves all documents clean.

    Each task builds suffix arrays over shards of its documents and searches
    every window-long item suffix in them by bisection. Nothing is shuffled;
    the benchmark is sent in blocks of bounded size.
    """
    blocks = broadcast_items(benchmark)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("item_id", pa.string()), ("start", pa.int64()), ("item_start", pa.int64()), ("words", pa.int64())]))
        kinds = {"n_words": pa.int64(), "n_hit": pa.int64(), "n_items": pa.int64(), "items_sha256": pa.string(), "contaminated": pa.bool_(), "longest_match": pa.int64(), "matches": kind}
        for batch in text_blocks(batches, "text", SHARD):
            rows = judge(_bodies(batch), blocks, window)
            yield pa.record_batch([batch.column("doc_id"), *(pa.array([r[k] for r in rows], t) for k, t in kinds.items())], names=["doc_id", *kinds])

    return documents.select("doc_id", "text").mapInArrow(scan, RESULT)


def decontaminated(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of `documents`, with all their columns, that aren't
    contaminated; see contamination()."""
    blocks = broadcast_items(benchmark)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_blocks(batches, "text", SHARD):
            clean = [not r["contaminated"] for r in judge(_bodies(batch), blocks, window)]
            yield batch.filter(pa.array(clean, pa.bool_()))

    return documents.mapInArrow(keep, documents.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))
    return found.drop("matches", "longest_match")


ORACLE = r"""
WITH words AS (SELECT 'd' AS kind, doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
  UNION ALL SELECT 'b', item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
items AS (SELECT id AS item, least(13, len(w)) AS k, unnest(list_transform(range(1, greatest(len(w) - 12, 1) + 1), lambda i: array_to_string(w[i : i + least(13, len(w)) - 1], ' '))) AS key FROM words WHERE kind = 'b' AND len(w) > 0),
places AS (SELECT id, k, unnest(range(1, len(w) - k + 2)) AS i, w FROM words, (SELECT DISTINCT k FROM items) WHERE kind = 'd' AND len(w) >= k),
hits AS (SELECT p.id, p.i, p.k, item FROM (SELECT id, i, k, array_to_string(w[i : i + k - 1], ' ') AS key FROM places) p JOIN items ON p.key = items.key AND p.k = items.k),
covered AS (SELECT id, count(DISTINCT n) AS n_hit FROM (SELECT id, unnest(range(i, i + k)) AS n FROM hits) GROUP BY id),
found AS (SELECT id, count(DISTINCT item) AS n_items, array_to_string(list_sort(list(DISTINCT CAST(item AS VARCHAR))), ',') AS ids FROM hits GROUP BY id)
SELECT d.id AS doc_id, len(d.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(d.w), false) AS contaminated
FROM words d LEFT JOIN covered c ON c.id = d.id LEFT JOIN found f ON f.id = d.id WHERE d.kind = 'd'
"""
