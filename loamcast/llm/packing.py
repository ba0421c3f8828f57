"""Packing: first-fit decreasing over a tournament tree of bin capacities.

Documents are tokenised once; pieces go to randomised groups of a bounded
number of pieces, and each group is packed on its own.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, arrow_map, table, text_blocks, written

LENGTH = 2048
END = 1  # the id that closes a document
GROUP = 8192  # pieces that one group holds, about
SPECIAL = "<|endoftext|>"

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


@functools.cache
def encoder(name: str):
    """text -> ids, as the `tokenizers` file `name` gives them.

    The same vocabulary as ranks is several times faster. The two regular
    expression engines could differ on letters of rare scripts, so that path
    takes only texts up to U+024F without the special token's string; every
    other text goes through `tokenizers` itself.
    """
    import base64

    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path(name))
    with open(public_tokenizers.path(name.replace(".json", ".tiktoken")), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> list[int]:
        if SPECIAL in text or not text.isascii() and max(text) > "ɏ":
            return whole.encode(text, add_special_tokens=False).ids
        return fast.encode_ordinary(text)

    return encode


def cut(name: str, length: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import numpy as np

    encode = encoder(name)
    for batch in text_blocks(batches, "text", 4 << 20):
        rows: list[tuple] = []
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
            ids = encode(text) if text else []
            ids.append(END)
            data = np.array(ids, "<u4")
            for start in range(0, len(ids), length):
                part = data[start : start + length]
                rows.append((doc, start, len(part), zlib.crc32(part.tobytes()), len(ids)))
        yield pa.record_batch([pa.array(x, pa.int64()) for x in zip(*rows)], names=[x.split()[0] for x in PIECES.split(", ")])


def first_fit(lengths: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """First-fit decreasing: (bin, offset) of each piece, in input order.

    Leaves of the tree are bins with their free room, inner nodes the larger
    of their children; the first bin with room is found from the root by
    going left wherever the left child still has room.
    """
    n = len(lengths)
    leaves = 1 << max(0, (n - 1).bit_length())
    tree = [capacity] * (2 * leaves)
    bins, offsets = [0] * n, [0] * n
    for i in sorted(range(n), key=lambda i: -lengths[i]):
        need, node = lengths[i], 1
        while node < leaves:
            node *= 2
            if tree[node] < need:
                node += 1
        bins[i], offsets[i] = node - leaves, capacity - tree[node]
        tree[node] -= need
        node //= 2
        while node:
            larger = max(tree[2 * node], tree[2 * node + 1])
            if tree[node] == larger:
                break
            tree[node] = larger
            node //= 2
    return bins, offsets


PACKED = PIECES + ", sequence_id long, offset long"


def _pack(length: int, group: pa.Table) -> pa.Table:
    order = group.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending")])
    bins, offsets = first_fit(order.column("length").to_pylist(), length)
    base = order.column("pack_group")[0].as_py() << 32
    kept = order.drop_columns(["pack_group"])
    return kept.append_column("sequence_id", pa.array([base + b for b in bins], pa.int64())).append_column("offset", pa.array(offsets, pa.int64()))


def pack(documents: DataFrame, tokenizer: str = "byte_bpe_50k.json", length: int = LENGTH, group: int = GROUP, scope: Scratch | None = None) -> DataFrame:
    """(doc_id, text) to placed pieces of at most `length` tokens.

    Returns per piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset. A document of more tokens is cut at multiples of
    `length`; full pieces fill a sequence each, the rest is packed. A null or
    empty text is the closing id alone; repeated rows are packed each; null
    ids stay null; further columns are ignored; no rows give no rows.

    Only lengths and checksums are shuffled, never ids. The pieces are written
    to the shared folder first, so the random groups are stable when a task is
    run again; a group holds about `group` pieces, whatever the input.
    """
    pieces = written(arrow_map(documents.select("doc_id", "text"), functools.partial(cut, tokenizer, length), PIECES), scope)
    groups = max(1, -(-pieces.count() // group))
    dealt = pieces.withColumn("pack_group", F.floor(F.rand(7) * groups).cast("long"))

    def place(rows: pa.Table) -> pa.Table:
        return _pack(length, rows)

    return dealt.groupBy("pack_group").applyInArrow(place, PACKED)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents", "doc_id", "text"))
