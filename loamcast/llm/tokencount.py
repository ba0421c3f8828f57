"""Token counts by a linear longest-match automaton.

The trie of a vocabulary gets, for each node, a failure link and the number of
pieces that following it completes. One pass over a word then gives the length
of its greedy longest-match segmentation, without building any piece.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import table, text_blocks

START = "▁"  # opens a word in the vocabulary
KEPT = 300_000  # words whose length a worker remembers
LONGEST = 64  # characters of a word that is remembered


class Automaton:
    """pieces: weight of each piece, 1 for a real one; a single character that
    is no piece itself falls back to its UTF-8 bytes and weighs as many."""

    def __init__(self, pieces: list[str]) -> None:
        weights = {c: len(c.encode("utf-8", "surrogatepass")) for p in pieces for c in p} | {p: 1 for p in pieces if p}
        self.next: list[dict[str, int]] = [{}]
        depth_of, above, weight = [0], [(0, "")], [0]
        for piece in weights:
            node = 0
            for c in piece:
                to = self.next[node].get(c)
                if to is None:
                    to = self.next[node][c] = len(self.next)
                    self.next.append({})
                    above.append((node, c))
                    depth_of.append(depth_of[node] + 1)
                    weight.append(0)
                node = to
            weight[node] = weights[piece]
        self.fail, self.popped = [0] * len(self.next), weight
        for v in sorted(range(1, len(self.next)), key=depth_of.__getitem__):
            if weight[v]:
                continue  # a piece: it is popped whole, and matching restarts
            u, c = above[v]
            z, n = self.fail[u], self.popped[u]
            while c not in self.next[z]:
                z, n = self.fail[z], n + self.popped[z]
            self.fail[v], self.popped[v] = self.next[z][c], n

    def length(self, word: str) -> int:
        step, fail, popped = self.next, self.fail, self.popped
        node = n = 0
        for c in word:
            to = step[node].get(c)
            while to is None:
                if not node:
                    n += len(c.encode("utf-8", "surrogatepass"))  # in no piece
                    to = 0
                    break
                n += popped[node]
                node = fail[node]
                to = step[node].get(c)
            node = to
        while node:
            n += popped[node]
            node = fail[node]
        return n


@functools.cache
def load(name: str) -> Automaton:
    """Of a sentencepiece file: its ordinary pieces."""
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name))
    return Automaton([model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))])


class Counts(dict):
    """Remembers lengths of words; forgets all when there are too many."""

    def __init__(self, automaton: Automaton) -> None:
        self.automaton = automaton

    def __missing__(self, word: str) -> int:
        n = self.automaton.length(START + word)
        if len(word) <= LONGEST:
            if len(self) >= KEPT:
                self.clear()
            self[word] = n
        return n


@functools.cache
def counts(name: str) -> Counts:
    return Counts(load(name))


def token_counts(documents: DataFrame, vocabulary: str = "piece_bpe_32k.model") -> DataFrame:
    """(doc_id, text) to (doc_id, n_words, n_tokens), one row per input row.

    Words are what white space separates; each opens with START and is cut
    greedily into the longest pieces of the vocabulary; a character in no
    piece counts its UTF-8 bytes. Null and empty texts have none; repeated
    rows and null ids are kept; further columns are ignored. Nothing is
    shuffled, and memory is bounded by KEPT words and one batch.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length = counts(vocabulary).__getitem__
        for batch in text_blocks(batches, "text", 4 << 20):
            words, tokens = [], []
            for text in batch.column("text").to_pylist():
                found = text.split() if text else []
                words.append(len(found))
                tokens.append(sum(map(length, found)))
            yield pa.record_batch([batch.column("doc_id"), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], names=["doc_id", "n_words", "n_tokens"])

    return documents.select("doc_id", "text").mapInArrow(count, "doc_id long, n_words long, n_tokens long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents", "doc_id", "text"))
