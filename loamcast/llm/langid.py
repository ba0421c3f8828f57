"""Language identification by hyperdimensional profiles.

Each letter has a random vector of signs. A trigram binds its letters: each
vector is rotated by its place, and the three are multiplied. A text bundles,
that is adds, the vectors of its trigrams; so does a language, over its
training texts. A text goes to the language with the closest direction.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, table, text_blocks

DIM = 1024
SEED = 20
SYMBOLS = 256
SAMPLE = 20_000  # training texts, about; a documented bound
SLICE = 1 << 18  # characters of a text that are taken at once
ROWS = 512  # texts or slices that are bundled at once
CACHED = 1 << 15  # trigram vectors that a worker keeps
UNKNOWN = "und"
LEAST = 0.1  # cosine below which a text is in no learned language; unrelated profiles have about 0.03
EDGE = "\uffff"  # where a slice is cut; no character


@functools.cache
def symbol_table() -> np.ndarray:
    """Code point to symbol; 0 for all but letters. Letters below U+0180 have
    a symbol each; all others share the rest by hash."""
    low = [c for c in range(0x180) if chr(c).isalpha() and chr(c) == chr(c).lower()]
    letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    codes = np.arange(0x110000, dtype=np.uint64)
    shared = len(low) + 1
    out = np.where(letters, shared + (codes * np.uint64(2654435761) >> np.uint64(7)) % np.uint64(SYMBOLS - shared), 0).astype(np.uint32)
    out[low] = np.arange(1, shared)
    return out


@functools.cache
def letter_vectors() -> np.ndarray:
    return np.random.default_rng(SEED).choice(np.array([-1, 1], np.int8), (SYMBOLS, DIM))


class Bundler:
    """Texts to bundled vectors; keeps the vectors of trigrams seen so far."""

    def __init__(self) -> None:
        self.row = np.full(1 << 24, -1, np.int32)
        self.vectors = np.zeros((CACHED, DIM), np.int8)
        self.used = 0

    def _rows(self, grams: np.ndarray) -> np.ndarray:
        new = grams[self.row[grams] < 0]
        if self.used + len(new) > CACHED:
            self.row.fill(-1)
            self.used, new = 0, grams
            if len(grams) > len(self.vectors):
                self.vectors = np.zeros((len(grams), DIM), np.int8)
        if len(new):
            of, spot = letter_vectors(), slice(self.used, self.used + len(new))
            self.vectors[spot] = np.roll(of[new >> 16], 2, axis=1) * np.roll(of[new >> 8 & 255], 1, axis=1) * of[new & 255]
            self.row[new] = np.arange(self.used, self.used + len(new))
            self.used += len(new)
        return self.vectors[self.row[grams]]

    def _bundle(self, parts: list[str], owners: list[int], out: np.ndarray, letters: np.ndarray) -> None:
        lowered = [p.lower() for p in parts]
        codes = np.frombuffer("  ".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
        symbols = symbol_table()[codes]
        lengths = np.fromiter(map(len, lowered), np.int64, len(parts)) + 2
        owner = np.repeat(np.arange(len(parts)), lengths)[: len(symbols)]
        grams = symbols[:-2] << 16 | symbols[1:-1] << 8 | symbols[2:]
        cut = codes == ord(EDGE)
        inner = np.flatnonzero((symbols[1:-1] > 0) & ~(cut[:-2] | cut[2:]))  # a trigram's middle is a letter
        grams, owner = grams[inner], owner[inner + 1]
        if not len(grams):
            return
        known, at = np.unique(grams, return_inverse=True)
        counts = np.bincount(owner * len(known) + at, minlength=len(parts) * len(known)).reshape(len(parts), -1).astype(np.float32)
        np.add.at(out, owners, counts @ self._rows(known).astype(np.float32))
        np.add.at(letters, owners, counts.sum(axis=1))

    def bundle(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(vectors, letters): of each text; texts of any length."""
        out, letters = np.zeros((len(texts), DIM), np.float32), np.zeros(len(texts))
        parts: list[str] = []
        owners: list[int] = []
        size = 0
        for k, text in enumerate(texts):
            for start in range(0, max(1, len(text)), SLICE):
                part = text[max(0, start - 2) : start + SLICE]
                parts.append(f"{EDGE if start else ' '}{part}{EDGE if start + SLICE < len(text) else ''}")
                owners.append(k)
                size += len(part)
                if len(parts) >= ROWS or size >= 8 * SLICE:
                    self._bundle([*parts, ""], [*owners, k], out, letters)
                    parts, owners, size = [], [], 0
        if parts:
            self._bundle([*parts, ""], [*owners, owners[-1]], out, letters)
        return out, letters


@functools.cache
def bundler() -> Bundler:
    return Bundler()


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[str, np.ndarray] = {}
    for batch in text_blocks(batches, "text", 1 << 20):
        vectors, _ = bundler().bundle([x or "" for x in batch.column("text").to_pylist()])
        vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1)
        for lang, vector in zip(batch.column("lang").to_pylist(), vectors):
            totals[lang] = totals.get(lang, 0) + vector.astype(np.float64)
    rows = [(lang, k, float(x)) for lang, total in totals.items() for k, x in enumerate(total)]
    if rows:
        yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows), (pa.string(), pa.int32(), pa.float64()))], names=["lang", "place", "value"])


def train(documents: DataFrame, sample: int = SAMPLE) -> dict[str, np.ndarray]:
    """Unit prototypes of the languages of `documents` (doc_id, text, lang).

    About `sample` rows are taken by a hash of their id, whatever the size of
    the input; rows with a null text or lang are left out. Every text counts
    alike. Workers add up vectors; only sums of DIM numbers a language come
    to the driver.
    """
    usable = documents.where("lang is not null and text is not null").select("doc_id", "text", "lang")
    share = min(1.0, sample / max(1, usable.select("doc_id").count()))
    chosen = usable.where(F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(1 << 30)) < int(share * (1 << 30)) + 1)
    sums = chosen.mapInArrow(_sums, "lang string, place int, value double").groupBy("lang", "place").agg(F.sum("value").alias("value")).collect()
    out: dict[str, np.ndarray] = {}
    for row in sums:
        out.setdefault(row["lang"], np.zeros(DIM))[row["place"]] = row["value"]
    return {lang: out[lang] / max(np.linalg.norm(out[lang]), 1e-12) for lang in sorted(out)}


def predict(texts: list[str | None], prototypes: dict[str, np.ndarray]) -> tuple[list[str], list[float]]:
    """(language, cosine cut to 0..1) of each text; UNKNOWN without letters."""
    if not prototypes:
        return [UNKNOWN] * len(texts), [0.0] * len(texts)
    names = list(prototypes)
    vectors, letters = bundler().bundle([x or "" for x in texts])
    cosines = vectors @ np.array([prototypes[x] for x in names], np.float32).T / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
    best = cosines.argmax(axis=1)
    scores = np.clip(cosines[np.arange(len(texts)), best], 0, 1)
    return [names[b] if n else UNKNOWN for b, n in zip(best, letters)], [float(s) if n else 0.0 for s, n in zip(scores, letters)]


def identify(documents: DataFrame, prototypes: dict[str, np.ndarray]) -> DataFrame:
    """(doc_id, text) to (doc_id, lang_pred, score), one row per input row.

    Null texts and texts without a letter are UNKNOWN with score 0, and so is
    all without prototypes. Texts are read whole, in slices, so a long one
    takes no more memory. Repeated rows and null ids are kept; further
    columns are ignored. The prototypes are a few kilobytes a language.
    """

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_blocks(batches, "text", 2 << 20):
            langs, scores = predict(batch.column("text").to_pylist(), prototypes)
            yield pa.record_batch([batch.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return documents.select("doc_id", "text").mapInArrow(score, "doc_id long, lang_pred string, score double")


def identified(documents: DataFrame, prototypes: dict[str, np.ndarray], least: float = LEAST) -> DataFrame:
    """The rows of `documents` in a learned language, all columns kept, with
    any names: those of a cosine of `least` or more. Null and empty texts,
    texts without a letter and those close to no prototype go, and so does all
    without prototypes. Repeated rows and null ids are kept."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_blocks(batches, "text", 2 << 20):
            langs, scores = predict(batch.column("text").to_pylist(), prototypes)
            yield batch.filter(pa.array([x != UNKNOWN and s >= least for x, s in zip(langs, scores)], pa.bool_()))

    return documents.mapInArrow(keep, documents.schema)


def training_rows(documents: DataFrame) -> DataFrame:
    return documents.where(~held_out(F.col("doc_id"), 4, 2))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    found = identify(documents, train(training_rows(documents)))
    return found.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "lang_pred", "score")
