"""Language-model scores by a log-bilinear model trained on the whole corpus.

The vocabulary is all tokens of the training texts, counted exactly. The model
predicts a unit: the end of a text, one of the HEAD most frequent words, or one
of CLASSES classes of other words by their last bytes. A context's vector is
the sum of its words' vectors, each weighed by its place; a unit's score is
the product of that with the unit's vector, plus a bias, over the unit's own
frequency. It is learned by noise-contrastive estimation: each partition walks
over its texts in numpy, and partitions' parameters are averaged in a tree.

The probability of a token is that of its unit, normalised over all units by a
matrix product, times its share of its class. Shares are counts less DISCOUNT;
what all words of a class lose is the share of words not seen in training. So
the probabilities of all words seen, and of "unseen" in each class, add to one.
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, held_out, table, text_blocks, written
from .vectors import combined

HEAD, CLASSES = 256, 96  # units of single words and of classes
CONTEXT, DIM = 3, 24
DISCOUNT = 0.5
KNOWN = 1 << 18  # tokens whose counts every worker holds; those of all others are joined
BUCKETS = 16  # steps of a frequency's doubling in which KNOWN is found
HELD = 1 << 18  # tokens that a worker counts before it passes them on
ROUNDS = 3  # a text is in one round; after each, parameters are averaged
STEP, NOISE, RATE = 2048, 32, 0.15  # tokens and noise samples of a training step; Adagrad's rate
TOKENS = 1 << 15  # tokens that are scored at once
CELLS = 1 << 19  # numbers of a block of the matrix product
SLICE = 1 << 20  # bytes of a text that are split at once
END = b""  # the closing token; no word is empty
SPACE = re.compile(rb"[\x20\x09-\x0D]")
DIGITS = bytes(48 if 48 <= b <= 57 else b for b in range(256))


def word_lists(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, a bounded slice at a time; the end isn't among them."""
    start = 0
    while start < len(text):
        found = SPACE.search(text, start + SLICE)
        stop = found.start() if found else len(text)
        yield text[start:stop].lower().split()
        start = stop


def word_class(word: bytes) -> int:
    """The class of a word beyond the head: by its last three bytes, digits alike."""
    return zlib.crc32(word[-3:].translate(DIGITS)) % CLASSES


def texts_of(batch: pa.RecordBatch) -> list[bytes]:
    return [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]


def counted(documents: DataFrame) -> DataFrame:
    """(token binary, class int, n long): all tokens of (text), an end for
    each row; a null text is an empty one. Counts are added up in workers
    first, in bounded memory; the empty token is the end, of class -1."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def passed() -> pa.RecordBatch:
            words = list(seen)
            columns = [pa.array(words, pa.binary()), pa.array([word_class(w) if w else -1 for w in words], pa.int32()), pa.array(seen.values(), pa.int64())]
            seen.clear()
            return pa.record_batch(columns, names=["token", "class", "n"])

        for batch in text_blocks(batches, "text", 1 << 20):
            for text in texts_of(batch):
                for words in word_lists(text):
                    seen.update(words)
                    if len(seen) > HELD:
                        yield passed()
                seen[END] += 1
        yield passed()

    parts = documents.select("text").mapInArrow(count, "token binary, class int, n long")
    return parts.groupBy("token").agg(F.first("class").alias("class"), F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    """What workers hold of the counts: all tokens together, the tokens of the
    highest counts (fewer than KNOWN), and sums over each class's tail."""

    total: int
    distinct: int
    words: list[bytes]
    counts: np.ndarray
    head: list[bytes]
    class_counts: np.ndarray
    class_words: np.ndarray
    bucket: int
    place: dict[bytes, int] = field(default_factory=dict)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("unit", "base", "share")} | {"place": {}}

    def ready(self) -> Vocabulary:
        """With the tables that are made from the rest, once a process."""
        if not self.place:
            self.place = {w: k for k, w in enumerate(self.words)}
            self.base = np.log10((self.counts + 0.5) / self.denominator)
            units = {w: k for k, w in enumerate(self.head)}
            self.unit = np.array([units[w] if w in units else len(self.head) + word_class(w) for w in self.words], np.int32)
            tail = np.maximum(self.unit - len(self.head), 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                self.share = np.where(self.unit < len(self.head), 0.0, np.log10((self.counts - DISCOUNT) / self.class_counts[tail]))
        return self

    @property
    def denominator(self) -> float:
        return self.total + 0.5 * (self.distinct + 1)

    @property
    def novel(self) -> tuple[np.ndarray, np.ndarray]:
        """log10 of what a class keeps for a word that isn't in training: as a
        share of the class, and as a count. A class without words keeps all."""
        kept = np.where(self.class_words > 0, DISCOUNT * self.class_words, 1.0)
        return np.log10(kept / np.where(self.class_words > 0, self.class_counts, 1.0)), np.log10(kept)

    def unigram(self) -> np.ndarray:
        """Smoothed shares of the units."""
        place = self.ready().place
        heads = np.array([self.counts[place[w]] if w in place else 0 for w in self.head], float)
        n = np.concatenate([heads, self.class_counts]) + 0.5
        return n / n.sum()


def _bucket(n):
    return F.floor(F.log2(n) * BUCKETS).cast("int")


def vocabulary(counts: DataFrame) -> Vocabulary:
    """From counted(); tokens of equal frequency are known or not together, so
    that fewer than KNOWN reach the driver, whatever the corpus."""
    buckets = sorted(counts.groupBy(_bucket(F.col("n")).alias("b")).agg(F.count("*").alias("words"), F.sum("n").alias("n")).collect(), reverse=True)
    least, held = 1 << 30, 0
    for b, words, _ in buckets:
        held += words
        if held > KNOWN:
            break
        least = b
    top = counts.where(_bucket(F.col("n")) >= least).select("token", "n").toArrow()
    known = sorted(zip(top.column("n").to_pylist(), top.column("token").to_pylist()), key=lambda x: (-x[0], x[1]))
    ends = counts.where(F.length("token") == 0).select("n").first()
    if ends and END not in (w for _, w in known):
        known.append((ends["n"], END))
    head = [END, *[w for _, w in known if w != END][:HEAD]]
    n, words = np.zeros(CLASSES), np.zeros(CLASSES)
    for c, total, distinct in counts.where(F.length("token") > 0).groupBy("class").agg(F.sum("n"), F.count("*")).collect():
        n[c], words[c] = total, distinct
    inside = set(head)
    for count, word in known:
        if word and word in inside:
            n[word_class(word)] -= count
            words[word_class(word)] -= 1
    return Vocabulary(sum(b[2] for b in buckets), sum(b[1] for b in buckets), [w for _, w in known], np.array([c for c, _ in known], float), head, n, words, least)


@dataclass
class Model:
    """Vectors of context words and of units, weights of places, biases, and
    the units' log frequencies; the first four are learned."""

    context: np.ndarray
    target: np.ndarray
    places: np.ndarray
    bias: np.ndarray
    frequency: np.ndarray

    @classmethod
    def start(cls, unigram: np.ndarray) -> Model:
        rng = np.random.default_rng(13)
        n = len(unigram)
        small = lambda: rng.normal(0, 0.1, (n, DIM)).astype(np.float32)
        return cls(small(), small(), np.ones((CONTEXT, DIM), np.float32), np.zeros(n, np.float32), np.log(unigram).astype(np.float32))

    @property
    def learned(self) -> list[np.ndarray]:
        return [self.context, self.target, self.places, self.bias]

    def log10(self, contexts: np.ndarray, units: np.ndarray) -> np.ndarray:
        """log10 probability of each unit behind its context (a row of units,
        the nearest first); a block of the softmax at a time."""
        weighed = [self.context * p for p in self.places]
        right = np.ascontiguousarray(np.hstack([self.target, (self.bias + self.frequency)[:, None]]).T)
        ones, reach = np.ones(right.shape[1], np.float32), np.sqrt((right[:-1] ** 2).sum(axis=0).max())
        most = 80 - np.abs(right[-1]).max()
        out, step = np.empty(len(units)), max(1, CELLS // right.shape[1])
        lefts, products = np.ones((step, DIM + 1), np.float32), np.empty((step, right.shape[1]), np.float32)
        for start in range(0, len(units), step):
            block, chosen_units = contexts[start : start + step], units[start : start + step]
            left, scores = lefts[: len(block)], products[: len(block)]
            left[:, :DIM] = weighed[0][block[:, 0]]
            for j in range(1, CONTEXT):
                left[:, :DIM] += weighed[j][block[:, j]]
            np.matmul(left, right, out=scores)
            chosen = scores[np.arange(len(block)), chosen_units].astype(float)
            # Within reach exp() neither overflows nor vanishes, so no row needs its maximum.
            if np.sqrt(np.einsum("ij,ij->i", left[:, :DIM], left[:, :DIM]).max(initial=0)) * reach > most:
                high = scores.max(axis=1, keepdims=True)
                scores -= high
                chosen -= high[:, 0]
            np.exp(scores, out=scores)
            out[start : start + step] = (chosen - np.log(scores @ ones)) / np.log(10)
        return out


def _added(ids: np.ndarray, rows: np.ndarray, size: int) -> np.ndarray:
    """The rows of each id added up."""
    order = np.argsort(ids, kind="stable")
    sorted_ids = ids[order]
    starts = np.append(0, np.flatnonzero(sorted_ids[1:] != sorted_ids[:-1]) + 1)
    out = np.zeros((size, *rows.shape[1:]), rows.dtype)
    out[sorted_ids[starts]] = np.add.reduceat(rows[order], starts, axis=0)
    return out


class Trainer:
    """Noise-contrastive steps with Adagrad from a given model."""

    def __init__(self, model: Model, squares: list[np.ndarray], seed: int) -> None:
        self.model = Model(*[a.copy() for a in model.learned], model.frequency)
        self.squares = [s.copy() for s in squares]
        self.rng = np.random.default_rng(seed)
        self.noise = np.cumsum(np.exp(model.frequency.astype(float)))
        self.tokens = 0

    def slopes(self, contexts: np.ndarray, units: np.ndarray, noise: np.ndarray) -> list[np.ndarray]:
        """Slopes of the noise-contrastive loss, in the order of `learned`.

        A unit's odds against noise are its score over its frequency, so
        frequencies cancel; all tokens of a step share one set of noise."""
        m, size = self.model, len(self.model.bias)
        weighed = [m.context * p for p in m.places]
        made = sum(w[contexts[:, j]] for j, w in enumerate(weighed))
        true, false, odds = m.target[units], m.target[noise], np.float32(np.log(len(noise)))
        yes = -1 / (1 + np.exp(np.clip(np.einsum("ij,ij->i", made, true) + m.bias[units] - odds, -30, 30)))
        no = made @ false.T
        no += m.bias[noise] - odds
        np.negative(no, out=no)
        np.exp(np.minimum(no, 30, out=no), out=no)
        no += 1
        np.reciprocal(no, out=no)
        back = yes[:, None] * true + no @ false
        each = [_added(contexts[:, j], back, size) for j in range(CONTEXT)]
        own, noised = _added(units, np.hstack([made * yes[:, None], yes[:, None]]), size), np.hstack([no.T @ made, no.sum(axis=0)[:, None]])
        np.add.at(own, noise, noised)
        return [sum(e * p for e, p in zip(each, m.places)), own[:, :-1], np.stack([(e * m.context).sum(axis=0) for e in each]), own[:, -1]]

    def step(self, contexts: np.ndarray, units: np.ndarray) -> None:
        noise = np.minimum(np.searchsorted(self.noise, self.rng.random(NOISE) * self.noise[-1]), len(self.noise) - 1)
        for value, square, slope in zip(self.model.learned, self.squares, self.slopes(contexts, units, noise)):
            square += slope * slope
            value -= RATE * slope / np.sqrt(square + 1e-6)
        self.tokens += len(units)

    def parts(self) -> list[np.ndarray]:
        return [np.asarray(a, float) * self.tokens for a in [*self.model.learned, *self.squares]]


class Encoder:
    """Texts to units with their contexts, many tokens at a time."""

    def __init__(self, words: Vocabulary) -> None:
        self.words = words.ready()

    def units(self, tokens: list[bytes], rest: Counter | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(units, places among the known tokens or -1); tokens that aren't
        known are counted in `rest`."""
        places = np.fromiter(map(self.words.place.get, tokens, repeat(-1)), np.int64, len(tokens))
        if not self.words.words:
            units = np.zeros(len(tokens), np.int32)
        else:
            units = self.words.unit[places]
        unknown = np.flatnonzero(places < 0)
        if len(unknown):
            lost = [tokens[k] for k in unknown.tolist()]
            units[unknown] = [len(self.words.head) + word_class(t) for t in lost]
            if rest is not None:
                rest.update(lost)
        return units, places

    def runs(self, text: bytes, each=None, rest: Counter | None = None) -> Iterator[np.ndarray]:
        """A text's units in runs; each starts with CONTEXT units that came
        before it, ends at first, and the last closes with an end."""
        before = np.zeros(CONTEXT, np.int32)
        for tokens in word_lists(text):
            units, places = self.units(tokens, rest)
            if each:
                each(places)
            run = np.concatenate([before, units])
            before = run[-CONTEXT:]
            yield run
        yield np.append(before, np.int32(0))


def contexts_of(runs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(contexts, units, run of each) of all tokens in runs."""
    flat = np.concatenate(runs)
    sizes = np.fromiter(map(len, runs), np.int64, len(runs))
    owner = np.repeat(np.arange(len(runs)), sizes)
    first = np.cumsum(sizes) - sizes
    spots = np.flatnonzero(np.arange(len(flat)) - first[owner] >= CONTEXT)
    return np.stack([flat[spots - 1 - j] for j in range(CONTEXT)], axis=1), flat[spots], owner[spots]


def train(documents: DataFrame, words, unigram: np.ndarray) -> Model:
    """The model of (doc_id, text), learned from every row in one of ROUNDS
    rounds. Partitions' parameters are averaged by their tokens; they have a
    fixed size, whatever the corpus."""
    model = Model.start(unigram)
    squares = [np.full_like(a, 1e-2) for a in model.learned]
    for round_ in range(ROUNDS):
        rows = documents.where(F.pmod(F.xxhash64("doc_id", F.lit("model")), F.lit(ROUNDS)) == round_).select("text")

        def learn(batches: Iterator[pa.RecordBatch], model=model, squares=squares, seed=round_) -> Iterator[pa.RecordBatch]:
            encoder, trainer = Encoder(words.value), Trainer(model, squares, seed)
            runs, size = [], 0
            for batch in text_blocks(batches, "text", 1 << 20):
                for text in texts_of(batch):
                    for run in encoder.runs(text):
                        runs.append(run)
                        size += len(run) - CONTEXT
                        if size >= 16 * STEP:
                            _walk(trainer, runs)
                            runs, size = [], 0
            if runs:
                _walk(trainer, runs)
            if trainer.tokens:
                yield pa.record_batch([pa.array([pickle.dumps((trainer.tokens, trainer.parts()))], pa.binary())], names=["part"])

        def add(a: tuple, b: tuple) -> tuple:
            return (a[0] + b[0], [x + y for x, y in zip(a[1], b[1])] if a[1] and b[1] else a[1] or b[1])

        tokens, sums = combined(rows.mapInArrow(learn, "part binary"), (0, None), add, pickle.loads)
        if tokens:
            means = [(s / tokens).astype(np.float32) for s in sums]
            model, squares = Model(*means[:4], model.frequency), means[4:]
    return model


def _walk(trainer: Trainer, runs: list[np.ndarray]) -> None:
    contexts, units, _ = contexts_of(runs)
    contexts, units = contexts.astype(np.int16), units.astype(np.int16)  # small integers sort fastest
    order = trainer.rng.permutation(len(units))
    for start in range(0, len(units), STEP):
        spots = order[start : start + STEP]
        trainer.step(contexts[spots], units[spots])


SCORED = "row long, doc_id long, n_tokens long, n_known long, base_score double, score double, rest array<struct<token: binary, tf: int, novel: double>>"


class Tally:
    """Scores of the rows of a batch as if tokens that workers don't hold were
    unseen, and these tokens."""

    def __init__(self, encoder: Encoder, model: Model, rows: int) -> None:
        self.encoder, self.model, self.words = encoder, model, encoder.words
        self.unseen, (self.novel, self.kept) = np.log10(0.5 / self.words.denominator), self.words.novel
        self.tokens, self.known = np.zeros(rows, np.int64), np.zeros(rows, np.int64)
        self.base, self.score = np.zeros(rows), np.zeros(rows)
        self.runs: list[np.ndarray] = []
        self.owners: list[int] = []
        self.size = 0
        self.rest: list[tuple[bytes, int, float]] = []
        self.ends = [0]

    def _places(self, row: int, places: np.ndarray) -> None:
        held = places[places >= 0]
        self.tokens[row] += len(places)
        self.known[row] += len(held)
        self.base[row] += self.words.base[held].sum() + self.unseen * (len(places) - len(held))
        self.score[row] += self.words.share[held].sum()

    def add(self, row: int, text: bytes) -> None:
        rest: Counter = Counter()
        for run in self.encoder.runs(text, lambda places: self._places(row, places), rest):
            self.runs.append(run)
            self.owners.append(row)
            self.size += len(run)
            if self.size >= TOKENS:
                self.settle()
        end = self.words.place.get(END, -1)
        self._places(row, np.array([end]))
        for token, tf in rest.items():
            c = word_class(token)
            self.score[row] += tf * self.novel[c]
            if self.words.total:
                self.rest.append((token, tf, self.kept[c]))
        self.ends.append(len(self.rest))

    def settle(self) -> None:
        if self.runs:
            contexts, units, owner = contexts_of(self.runs)
            np.add.at(self.score, np.array(self.owners)[owner], self.model.log10(contexts, units))
        self.runs, self.owners, self.size = [], [], 0

    def columns(self) -> list[pa.Array]:
        self.settle()
        kinds = pa.binary(), pa.int32(), pa.float64()
        parts = [pa.array(list(x), t) for x, t in zip(zip(*self.rest) if self.rest else ([], [], []), kinds)]
        rest = pa.ListArray.from_arrays(pa.array(self.ends, pa.int32()), pa.StructArray.from_arrays(parts, ["token", "tf", "novel"]))
        return [pa.array(self.tokens), pa.array(self.known), pa.array(self.base), pa.array(self.score), rest]


def _scored(documents: DataFrame, words, model: Model) -> DataFrame:
    """Rows of SCORED, numbered by partition and place in it."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, row = Encoder(words.value), TaskContext.get().partitionId() << 40
        for batch in text_blocks(batches, "text", 1 << 20):
            tally = Tally(encoder, model, batch.num_rows)
            for k, text in enumerate(texts_of(batch)):
                tally.add(k, text)
            numbers = pa.array(np.arange(row, row + batch.num_rows))
            row += batch.num_rows
            yield pa.record_batch([numbers, batch.column("doc_id"), *tally.columns()], names=["row", "doc_id", "n_tokens", "n_known", "base_score", "score", "rest"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(score, SCORED)


def scored(documents: DataFrame, training: DataFrame, scope: Scratch | None = None) -> DataFrame:
    """(doc_id, text) to (doc_id, n_tokens, n_known, train_tokens, base_score,
    score), one row per input row, scored by what `training` (doc_id, text)
    holds.

    A null text is an empty one, whose only token is the end. Texts are read
    whole, in slices with the words before them. Repeated rows and null ids
    are kept, further columns ignored; without documents there are no rows,
    and without training every token is unseen. Workers hold the counts of
    fewer than KNOWN tokens; those of all others are found by a join, which
    brings a document one row for each such token.
    """
    spark = documents.sparkSession
    scope = scope if scope is not None else Scratch()
    counts = written(counted(training), scope)
    words = vocabulary(counts)
    sent = spark.sparkContext.broadcast(words)
    model = train(training, sent, words.unigram())
    first = written(_scored(documents, sent, model), scope)
    few = counts.where(_bucket(F.col("n")) < words.bucket).where(F.length("token") > 0).select("token", "n")
    rest = first.select("row", F.explode("rest").alias("x")).select("row", "x.*").join(few, "token")
    known = F.col("tf") * F.log10((F.col("n") + 0.5) / 0.5)
    share = F.col("tf") * (F.log10(F.col("n") - DISCOUNT) - F.col("novel"))
    found = rest.groupBy("row").agg(F.sum("tf").alias("k"), F.sum(known).alias("b"), F.sum(share).alias("s"))
    both = first.drop("rest").join(found, "row", "left")
    added = lambda a, b: (F.col(a) + F.coalesce(F.col(b), F.lit(0))).alias(a)
    return both.select("doc_id", "n_tokens", added("n_known", "k"), F.lit(words.total).cast("long").alias("train_tokens"), added("base_score", "b"), added("score", "s"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents", "doc_id", "text")
    out = scored(documents, documents.where(~held_out(F.col("doc_id"), 5, 1)))
    return out.select("doc_id", held_out(F.col("doc_id"), 5, 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
