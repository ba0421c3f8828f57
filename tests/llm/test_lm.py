"""The language model against plain loops, numeric slopes and held-out gain."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from loamcast.llm import lm
from loamcast.llm.common import Scratch

TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens_of(text):
    return [t.encode() for t in TOKEN.findall((text or "").translate(LOWER))] + [b""]


def prose(seed, n, words=600):
    """Words of falling frequency, with digits, letters beyond ASCII and odd spaces."""
    rng = random.Random(seed)
    pick = lambda: int(words * rng.random() ** 3)
    return "".join(f"W{(k := pick())}{'é' * (k % 3)}{rng.choice('., ')}{rng.choice([' ', chr(10), chr(9), '  ', chr(0x0B)])}" for _ in range(n))


def table_of(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return df.select(F.lit(1).alias("n"), F.lit("t").alias("token"), F.lit(0).alias("row"), "*", F.lit(1.5).alias("score"), F.lit(0).alias("class"))


ROWS = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (None, "w1 nobody knows w2"), (5, prose(5, 40)), (5, prose(5, 40)), (6, "ÀÉ à b c W1"), (7, prose(7, 3000, 3000)), (8, "\x1c\x1d w3 \x85 w4")]


def brute(rows, training, model=None, head=None):
    """(tokens, known, base, score) of each row, a token at a time; only the
    words of the head have units of their own."""
    counts = Counter(t for _, text in training for t in tokens_of(text))
    total, distinct = sum(counts.values()), len(counts)
    tails = {}
    for w, n in counts.items():
        if w and w not in head:
            c = lm.word_class(w)
            tails[c] = (tails.get(c, (0, 0))[0] + n, tails.get(c, (0, 0))[1] + 1)
    units = {w: k for k, w in enumerate(head)}

    def log_share(w):
        if w in units:
            return 0.0
        n, words = tails.get(lm.word_class(w), (1, 2))
        return math.log10((counts[w] - 0.5) / n if counts[w] else 0.5 * words / n)

    out = []
    for i, text in rows:
        tokens = tokens_of(text)
        base = sum(math.log10((counts[t] + 0.5) / (total + 0.5 * (distinct + 1))) for t in tokens)
        ids, score = [units.get(t, len(head) + lm.word_class(t)) for t in tokens], 0.0
        for k, u in enumerate(ids):
            before = [ids[k - 1 - j] if k - 1 - j >= 0 else 0 for j in range(lm.CONTEXT)]
            made = sum(model.context[b].astype(float) * p for b, p in zip(before, model.places))
            scores = model.target.astype(float) @ made + model.bias + model.frequency
            score += (scores[u] - math.log(sum(math.exp(s) for s in scores))) / math.log(10) + log_share(tokens[k])
        out.append((i, len(tokens), sum(t in counts for t in tokens), total, base, score))
    return out


def random_model(units, seed=1, size=0.5):
    rng = np.random.default_rng(seed)
    draw = lambda *shape: rng.normal(0, size, shape).astype(np.float32)
    return lm.Model(draw(units, lm.DIM), draw(units, lm.DIM), draw(lm.CONTEXT, lm.DIM), draw(units), draw(units) - 5)


def alike(found, want):
    key = lambda r: (r[0] is None, r[0], r[1], r[4])
    found, want = sorted(map(tuple, found), key=key), sorted(want, key=key)
    assert [r[:4] for r in found] == [r[:4] for r in want]
    for a, b in zip(found, want):
        assert a[4] == pytest.approx(b[4], rel=1e-9, abs=1e-9) and a[5] == pytest.approx(b[5], rel=1e-5, abs=1e-4)


@pytest.mark.parametrize("known", [1 << 18, 300, 1])
def test_scores_are_brute_force(spark, monkeypatch, known):
    """Whether workers hold all counts, a part of them, or only the ends'."""
    training = [r for r in ROWS if r[0] not in (4, None, 7)] + [(20 + k, prose(k, 300)) for k in range(5)]
    docs = table_of(spark, ROWS)
    monkeypatch.setattr(lm, "KNOWN", known)
    counts = lm.counted(table_of(spark, training)).cache()
    words = lm.vocabulary(counts)
    assert len(words.words) <= known and (words.total, words.distinct) == counts.agg(F.sum("n"), F.count("*")).first()
    model = random_model(len(words.head) + lm.CLASSES)
    monkeypatch.setattr(lm, "train", lambda *a: model)
    scope = Scratch()
    alike(lm.scored(docs, table_of(spark, training), scope).collect(), brute(ROWS, training, model, words.head))
    scope.drop(spark)


def test_probabilities_add_to_one(spark):
    words = lm.vocabulary(lm.counted(table_of(spark, [(k, prose(k, 400, 2000)) for k in range(4)])))
    model = random_model(len(words.head) + lm.CLASSES)
    contexts = np.array([[3, 9, 300], [0, 0, 0]])
    for context in contexts:
        units = 10 ** model.log10(np.tile(context, (len(model.bias), 1)), np.arange(len(model.bias)))
        assert units.sum() == pytest.approx(1, abs=1e-5)
    words.ready()
    shares = np.zeros(lm.CLASSES)
    for w, u, s in zip(words.words, words.unit, words.share):
        if u >= len(words.head):
            shares[u - len(words.head)] += 10**s
    assert np.allclose(shares + 10 ** words.novel[0], 1)


def test_large_scores_stay_normal():
    model = random_model(50, size=0.5)
    model.target *= 400
    found = model.log10(np.zeros((50, lm.CONTEXT), int), np.arange(50))
    assert np.isfinite(found).all() and (10**found).sum() == pytest.approx(1, abs=1e-4)


def test_slopes_are_numeric():
    rng = np.random.default_rng(2)
    model = random_model(12)
    as64 = lm.Model(*[a.astype(float) for a in model.learned], model.frequency)
    trainer = lm.Trainer(model, [np.zeros_like(a) for a in model.learned], 0)
    contexts, units, noise = rng.integers(0, 12, (30, lm.CONTEXT)), rng.integers(0, 12, 30), rng.integers(0, 12, 7)

    def loss():
        out = 0.0
        for context, unit in zip(contexts, units):
            made = sum(as64.context[c] * p for c, p in zip(context, as64.places))
            odds = lambda u: made @ as64.target[u] + as64.bias[u] - math.log(7)
            out += math.log1p(math.exp(-odds(unit))) + sum(math.log1p(math.exp(odds(u))) for u in noise)
        return out

    for value, slope in zip(as64.learned, trainer.slopes(contexts, units, noise)):
        for spot in [tuple(rng.integers(0, n) for n in value.shape) for _ in range(8)]:
            old = value[spot]
            value[spot] = old + 1e-5
            up = loss()
            value[spot] = old - 1e-5
            down = loss()
            value[spot] = old
            assert slope[spot] == pytest.approx((up - down) / 2e-5, rel=1e-3, abs=1e-3)


def test_slices_change_nothing(monkeypatch):
    text = prose(3, 900).encode() + b"x" * 500 + b"  end"
    counts = Counter(tokens_of(text.decode()))
    known = sorted(counts)
    words = lm.Vocabulary(sum(counts.values()), len(counts), known, np.array([float(counts[w]) for w in known]), known[:100], np.full(lm.CLASSES, 999.0), np.ones(lm.CLASSES), 0)
    whole = np.concatenate([r[lm.CONTEXT :] for r in lm.Encoder(words).runs(text)])
    monkeypatch.setattr(lm, "SLICE", 64)
    runs = list(lm.Encoder(words).runs(text))
    assert len(runs) > 50 and np.array_equal(np.concatenate([r[lm.CONTEXT :] for r in runs]), whole) and len(whole) == sum(counts.values())
    contexts, units, _ = lm.contexts_of(runs)
    flat = np.concatenate([np.zeros(lm.CONTEXT, int), whole])
    assert np.array_equal(units, whole) and all(np.array_equal(contexts[:, j], flat[lm.CONTEXT - 1 - j : -1 - j]) for j in range(lm.CONTEXT))


def test_learning_beats_frequencies_on_texts_held_out(spark):
    """Words follow each other in three kinds of text; which one, only the context tells."""
    rng = random.Random(6)

    def text(kind):
        out, k = [], rng.randrange(20)
        for _ in range(150):
            k = (k + rng.choice([1, 1, 2])) % 20
            out.append(f"k{kind}w{k}" if rng.random() < 0.95 else f"new{rng.randrange(10**9)}")
        return " ".join(out)

    rows = [(i, text(i % 3)) for i in range(700)]
    training = spark.createDataFrame(rows, "doc_id long, text string").where("doc_id % 5 != 1").repartition(2)
    found = lm.scored(spark.createDataFrame(rows, "doc_id long, text string"), training).where("doc_id % 5 = 1").collect()
    gain = sum(r["score"] - r["base_score"] for r in found) / sum(r["n_tokens"] for r in found)
    assert len(found) == 140 and gain > 0.4 and all(r["score"] < 0 for r in found)


def test_language_model_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert lm.scored(empty, empty).columns == ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    assert lm.scored(empty, empty).collect() == []
    row = lm.scored(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), empty).first()
    assert (row["n_tokens"], row["n_known"], row["train_tokens"], row["base_score"]) == (3, 0, 0, 0.0) and row["score"] < 0


def test_classes_ignore_digits():
    assert lm.word_class(b"x12") == lm.word_class(b"x98") == zlib.crc32(b"x00") % lm.CLASSES
