"""Substring dedup by MinHash banding of overlapping paragraphs.

Shared passages start and end anywhere, often inside a line, so lines alone
can't show them. Every PARAGRAPH words of a text are a paragraph here, and
neighbours overlap. A paragraph's MinHash is the least of its five-word
shingles; its band key is that shingle together with the REACH words on the
side where the paragraph has room. Neighbours mostly share their minimum, so
only about one key in six words is kept. Words that agree PARAGRAPH times in a
row hold an equal paragraph, hence an equal key. A passage of PASSAGE words
with one word changed, inserted or deleted has so many on one side of it, and
two apart inside would leave fewer shingles than SIMILAR asks; so one band
finds every repeat, edited or not.

Colliding paragraphs are joined with the first of their bucket. Around them
the words of both texts, not the texts, are laid side by side, with words
missing on either side: PASSAGE words whose shingles agree in at least SIMILAR
(exact Jaccard) make a repeated passage. Where some of a bucket don't agree
with the first, others may still agree with each other. Those that share more
words than with the first leave it at the same place with the same word; those
that share an edited passage, whose sides may both stand in earlier texts,
meet again within NEAR words of where they leave it. So they are grouped by
that word and by the shingles from there on, compared with the first of the
new group, and so on; after STEPS steps by the word alone. Members of a group
then share at least one word more with each other than with the first, and
PASSAGE words in common end it, so there are fewer than twice PASSAGE rounds;
all but a few are empty in practice. Other places of the first's document are
members too, but only texts of different ids make a repeat. Linked paragraphs
form clusters; all of a cluster but its first occurrence is to be removed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import words
from .common import Scratch, sized, table, text_blocks, unused, written
from .links import components, frequent, spread

PASSAGE = 51  # words: repeats of more than 50 go
PARAGRAPH, SIZE, REACH = 25, 5, 10  # PASSAGE words have a whole paragraph on one side of a changed one
LENGTH = SIZE + REACH  # words of a band key
SIMILAR = 0.8
DRIFT = 3  # words: three inserted or deleted ones leave fewer shared shingles in PASSAGE words than SIMILAR asks
NEAR, STEPS = 4, 1  # places behind a departure at which texts may meet again, and steps in which they are asked for it
GRAIN = 64  # words: ends of the stretches that are compared are rounded to it
BLOCK = 4 << 20

PARA = "doc long, th long, pos int, last int"


def least_of(values: np.ndarray, size: int) -> np.ndarray:
    """The least of every `size` values that follow each other."""
    have = 1
    while have < size:
        step = min(have, size - have)
        values = np.minimum(values[:-step], values[step:])
        have += step
    return values


def paragraphs(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """First words of the band keys of all paragraphs, ascending."""
    grams = words.shingles(hashes, SIZE)
    room = PARAGRAPH - SIZE + 1
    if len(grams) < room:
        return np.zeros(0, np.int64)
    low = np.uint64((1 << 28) - 1)
    least = least_of(grams & ~low | np.arange(len(grams), dtype=np.uint64), room)
    begin = np.arange(len(least))
    ends = np.repeat(np.cumsum(counts), counts)
    inside = begin + PARAGRAPH <= ends[: len(least)]
    at = (least & low).astype(np.int64)
    return np.unique(np.where(at - begin <= REACH, at, at - REACH)[inside])


def chains(hashes: np.ndarray, counts: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, last): equal paragraphs of one text that overlap, as in words
    repeated over and over, are one paragraph that reaches to the last."""
    if not len(at):
        return at, at
    own = np.repeat(np.arange(len(counts)), counts)[at]
    exact = words.shingles(hashes, LENGTH)[at]
    order = np.lexsort((at, exact, own))
    a, e, o = at[order], exact[order], own[order]
    head = np.append(True, (o[1:] != o[:-1]) | (e[1:] != e[:-1]) | (a[1:] - a[:-1] >= LENGTH))
    first = np.flatnonzero(head)
    last = np.append(first[1:], len(a)) - 1
    back = np.argsort(a[first])
    return a[first][back], a[last][back]


def _bodies(column) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_blocks(batches, "text", BLOCK):
        hashes, _, _, counts = words.split(_bodies(batch.column("text")))
        at, last = chains(hashes, counts, paragraphs(hashes, counts))
        keys = (words.shingles(hashes, LENGTH)[at] if len(at) else np.zeros(0, np.uint64)).view(np.int64)
        own = np.repeat(np.arange(len(counts)), counts)[at]
        base = (np.cumsum(counts) - counts)[own]
        yield pa.record_batch(
            [batch.column("doc").take(pa.array(own)), batch.column("th").take(pa.array(own)), pa.array(at - base, pa.int32()), pa.array(last - base, pa.int32()), pa.array(keys, pa.int64())],
            names=["doc", "th", "pos", "last", "key"],
        )


def aligned(a: np.ndarray, b: np.ndarray, lag: int, drift: int = DRIFT) -> np.ndarray:
    """For each shingle of b, where the same one stands in a, at most `drift`
    words from where the lag puts it, the nearest first; else -1."""
    out = np.full(max(0, len(b) - SIZE + 1), -1)
    lo, hi = max(0, -lag), min(len(b), len(a) - lag)
    if hi - lo >= SIZE:
        equal = np.append(0, np.cumsum(a[lo + lag : hi + lag] == b[lo:hi]))
        at = lo + np.flatnonzero(equal[SIZE:] - equal[:-SIZE] == SIZE)
        out[at] = at + lag
    if drift:
        ga, gb = (words.shingles(x.astype(np.uint64), SIZE) for x in (a, b))
        for d in sorted(range(-drift, drift + 1), key=abs)[1:]:
            lo, hi = max(0, -lag - d), min(len(gb), len(ga) - lag - d)
            if lo < hi:
                at = lo + np.flatnonzero((gb[lo:hi] == ga[lo + lag + d : hi + lag + d]) & (out[lo:hi] < 0))
                out[at] = at + lag + d
    return out


def _meets(a: bytes, b: bytes, lag: int, place: int, way: int) -> bool:
    """Whether the texts, which part at word `place` of b, meet again within
    NEAR words that way, moved by up to DRIFT words."""
    for o in range(NEAR):
        first = place + o if way > 0 else place - o - SIZE + 1
        gram = b[4 * max(first, 0) : 4 * (first + SIZE)]
        if len(gram) == 4 * SIZE and a.find(gram, 4 * max(0, first + lag - DRIFT), 4 * max(0, first + lag + DRIFT + SIZE)) >= 0:
            return True
    return False


def _key(gram: bytes, side: int) -> int:
    """A shingle and a side as a signed 64-bit key."""
    return (xxhash.xxh64_intdigest(gram) >> 2 << 1) | side


def runs(a: np.ndarray, b: np.ndarray, lag: int, drift: int = DRIFT) -> list[tuple[int, int]]:
    """Stretches (first word in b, words) made of passages of PASSAGE words of
    b whose shingles, and those of a between the same ends, have a Jaccard
    similarity of SIMILAR or more; words may be changed, inserted or deleted.
    Both ends of a passage agree, and words next to it that agree belong to it."""
    n = PASSAGE - SIZE + 1
    at = aligned(a, b, lag, drift)
    if len(at) < n:
        return []
    shared = np.append(0, np.cumsum(at >= 0))
    m = shared[n:] - shared[:-n]
    first, last = at[: len(m)], at[n - 1 :]
    across = last - first + 1
    good = np.flatnonzero((first >= 0) & (last >= 0) & (across > 0) & (m >= SIMILAR * (n + across - m) - 1e-9))
    if not len(good):
        return []
    breaks = np.flatnonzero(np.diff(good) > n)
    starts, ends = np.append(good[0], good[breaks + 1]), np.append(good[breaks], good[-1]) + n
    gaps = np.concatenate([[-1], np.flatnonzero(at < 0), [len(at)]])
    starts, ends = gaps[np.searchsorted(gaps, starts) - 1] + 1, gaps[np.searchsorted(gaps, ends)]
    return [(int(s), int(e - s + SIZE - 1)) for s, e in dict.fromkeys(zip(starts, ends))]


SEEN = "a_doc long, a_th long, a_lo int, a_hi int, a_pos int, b_doc long, b_th long, b_lo int, b_hi int, b_pos int, b_last int, good boolean, head boolean, start int, n int, left long, right long, near array<long>"
A, B = ["a_doc", "a_th", "a_lo", "a_hi"], ["b_doc", "b_th", "b_lo", "b_hi"]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Aligned stretches of two texts: one row a paragraph. It is good where it
    lies in a repeated span of the second text, whose start and words stand in
    the row of the first such paragraph, its head. left and right: how many
    words on that side agree before the second text goes on otherwise, with
    which word; null where it ends first, or a whole passage agrees. near: the
    NEAR shingles from each of these places on, away from the paragraph."""
    names = [x.split()[0] for x in SEEN.split(", ")]
    for batch in text_blocks(batches, "words_b", 2 << 20):
        out = []
        columns = [batch.column(k).to_pylist() for k in (*A, *B, "shift", "at", "words_a", "words_b")]
        for a_doc, a_th, a_lo, a_hi, b_doc, b_th, b_lo, b_hi, shift, at, words_a, words_b in zip(*columns):
            a, b = np.frombuffer(words_a, "<u4"), np.frombuffer(words_b, "<u4")
            base, lag = b_lo * GRAIN, shift + (b_lo - a_lo) * GRAIN
            lo, hi = max(0, -lag), min(len(b), len(a) - lag)
            apart = lo + np.flatnonzero(a[lo + lag : hi + lag] != b[lo:hi])
            found = []
            for b_pos, b_last in sorted((x["b_pos"], x["b_last"]) for x in at):
                p, end = b_pos - base, b_pos - base + LENGTH
                i = int(np.searchsorted(apart, p))
                left = int(apart[i - 1]) if i else (lo - 1 if lo else None)
                right = int(apart[i]) if i < len(apart) else (hi if hi < len(b) else None)
                found.append((b_pos, b_last, p, end, None if left is None or p - left > PASSAGE else left, None if right is None or right - end >= PASSAGE else right))
            # One edit is all that PASSAGE words may hold, so texts that drift meet again next to where they part.
            drift = any(left is not None and _meets(words_a, words_b, lag, left, -1) or right is not None and _meets(words_a, words_b, lag, right, 1) for *_, left, right in found) if a_doc != b_doc else False
            spans = [[s, n, True] for s, n in runs(a, b, lag, DRIFT if drift else 0)] if a_doc != b_doc else []
            starts = np.array([s[0] for s in spans])
            for b_pos, b_last, p, end, left, right in found:
                k = int(np.searchsorted(starts, p, side="right")) - 1
                span = spans[k] if k >= 0 and end <= spans[k][0] + spans[k][1] else None
                near = [] if left is None else [_key(words_b[4 * k : 4 * (k + SIZE)], 0) for k in range(max(0, left - SIZE - NEAR + 2), left - SIZE + 2)]
                near += [] if right is None else [_key(words_b[4 * k : 4 * (k + SIZE)], 1) for k in range(right, min(right + NEAR, len(b) - SIZE + 1))]
                left = None if left is None else (2 * (p - left) << 32) | int(b[left])
                right = None if right is None else (2 * (right - end) + 1 << 32) | int(b[right])
                size = 0 if span is None else max(span[1], b_last + LENGTH - base - span[0] if b_last > b_pos else 0)
                out.append((a_doc, a_th, a_lo, a_hi, b_pos + shift, b_doc, b_th, b_lo, b_hi, b_pos, b_last, span is not None, bool(span and (span[2] or size > span[1])), span[0] + base if span else 0, size, left, right, near))
                if span:
                    span[2] = False
        kinds = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64())}
        yield pa.record_batch([pa.array([r[i] for r in out], kinds[x.split()[1]]) for i, x in enumerate(SEEN.split(", "))], names=names)


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The asked stretches of texts, as 32-bit word hashes."""
    for batch in text_blocks(batches, "text", BLOCK):
        hashes, _, _, counts = words.split(_bodies(batch.column("text")))
        short = (hashes >> words.S32).astype("<u4")
        out, at = [], 0
        for doc, th, asked, n in zip(batch.column("doc").to_pylist(), batch.column("th").to_pylist(), batch.column("asked").to_pylist(), counts.tolist()):
            out += [(doc, th, x["lo"], x["hi"], short[at + x["lo"] * GRAIN : at + min(n, x["hi"] * GRAIN)].tobytes()) for x in asked]
            at += n
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
        yield pa.record_batch([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=["doc", "th", "lo", "hi", "words"])


REPEATS = "doc_id long, th long, start long, n_words long, cluster string, first_doc long"


def _place(side: str) -> Column:
    return F.struct(F.col(f"{side}_doc").alias("doc"), F.col(f"{side}_th").alias("th"), F.col(f"{side}_pos").alias("pos"))


def repeats(documents: DataFrame, scope: Scratch | None = None) -> DataFrame:
    """Repeated passages of `documents` (doc_id, text) that are to go.

    One row per passage: doc_id, th (digest of the text), start and n_words
    (in words), cluster (the first paragraph of its component, as id, digest,
    word), first_doc (where it stands first: the smallest id). Overlapping
    passages of a text are merged. The first occurrence itself has no row.

    Only repeats across different doc_ids count; rows with a null id or text,
    and texts of fewer than PASSAGE words, have none; repeated rows of one id
    and text are one document; further columns are ignored; no rows give no
    rows. Texts are read whole.

    Three things are shuffled: the keys, the texts once, to cut the stretches
    that are compared, and these stretches. Joins by keys that hold a large
    share of the rows are spread().
    """
    scope = scope or Scratch()
    texts = documents.where("doc_id is not null and text is not null").select(F.col("doc_id").alias("doc"), F.xxhash64("text").alias("th"), "text")
    keyed = written(texts.mapInArrow(_cut, PARA + ", key long"), scope)
    first = keyed.groupBy("key").agg(F.min(F.struct("doc", "th", "pos")).alias("a"), F.max("doc").alias("last"), F.count("*").alias("n")).where("a.doc != last").select("key", "a", "n")
    first = written(first, scope)
    star = spread(keyed.withColumnRenamed("last", "b_last"), first, ["key"], frequent(first, keyed.count(), ["key"]), scope, "merge")
    star = star.where("struct(doc, th, pos) != a").select(F.col("a.doc").alias("a_doc"), F.col("a.th").alias("a_th"), F.col("doc").alias("b_doc"), F.col("th").alias("b_th"), (F.col("a.pos") - F.col("pos")).alias("shift"), F.col("pos").alias("b_pos"), "b_last")
    # Paragraphs of two texts that lie over each other alike are one row; at most those of a text.
    pairs = star.groupBy("a_doc", "a_th", "b_doc", "b_th", "shift").agg(F.collect_set(F.struct("b_pos", "b_last")).alias("at"), F.min("b_pos").alias("lo"), F.max("b_last").alias("hi"))
    low = lambda pos: F.greatest(F.floor((pos - PASSAGE) / GRAIN), F.lit(0)).cast("int")
    high = lambda pos: F.ceil((pos + LENGTH + PASSAGE) / GRAIN).cast("int")
    lo, hi = F.col("lo"), F.col("hi")
    pairs = pairs.withColumns({"a_lo": low(lo + F.col("shift")), "a_hi": high(hi + F.col("shift")), "b_lo": low(lo), "b_hi": high(hi)}).drop("lo", "hi")
    pairs = written(pairs, scope)
    names = ("doc", "th", "lo", "hi")
    ends = pairs.select(*[F.col(c).alias(n) for c, n in zip(A, names)]).unionByName(pairs.select(*[F.col(c).alias(n) for c, n in zip(B, names)]))
    asked = ends.groupBy("doc", "th").agg(F.collect_set(F.struct("lo", "hi")).alias("asked"))
    cut = texts.join(asked.hint("merge"), ["doc", "th"]).select("doc", "th", "text", "asked").mapInArrow(_stretches, "doc long, th long, lo int, hi int, words binary")
    held = written(cut, scope).groupBy(*names).agg(F.any_value("words").alias("words"))

    def compared(pairs: DataFrame) -> DataFrame:
        left = held.select(*[F.col(n).alias(c) for c, n in zip(A, names)], F.col("words").alias("words_a"))
        right = held.select(*[F.col(n).alias(c) for c, n in zip(B, names)], F.col("words").alias("words_b"))
        hot = frequent(pairs.groupBy(*A).agg(F.count("*").alias("n")), pairs.count(), A)
        laid = spread(pairs.join(right.hint("merge"), B), left, A, hot, scope, "merge")
        return written(laid.select(*A, *B, "shift", "at", "words_a", "words_b").mapInArrow(_compare, SEEN), scope)

    a_place = ["a_doc", "a_th", "a_pos"]
    group = [*a_place, "word"]
    spans, step = None, 0
    while True:
        seen = compared(pairs)
        good = seen.where("head").select(_place("a").alias("a"), _place("b").alias("b"), "start", "n")
        spans = good if spans is None else spans.unionByName(good)
        open_places = seen.groupBy(*a_place).agg(F.count("*").alias("n"), F.bool_and(F.expr("good or a_doc = b_doc")).alias("all")).where("n > 1 and not all").select(*a_place, "n")
        open_places = written(open_places, scope)
        if open_places.isEmpty():
            break
        others = spread(seen, open_places.select(*a_place), a_place, frequent(open_places, seen.count(), a_place), scope, "merge")
        sides = written(others.select(*a_place, *B, "b_pos", "b_last", F.explode(F.concat(F.array("left", "right"), "near") if step < STEPS else F.array("left", "right")).alias("word")).where("word is not null"), scope)
        step += 1
        member = F.struct(F.col("b_doc").alias("doc"), F.col("b_th").alias("th"), F.col("b_pos").alias("pos"), F.col("b_lo").alias("lo"), F.col("b_hi").alias("hi"))
        first = written(sides.groupBy(*group).agg(F.min(member).alias("first"), F.max("b_doc").alias("last"), F.count("*").alias("n")).where("first.doc != last").select(*group, "first", "n"), scope)
        again = spread(sides, first, group, frequent(first, sides.count(), group), scope, "merge").where(member != F.col("first"))
        again = again.select(F.col("first.doc").alias("a_doc"), F.col("first.th").alias("a_th"), F.col("first.lo").alias("a_lo"), F.col("first.hi").alias("a_hi"), *B, (F.col("first.pos") - F.col("b_pos")).alias("shift"), "b_pos", "b_last")
        pairs = written(again.groupBy(*A, *B, "shift").agg(F.collect_set(F.struct("b_pos", "b_last")).alias("at")), scope)
        if pairs.isEmpty():
            break
    spans = written(spans, scope)

    node = lambda s: F.concat_ws(":", f"{s}.doc", f"{s}.th", f"{s}.pos")
    named = spans.withColumns({"u": node("b"), "v": node("a")})
    labels = components(named.select("u", "v"), scope)
    pieces = named.join(labels, F.col("u") == F.col("node")).select(F.col("b.doc").alias("doc_id"), F.col("b.th").alias("th"), F.col("start").cast("long").alias("start"), (F.col("start") + F.col("n")).cast("long").alias("stop"), F.col("component").alias("cluster"), F.col("a.doc").alias("first_doc"))
    # The spans of one text are bounded by its words.
    order = Window.partitionBy("doc_id", "th").orderBy("start", "stop")
    reached = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opened = pieces.withColumn("opens", F.coalesce(F.col("start") > reached, F.lit(True)).cast("int"))
    whole = opened.withColumn("part", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0))).groupBy("doc_id", "th", "part")
    return whole.agg(F.min("start").alias("start"), (F.max("stop") - F.min("start")).alias("n_words"), F.min(F.struct("cluster", "first_doc")).alias("from")).select("doc_id", "th", "start", "n_words", F.col("from.cluster").alias("cluster"), F.col("from.first_doc").alias("first_doc"))


def without(text: str, spans: list) -> str:
    """The text without the words of the spans and what lies between them;
    the white space before a span stays, that after it goes."""
    data = text.encode("utf-8", "surrogatepass")
    _, starts, ends, _ = words.split([data])
    parts, done = [], 0
    for span in sorted(spans, key=lambda s: s["start"]):
        first, last = span["start"], span["start"] + span["n_words"] - 1
        parts.append(data[done : starts[first]])
        done = int(starts[last + 1]) if last + 1 < len(starts) else len(data)
    return b"".join([*parts, data[done:]]).decode("utf-8", "surrogatepass")


def cleaned(documents: DataFrame, scope: Scratch | None = None) -> DataFrame:
    """`documents` without repeated passages, all rows and columns kept, with
    any names; the text, and n_chars if there is one, are those that remain.
    Rows without repeats() stay as they are."""
    scope = scope or Scratch()
    found = written(repeats(documents, scope), scope)
    doc, th, key, cut = (unused(documents, n) for n in ("__doc", "__th", "__key", "__cuts"))
    cuts = found.groupBy(F.col("doc_id").alias(doc), F.col("th").alias(th)).agg(F.collect_list(F.struct("start", "n_words")).alias(cut))
    columns, counted = documents.columns, dict(documents.dtypes).get("n_chars") in ("int", "bigint")
    joined = documents.withColumn(key, F.xxhash64("text")).join(sized(cuts), (F.col("doc_id") == F.col(doc)) & (F.col(key) == F.col(th)), "left").select(*[f"`{c}`" for c in columns], cut)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cuts = batch.column(cut).to_pylist()
            kept = batch.select(columns)
            if any(cuts):
                texts = [without(t, c) if c else t for t, c in zip(batch.column("text").to_pylist(), cuts)]
                kept = kept.set_column(columns.index("text"), "text", pa.array(texts, kept.schema.field("text").type))
                if counted:
                    kind = kept.schema.field("n_chars").type
                    sizes = [len(t) if c else n for t, c, n in zip(texts, cuts, batch.column("n_chars").to_pylist())]
                    kept = kept.set_column(columns.index("n_chars"), "n_chars", pa.array(sizes, kind))
            yield kept

    return joined.mapInArrow(apply, documents.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(table(spark, sf_dir, "documents", "doc_id", "text")).drop("th")
