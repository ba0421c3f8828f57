"""Each operator against brute force, and on nulls, empty and very long texts,
ties, repeated rows, empty tables and clashing column names."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from loamcast.llm import chat, decontamination, langid, links, media, neardup, packing, passages, quality, tokencount, urls
from loamcast.llm.common import Scratch

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed, n=200, vocabulary=4000):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary)}x" for _ in range(n))


def words_of(text):
    return WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)


ODD = [(1, None), (2, ""), (3, "   \n"), (4, "one"), (None, "a null id here"), (5, prose(5)), (5, prose(5)), (6, "é" * 3000 + " ß ١٢ 漢字"), (7, prose(7, 60_000))]


def shuffled_columns(df):
    """With extra columns whose names operators might use themselves."""
    return df.select(F.lit(1).alias("n_words"), F.lit("x").alias("node"), F.lit(2).alias("key"), "*", F.lit(3).alias("score"), F.lit(4).alias("bands"), F.lit(5).alias("start"))


# 1: decontamination


def brute_hits(text, items, window=13):
    w = words_of(text)
    hit, ids = set(), set()
    for i, body in items:
        v = words_of(body)
        k = min(window, len(v))
        for a in range(max(1, len(v) - window + 1) if v else 0):
            for p in range(len(w) - k + 1):
                if w[p : p + k] == v[a : a + k]:
                    hit |= set(range(p, p + k))
                    ids.add(str(i))
    return len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)


def test_contamination_is_brute_force(spark):
    items = [(10, prose(1, 40)), (2, prose(2, 13)), (3, "Short ITEM"), (4, ""), (2, prose(2, 13)), (7, prose(1, 40) + " tail")]
    long = prose(3, 500)
    rows = [*ODD[:7], (10, f"{long} {prose(1, 40).upper()}, {long}"), (11, " ".join(prose(1, 40).split()[5:20])), (12, "x short item y short\nitem"), (13, prose(2, 12)), (14, " ".join([prose(2, 13)] * 40))]
    bench = spark.createDataFrame([*items, (9, None)], "item_id long, text string")
    got = decontamination.contamination(shuffled_columns(docs(spark, rows)), bench).collect()
    assert len(got) == len(rows)
    expected = sorted(((i, *brute_hits(t, items)) for i, t in rows), key=str)
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got), key=str) == expected
    best = next(r for r in got if r.doc_id == 10)
    assert best.longest_match == 40 and any(m.start == 500 and m.words == 40 for m in best.matches)
    kept = decontamination.decontaminated(docs(spark, rows), bench)
    assert kept.columns == DOCS.replace(" long", "").replace(" string", "").split(", ")
    assert kept.count() == sum(not e[5] for e in expected)


def test_contamination_of_nothing(spark):
    none, bench = docs(spark, []), spark.createDataFrame([], "item_id long, text string")
    assert decontamination.contamination(none, bench).count() == 0
    assert [r.contaminated for r in decontamination.contamination(docs(spark, ODD[:5]), bench).collect()] == [False] * 5


def test_benchmark_blocks_agree(spark, monkeypatch):
    bench = spark.createDataFrame([(i, prose(i, 20)) for i in range(30)], "item_id long, text string")
    rows = [(i, prose(i + 100, 50) + " " + prose(i, 20) + " " + prose(i + 1, 20)) for i in range(20)]
    whole = decontamination.contamination(docs(spark, rows), bench).drop("matches").collect()
    monkeypatch.setattr(decontamination, "BLOCK", 900)
    assert sorted(decontamination.contamination(docs(spark, rows), bench).drop("matches").collect()) == sorted(whole)


# 2: near duplicates


def edited(text, every, seed):
    rng = random.Random(seed)
    w = text.split()
    for i in range(rng.randrange(every), len(w), every):
        w[i] = f"new{rng.randrange(10**6)}"
    return " ".join(w)


def plain(a, b):
    x, y = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (words_of(a), words_of(b)))
    return len(x & y) / len(x | y)


def test_near_duplicates(spark):
    base = [prose(s, 300) for s in range(30)]
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(100 + i, edited(base[i], 60, i)) for i in range(10)]  # about 0.85
    rows += [(200 + i, edited(base[10 + i], 15, i)) for i in range(10)]  # about 0.5
    rows += [(300, base[20]), (301, base[20].upper()), (302, None), (303, None), (304, ""), (305, ""), (306, "one two"), (307, "One, two!"), (None, base[21]), (20, base[20])]
    got = neardup.classes(shuffled_columns(docs(spark, rows))).collect()
    assert len(got) == len(rows)
    of = {}
    for r in got:
        of.setdefault(r.doc_id, r)
    for i in range(10):
        assert of[100 + i].class_id == (i if plain(base[i], edited(base[i], 60, i)) >= 0.8 else 100 + i)
        assert of[200 + i].class_id == 200 + i
    assert of[300].class_id == of[301].class_id == 20 and of[20].class_size == 4
    assert of[302].class_id == 302 and of[303].class_id == 303
    assert of[304].class_id == of[305].class_id == 304 and of[306].class_id == of[307].class_id == 306
    assert of[None].class_id == 21
    kept = neardup.deduplicated(docs(spark, rows))
    ids = sorted((r.doc_id for r in kept.collect()), key=lambda x: (x is None, x))
    assert ids.count(20) == 1 and 300 not in ids and 302 in ids and 303 in ids and None not in ids and 305 not in ids
    assert kept.columns == docs(spark, []).columns


def test_crowded_bucket_is_settled(spark):
    """Many copies that fail against the centre; a few of them are alike."""
    base = prose(1, 300)
    rows = [(0, base)] + [(i, edited(base, 100, i)) for i in range(1, 60)] + [(i, edited(base, 18, i)) for i in range(60, 120)]
    variant = edited(base, 18, 999)
    rows += [(i, edited(variant, 100, i)) for i in range(200, 205)]
    frame = docs(spark, rows)
    got = {r.doc_id: r.class_id for r in neardup.classes(frame).collect()}
    assert got == united(dict(rows), weighted_alike(frame, rows))
    assert len({got[i] for i in range(200, 205)}) == 1 and got[200] == 200


def united(texts, alike):
    """Smallest id of each one's component, by brute force."""
    parent = {i: i for i in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in texts:
        for j in texts:
            if i < j and alike(texts[i], texts[j]):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: find(i) for i in texts}


def weighted_alike(frame, rows):
    """Exact weighted similarity of two texts."""
    idf = neardup.word_weights(frame)
    sets, weights, bounds = neardup.weighted([t.encode() for _, t in rows], idf)
    of = {t: (sets[x:y], weights[x:y]) for (_, t), x, y in zip(rows, bounds, bounds[1:])}
    return lambda a, b: neardup.similarity(of[a], of[b]) >= 0.8


def test_families_of_one_crowd_are_weighted_brute_force(spark):
    """Forms that share 85 of 100 words, with families that share edits or
    deletions among them, so that most buckets are crowded and stay open."""
    import numpy as np

    rng, base = random.Random(4), prose(1, 300).split()

    def form(share, seed):
        r = random.Random(seed)
        at = r.randrange(300)
        own = set((at + k) % 300 for k in range(int(300 * share)))
        return [f"own{seed}n{i}" if i in own else w for i, w in enumerate(base)]

    rows = [(i, " ".join(form(0.15, i))) for i in range(80)]
    rows += [(100 + i, " ".join(form(0.03, 100 + i))) for i in range(20)]
    for k in range(6):  # families around a form of their own
        centre = form(0.2, 500 + k)
        for i in range(6):
            w = list(centre)
            w[rng.randrange(300)] = f"edit{k}n{i}"
            rows.append((1000 + 10 * k + i, " ".join(w)))
    rows += [(2000 + i, " ".join(base[: 300 - 25 * i])) for i in range(8)]  # each is cut a little shorter
    frame = docs(spark, rows)
    expected = united(dict(rows), weighted_alike(frame, rows))
    got = {r.doc_id: r.class_id for r in neardup.classes(frame).collect()}
    assert got == expected
    assert len(set(expected.values())) > 60 and np.unique(list(expected.values()), return_counts=True)[1].max() >= 8


def test_recall_of_queries_against_all_rows(spark):
    """Ids divisible by 100 against all rows, pairs by exact weighted
    similarity: each pair that holds is in one class, each class is linked."""
    rows = []
    for k in range(40):
        text = prose(k, 60 + 10 * k)
        rows += [(100 * k, text), *((100 * k + i, edited(text, 40 + 15 * i, 1000 * k + i)) for i in range(1, 9))]
    rows.append((5000, prose(77, 30_000)))
    rows.append((5001, edited(rows[-1][1], 90, 8)))
    frame, texts = docs(spark, rows), dict(rows)
    alike = weighted_alike(frame, rows)
    got = {r.doc_id: r.class_id for r in neardup.classes(frame).collect()}
    pairs = [(q, i) for q in texts if q % 100 == 0 for i in texts if q != i and alike(texts[q], texts[i])]
    assert len(pairs) > 150 and all(got[q] == got[i] for q, i in pairs)
    expected = united({i: i for i in texts}, lambda a, b: abs(a - b) < 100 and alike(texts[a], texts[b]))
    assert got == expected


def test_prefixes_meet():
    """Similar weighted sets that don't both hold with the pivot share a
    difference that is short for the one less apart from it."""
    import numpy as np

    rng = np.random.default_rng(5)
    base = np.sort(rng.choice(10**6, 80, replace=False)).astype(np.uint64)

    def variant(of, most):
        kept = rng.permutation(of)[rng.integers(0, most) :]
        return np.unique(np.concatenate([kept, rng.choice(10**6, rng.integers(0, most)).astype(np.uint64)]))

    w = lambda s: (s, 1 + (s % np.uint64(7)).astype(float) * np.where(s % np.uint64(5) == 0, rng.integers(1, 3, len(s)), 1))
    tested = 0
    while tested < 300:
        pivot, x = w(base), variant(base, 24)
        a, b = w(x), w(variant(x, 10))
        if neardup.similarity(a, b) < 0.8 or min(neardup.similarity(a, pivot), neardup.similarity(b, pivot)) >= 0.8:
            continue
        tested += 1
        found, counts = [], rng.integers(0, 3, neardup.COUNTERS)
        edits = [neardup.differences(text, pivot, 77) for text in (a, b)]
        for keys, _ in edits:
            np.add.at(counts, (keys & np.uint64(neardup.COUNTERS - 1)).astype(np.int64), 1)
        for text, own in zip((a, b), edits):
            keys, change = neardup.ordered(*own, counts)
            n, short, apart = neardup.prefix(change, text[1].sum(), pivot[1].sum())
            again = neardup.repeated(keys[:n], counts)
            found.append((apart, set(keys[:n][short & again]), set(keys[:n][again])))
        near, far = sorted(found, key=lambda f: f[0])
        assert near[1] & far[2]


def test_few_short_rows_leave_a_bucket_open(spark):
    """A bucket of many rows, of which few are short, has few open pairs; each
    is met once, by the one less apart."""
    few = [(1, f"n{i:03}".encode(), f"n{i:03}".encode(), i % 50 == 0, float(i // 2), 1.0, b"s") for i in range(200)]
    many = [(2, *row[1:3], True, *row[4:]) for row in few]
    rows = spark.createDataFrame(few + many, "key long, node binary, component binary, short boolean, apart double, weight double, sketch binary")
    open_rows, crowded = links._open(rows, links.ROOM, False, Scratch())
    assert {r.key for r in open_rows.collect()} == {1} and {r.key for r in crowded.collect()} == {2}
    met = [tuple(sorted((bytes(r.node), bytes(r.other_node)))) for r in links._one_by_one(open_rows).collect()]
    near = [(a, b) for a in few for b in few if a[3] and a[1] != b[1] and (a[4] < b[4] or a[4] == b[4] and not b[3])]
    assert sorted(met) == sorted(tuple(sorted((a[1], b[1]))) for a, b in near) and len(met) == len(set(met)) > 400


def test_rows_are_kept_with_any_column_names(spark):
    odd = docs(spark, [*ODD[:7], (9, prose(5)), (10, f"{prose(8, 30)} {prose(5, 60)}")])
    for name in ("__cuts", "__node", "__own", "__doc", "__key", "__th", "n", "key"):
        odd = odd.withColumn(name, F.lit(name))
    bench = spark.createDataFrame([(1, prose(7, 30))], "item_id long, text string")
    for kept in (neardup.deduplicated(odd), passages.cleaned(odd), decontamination.decontaminated(odd, bench), langid.identified(odd, {})):
        assert kept.columns == odd.columns
        assert all(r["__cuts"] == "__cuts" and r["__node"] == "__node" for r in kept.collect())


def test_near_duplicates_of_nothing(spark):
    assert neardup.classes(docs(spark, [])).count() == 0
    assert neardup.deduplicated(docs(spark, [])).count() == 0


# 3: quality


def test_quality_learns_and_holds(spark):
    good = [(i, prose(i, 150).replace("x", "") + ".") for i in range(150)]
    bad = [(1000 + i, f"SPAM{i}!! BUY!! " * 30) for i in range(150)]
    labels = spark.createDataFrame([(i, 1) for i, _ in good[:100]] + [(i, 0) for i, _ in bad[:100]] + [(1001, None), (99999, 1)], "doc_id long, quality int")
    rows = docs(spark, good + bad + ODD)
    forest = quality.train(shuffled_columns(rows), labels)
    got = quality.scored(shuffled_columns(rows), forest).collect()
    assert len(got) == 300 + len(ODD) and all(0 <= r.score <= 1 for r in got)
    of = {r.doc_id: r.score for r in got}
    assert min(of[i] for i, _ in good[100:]) > 0.5 > 0.3 > max(of[i] for i, _ in bad[100:])


def test_quality_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    forest = quality.train(docs(spark, ODD), none)
    assert {r.score for r in quality.scored(docs(spark, ODD), forest).collect()} == {0.5}


def test_flat_trees_match_walking(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, len(quality.FEATURES)))
    forest = quality.fit(x, (x[:, 0] * x[:, 1] > 0).astype(float))

    def walk(row):
        total = forest.bias
        for node in forest.roots:
            while forest.feature[node] >= 0:
                node = forest.left[node] + (row[forest.feature[node]] > forest.threshold[node])
            total += forest.value[node]
        return 1 / (1 + np.exp(-total))

    assert np.allclose(forest.score(x), [walk(r) for r in x])


def test_statistics_by_hand():
    """Each feature again, character by character."""
    import math

    for text in ("", "Ab cd, cd!\n<b> 12 é\n\nLast. Ab", prose(3, 40) + "!!", "\ud800 x"):
        data, w, lines = text.encode("utf-8", "surrogatepass"), text.split(), text.split("\n")
        n, size = max(1, len(w)), max(1, len(data))
        share = lambda chars: sum(data.count(c.encode()) for c in chars) / size
        sizes = [len(x) for x in w] or [0]
        mean = sum(sizes) / len(sizes)
        expected = {
            "log_bytes": math.log(1 + len(data)), "log_words": math.log(1 + len(w)), "word_length": mean, "word_spread": math.sqrt(sum((x - mean) ** 2 for x in sizes) / len(sizes)), "longest_word": max(sizes),
            "upper": share("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), "digits": share("0123456789"), "marks": share("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"), "exclaims": share("!"), "spaces": share(" \t\n\r\f\v"), "beyond_ascii": sum(b > 127 for b in data) / size,
            "distinct_words": len(set(w)) / n, "repeated_next": sum(a == b for a, b in zip(w, w[1:])) / n, "top_word": max((w.count(x) for x in w), default=0) / n, "log_lines": math.log(1 + len(lines)), "distinct_lines": len(set(lines)) / len(lines),
            "sentence_words": len(w) / (1 + sum(text.count(c) for c in ".!?")), "markup": share("<>&=/#@\\|_"), "byte_entropy": -sum(data.count(b) / size * math.log2(data.count(b) / size) for b in set(data)), "capitalised": sum(x.istitle() for x in w) / n, "brackets": share("()[]{}"),
        }
        assert quality.statistics(text) == pytest.approx([expected[f] for f in quality.FEATURES], abs=1e-12), text


def test_first_split_is_the_best_of_all(monkeypatch):
    """One tree of one level against every cut of every feature."""
    import numpy as np

    rng = np.random.default_rng(2)
    x = np.round(rng.normal(size=(60, len(quality.FEATURES))), 1)
    y = (x[:, 4] + 0.3 * rng.normal(size=60) > 0.2).astype(float)
    monkeypatch.setattr(quality, "TREES", 1)
    monkeypatch.setattr(quality, "DEPTH", 1)
    forest = quality.fit(x, y)
    p = (y.sum() + 0.5) / 61
    grad, hess = y - p, np.full(60, p * (1 - p))
    gain = lambda m: grad[m].sum() ** 2 / (hess[m].sum() + quality.RIDGE)
    best = max(gain(x[:, f] <= c) + gain(x[:, f] > c) for f in range(x.shape[1]) for c in np.unique(x[:, f]) if quality.LEAST <= (x[:, f] <= c).sum() <= 60 - quality.LEAST)
    f, c = forest.feature[forest.roots[0]], forest.threshold[forest.roots[0]]
    assert gain(x[:, f] <= c) + gain(x[:, f] > c) == pytest.approx(best, rel=0.02)
    left = x[:, f] <= c
    for side, node in ((left, forest.left[forest.roots[0]]), (~left, forest.left[forest.roots[0]] + 1)):
        assert forest.value[node] == pytest.approx(quality.RATE * grad[side].sum() / (hess[side].sum() + quality.RIDGE))


def test_quality_takes_one_document_an_id(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    rows = [(i, prose(i, 20 + i)) for i in range(40)]
    once = quality.train(docs(spark, rows), labels)
    again = quality.train(docs(spark, rows * 3), labels)
    assert once.bias == again.bias and list(once.threshold) == list(again.threshold)


# 4: token counts


def greedy(word, pieces):
    n = i = 0
    while i < len(word):
        for j in range(len(word), i, -1):
            if word[i:j] in pieces:
                n, i = n + 1, j
                break
        else:
            n, i = n + len(word[i].encode()), i + 1
    return n


def test_automaton_is_greedy():
    rng = random.Random(0)
    for _ in range(200):
        pieces = {"".join(rng.choice("abc▁") for _ in range(rng.randrange(1, 6))) for _ in range(rng.randrange(1, 14))}
        automaton = tokencount.Automaton(sorted(pieces))
        for _ in range(30):
            word = "".join(rng.choice("abc▁é") for _ in range(rng.randrange(0, 14)))
            assert automaton.length(word) == greedy(word, pieces), (word, pieces)


def test_token_counts(spark):
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    pieces = {model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))}
    rows = [*ODD[:8], (9, "The quick brown fox's naïveté — 漢字 \U0001f600")]
    got = tokencount.token_counts(shuffled_columns(docs(spark, rows))).collect()
    expected = sorted(((i, len((t or "").split()), sum(greedy("▁" + w, pieces) for w in (t or "").split())) for i, t in rows), key=str)
    assert sorted(map(tuple, got), key=str) == expected
    assert tokencount.token_counts(docs(spark, [])).count() == 0


# 5: languages


def test_languages(spark):
    alphabets = {"aa": "abcde", "bb": "cdefgh", "cc": "xyzuvß"}

    def text(lang, seed, n=60):
        rng = random.Random(f"{lang}{seed}")
        return " ".join("".join(rng.choice(alphabets[lang]) for _ in range(5)) for _ in range(n))

    train = spark.createDataFrame([(i, text(lang, i), lang) for i in range(20) for lang in alphabets] + [(900, "abc", None), (901, None, "aa")], "doc_id long, text string, lang string")
    prototypes = langid.train(train)
    assert sorted(prototypes) == sorted(alphabets)
    rows = [(100 + k, text(lang, 777, 3000 * k + 4)) for k, lang in enumerate(alphabets)] + [(1, None), (2, ""), (3, "123 !?"), (None, text("bb", 5))]
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(shuffled_columns(docs(spark, rows)), prototypes).collect()}
    assert [got[100 + k][0] for k in range(3)] == list(alphabets) and got[None][0] == "bb"
    assert got[1] == got[2] == got[3] == ("und", 0.0) and all(0 <= s <= 1 for _, s in got.values())
    assert langid.identify(docs(spark, []), prototypes).count() == 0
    assert langid.train(train.limit(0)) == {}
    assert {r.lang_pred for r in langid.identify(docs(spark, rows), {}).collect()} == {"und"}
    assert langid.identified(docs(spark, rows), prototypes).count() == 4
    foreign = docs(spark, [(1, "ждлорпавы " * 40), (2, text("aa", 3)), (3, text("bb", 4, 4))])
    assert {r.doc_id for r in langid.identified(foreign, prototypes).collect()} == {2, 3}


def test_profiles_are_bound_and_bundled_by_hand(spark):
    """Letters rotated by their place and multiplied, trigrams added up, one
    by one; then prototypes, cosines and the choice."""
    import numpy as np

    letters, symbols = langid.letter_vectors().astype(int), langid.symbol_table()

    def profile(text):
        total = np.zeros(langid.DIM)
        codes = [int(symbols[ord(c)]) for c in f" {text.lower()}  "]
        for a, b, c in zip(codes, codes[1:], codes[2:]):
            if b:
                total += np.roll(letters[a], 2) * np.roll(letters[b], 1) * letters[c]
        return total

    rows = [(i, f"{prose(i, 8)} {'äéñß'[i % 4]}{'un die the los'.split()[i % 4]}", "dfes"[i % 4]) for i in range(24)]
    prototypes = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    for lang in "dfes":
        mine = sum(profile(t) / max(1, np.linalg.norm(profile(t))) for _, t, x in rows if x == lang)
        assert np.allclose(prototypes[lang], mine / np.linalg.norm(mine), atol=1e-6)
    texts = ["the ñandú los", "Die Äpfel", "x", prose(9, 300)]
    found, scores = langid.predict(texts, prototypes)
    for text, lang, score in zip(texts, found, scores):
        vector = profile(text) / np.linalg.norm(profile(text))
        cosines = {k: float(vector @ p) for k, p in prototypes.items()}
        assert cosines[lang] == pytest.approx(max(cosines.values()), abs=1e-5) and score == pytest.approx(max(0, max(cosines.values())), abs=1e-5)


def test_slices_change_nothing(monkeypatch):
    import numpy as np

    text = prose(3, 3000)
    whole, letters = langid.Bundler().bundle([text])
    monkeypatch.setattr(langid, "SLICE", 997)
    sliced, again = langid.Bundler().bundle([text])
    assert np.array_equal(whole, sliced) and np.array_equal(letters, again)


# 6: repeated passages


def exact_repeats(rows):
    first, out = {}, {}
    for i, t in sorted(rows):
        w = words_of(t)
        for p in range(len(w) - 50):
            key = tuple(w[p : p + 51])
            if first.setdefault(key, i) != i:
                out.setdefault(i, set()).update(range(p, p + 51))
    return out


def test_passages(spark):
    shared = [prose(1000 + s, n) for s, n in enumerate((51, 57, 80, 300))]
    rows = [(i, prose(i, 120)) for i in range(40)]
    for i in range(40, 90):
        rows.append((i, f"{prose(i, 30 + i)} {shared[i % 4]} {prose(i + 500, 40)}"))
    rows += [(90, f"{prose(90, 60)} {prose(2000, 50)} {prose(91, 9)}"), (91, f"{prose(92, 60)} {prose(2000, 50)} {prose(93, 9)}")]  # 50 words are too few
    hub = prose(3000, 30)  # alone too short, but two of five share more around it
    left, right = prose(3001, 25), prose(3002, 25)
    rows += [(200 + i, f"{prose(600 + i, 70)} {left if i in (2, 4) else prose(700 + i, 25)} {hub} {right if i in (3, 4) else prose(800 + i, 25)} {prose(900 + i, 70)}") for i in range(6)]
    expected = exact_repeats(rows)
    got = {}
    spans = passages.repeats(shuffled_columns(docs(spark, [*rows, (None, shared[0]), (300, None), (301, ""), (40, rows[40][1])]))).collect()
    for r in spans:
        got.setdefault(r.doc_id, set()).update(range(r.start, r.start + r.n_words))
    assert set(got) == set(expected)
    for i, where in expected.items():
        assert where <= got[i] and len(got[i]) <= len(where) + 10, i
    cleaned = {r.doc_id: r for r in passages.cleaned(docs(spark, [*rows, (None, shared[0]), (300, None)])).collect()}
    assert len(cleaned) == len(rows) + 2 and cleaned[300].text is None and cleaned[None].text == shared[0]
    assert not exact_repeats([(i, r.text) for i, r in cleaned.items() if i is not None])
    assert cleaned[44].n_chars == len(cleaned[44].text) and cleaned[0].text == rows[0][1]


def test_passages_with_a_changed_word(spark):
    """51 words, one of them changed, at every place that leaves 42 of 47
    shingles: all are found."""
    rows = []
    for k in range(5, 46):
        w = prose(5000 + k, 51).split()
        edit = [*w[:k], "changed", *w[k + 1 :]]
        rows += [(2 * k, f"{prose(5100 + k, 60)} {' '.join(w)} {prose(5200 + k, 60)}"), (2 * k + 1, f"{prose(5300 + k, 70)} {' '.join(edit)} {prose(5400 + k, 60)}")]
    got = {r.doc_id: (r.start, r.n_words) for r in passages.repeats(docs(spark, rows)).collect()}
    assert got == {2 * k + 1: (70, 51) for k in range(5, 46)}


def test_near_passages_where_a_third_document_holds_the_middle(spark):
    """60 words with one changed word; the middle 35 stand in an earlier
    document too. All pairs hold by exact Jaccard, and all are found."""
    rng, rows = random.Random(11), []
    for k in range(60):
        w = prose(20_000 + k, 60).split()
        edit = list(w)
        edit[rng.randrange(60)] = "changed"
        rows.append((3 * k, f"{prose(21_000 + k, 80)} {' '.join(w[12:47])} {prose(22_000 + k, 80)}"))
        rows.append((3 * k + 1, f"{prose(23_000 + k, 70)} {' '.join(w)} {prose(24_000 + k, 70)}"))
        rows.append((3 * k + 2, f"{prose(25_000 + k, 75)} {' '.join(edit)} {prose(26_000 + k, 75)}"))
    got = {}
    for r in passages.repeats(docs(spark, rows)).collect():
        got.setdefault(r.doc_id, []).append((r.start, r.n_words))
    assert set(got) == {3 * k + 2 for k in range(60)}
    assert all(len(x) == 1 and 74 <= x[0][0] <= 80 and 51 <= x[0][1] <= 61 for x in got.values())


def shingle_sets(text):
    w = words_of(text)
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)}


@pytest.mark.parametrize("edit", ["change", "insert", "delete"])
@pytest.mark.parametrize("earlier", ["none", "middle", "sides"])
def test_recall_of_edited_passages(spark, edit, earlier):
    """Passages of 60 and 100 words with one word changed, inserted or deleted
    anywhere; their middle, or both sides of the edit, may stand in earlier
    documents. All hold by brute-force Jaccard; 0.9 of them must be found."""
    rng, rows, edited = random.Random(f"{edit}{earlier}"), [], {}
    fresh = lambda n: prose(rng.randrange(10**9), n).split()
    add = lambda *parts: rows.append((len(rows), " ".join(w for p in parts for w in p)))
    for k in range(60):
        w = fresh(60 if k % 2 else 100)
        at = len(w) // 2 if earlier == "sides" or k % 3 else rng.randrange(6, len(w) - 6)
        other = [*w[:at], *([f"new{k}"] if edit != "delete" else []), *w[at + (edit != "insert") :]]
        a, b = shingle_sets(" ".join(w)), shingle_sets(" ".join(other))
        assert len(a & b) >= 0.8 * len(a | b)
        if earlier == "middle":
            add(fresh(50), w[12:47], fresh(50))
        if earlier == "sides":
            add(fresh(40), w[:at], fresh(40))
            add(fresh(40), w[at + 1 :], fresh(40))
        add(fresh(60), w, fresh(60))
        add(fresh(70), other, fresh(50))
        edited[len(rows) - 1] = len(other)
    got = {}
    for r in passages.repeats(docs(spark, rows)).collect():
        got.setdefault(r.doc_id, set()).update(range(r.start, r.start + r.n_words))
    assert not set(got) - set(edited)
    whole = [i for i, n in edited.items() if set(range(80, 60 + n)) <= got.get(i, set()) <= set(range(70, 70 + n))]
    assert len(whole) >= 0.9 * len(edited), (len(got), len(whole))


def test_runs_are_brute_force():
    """Every window of PASSAGE words whose ends agree, against sets of shingles."""
    rng = random.Random(8)
    for _ in range(30):
        a = [rng.randrange(1, 500) for _ in range(150)]
        b = a[20:130]
        for _ in range(rng.randrange(1, 5)):
            k = rng.randrange(len(b))
            b[k : k + rng.randrange(2)] = [rng.randrange(1, 500) for _ in range(rng.randrange(2))]
        grams = lambda x: [tuple(x[k : k + 5]) for k in range(len(x) - 4)]
        ga, gb = grams(a), grams(b)
        covered = set()
        for s in range(len(b) - passages.PASSAGE + 1):
            own = gb[s : s + passages.PASSAGE - 4]
            if own[0] in ga and own[-1] in ga:
                there = set(ga[ga.index(own[0]) : ga.index(own[-1]) + 1])
                if len(there & set(own)) >= 0.8 * len(there | set(own)):
                    covered |= set(range(s, s + passages.PASSAGE))
        found = passages.runs(np.array(a, "<u4"), np.array(b, "<u4"), 20)
        spanned = {k for s, n in found for k in range(s, s + n)}
        assert covered <= spanned and bool(covered) == bool(spanned)
        assert all(gb[k] in ga for s, n in found for k in (s, s + n - 5))


def test_passages_of_one_hot_line(spark, monkeypatch):
    """A line of 40 words in most texts, with families around it; its keys
    count as frequent."""
    monkeypatch.setattr(links, "SHARES", 8)
    line, tails = prose(30_000, 40), [prose(30_100 + k, 25) for k in range(6)]
    rows = [(i, f"{prose(31_000 + i, 30)} {line} {tails[i % 6] if i % 3 else prose(32_000 + i, 25)} {prose(33_000 + i, 20)}") for i in range(150)]
    expected, got = exact_repeats(rows), {}
    for r in passages.repeats(docs(spark, rows)).collect():
        got.setdefault(r.doc_id, set()).update(range(r.start, r.start + r.n_words))
    assert set(got) == set(expected) and all(where <= got[i] for i, where in expected.items())


def test_passages_of_a_line_that_stands_twice(spark):
    """In the document of the smallest id, with different surroundings; a text
    repeats the second ones."""
    rows = []
    for k in range(12):
        line, second = prose(4000 + k, 45), prose(4100 + k, 10)
        rows.append((2 * k, f"{prose(4200 + k, 60)} {line} {prose(4300 + k, 60)} {line} {second} {prose(4400 + k, 60)}"))
        rows.append((2 * k + 1, f"{prose(4500 + k, 60)} {line} {second} {prose(4600 + k, 60)}"))
    expected, got = exact_repeats(rows), {}
    for r in passages.repeats(docs(spark, rows)).collect():
        assert r.doc_id != r.first_doc
        got.setdefault(r.doc_id, set()).update(range(r.start, r.start + r.n_words))
    assert set(got) == set(expected) == {2 * k + 1 for k in range(12)}
    assert all(where <= got[i] for i, where in expected.items())


def test_passages_of_nothing(spark):
    assert passages.repeats(docs(spark, [])).count() == 0
    assert passages.cleaned(docs(spark, ODD)).count() == len(ODD)


# 7: packing


def test_packing(spark):
    from tokenizers import Tokenizer

    import public_tokenizers

    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = [*ODD, (20, "end <|endoftext|> here"), (21, "漢字 ünï 🙂")] + [(i, prose(i, i)) for i in range(100, 160)]
    got = packing.pack(shuffled_columns(docs(spark, rows))).collect()
    import numpy as np

    by, sequences = {}, {}
    for r in got:
        by.setdefault((r.doc_id, r.doc_tokens), []).append(r)
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, t in rows:
        ids = whole.encode(t or "", add_special_tokens=False).ids + [1]
        mine = {(r.start, r.length, r.ids_crc32) for r in by[i, len(ids)]}
        assert mine == {(s, len(ids[s : s + 2048]), zlib.crc32(np.array(ids[s : s + 2048], "<u4").tobytes())) for s in range(0, len(ids), 2048)}
    assert sum(r.length for r in got) == sum(len(whole.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in rows)
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack(docs(spark, [])).count() == 0


def test_first_fit_is_brute_force():
    rng = random.Random(1)
    for _ in range(50):
        lengths = [rng.randrange(1, 101) for _ in range(rng.randrange(1, 60))]
        room, expected = [], [None] * len(lengths)
        for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
            k = next((k for k, r in enumerate(room) if r >= lengths[i]), len(room))
            if k == len(room):
                room.append(100)
            expected[i] = (k, 100 - room[k])
            room[k] -= lengths[i]
        assert list(zip(*packing.first_fit(lengths, 100))) == expected


# 8: media


def test_media_round_trip(spark):
    got = media.read_media(media.store_texts(shuffled_columns(docs(spark, ODD)))).collect()
    expected = []
    for i, t in ODD:
        data = (t or "").encode()
        payload = data + b"\xff" * (-len(data) % 576 or (0 if data else 576))
        expected.append((i, len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:])))
    assert sorted(((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got), key=str) == sorted(expected, key=str)
    assert {r.media_type for r in got} == {"image/png"}


def test_sniffing_and_carving(spark):
    import struct

    png = media.encode_png(b"a" * 576)
    wav = b"RIFF" + struct.pack("<I", 4 + 24 + 12) + b"WAVEfmt " + struct.pack("<I", 16) + b"\1\0\1\0" + b"\0" * 12 + b"data" + struct.pack("<I", 4) + b"abcd"
    gif = b"GIF89a\1\0\1\0\x80\0\0" + b"\0" * 6 + b",\0\0\0\0\1\0\1\0\0" + b"\2\2D\1\0;"
    jpeg = b"\xff\xd8\xff\xe0\0\4ab\xff\xda\0\4cdxy\xff\0z\xff\xd9"
    bmp = b"BM" + struct.pack("<IIIIiiHH", 58, 0, 54, 40, 1, 1, 1, 24) + b"\0" * 24 + b"rgb\0"
    for blob, kind in ((png, "image/png"), (wav, "audio/wav"), (gif, "image/gif"), (jpeg, "image/jpeg"), (bmp, "image/bmp")):
        assert media.sniff(blob) == kind
        assert media.carve(b"BM RIFF GIF89a" + blob + b"\xff\xd8\xff tail") == [(14, 14 + len(blob), kind)]
        assert media.sniff(blob[:-1]) == "application/octet-stream"
    broken = png[:50] + b"?" + png[51:]
    rows = [(1, "image/gif", png), (2, "x", broken), (3, None, None), (4, "x", b""), (5, "x", wav + png)]
    got = {r.id: r for r in media.sniff_media(spark.createDataFrame(rows, "id long, declared string, media binary")).collect()}
    assert got[1].media_type == "image/png" and not got[2].parts and not got[3].parts and not got[4].parts
    assert [p.type for p in got[5].parts] == ["audio/wav", "image/png"]


def test_foreign_blobs_are_read(spark):
    import struct

    def png(filters):
        """Grey 8-bit lines of 4 samples, written with the given filters."""
        lines, before, raw = [bytes((i * 37 + x * 11) % 256 for x in range(4)) for i in range(len(filters))], bytes(4), b""
        for kind, line in zip(filters, lines):
            out = []
            for x in range(4):
                a, b, c = (line[x - 1] if x else 0), before[x], (before[x - 1] if x else 0)
                p = a + b - c
                paeth = a if abs(p - a) <= abs(p - b) and abs(p - a) <= abs(p - c) else b if abs(p - b) <= abs(p - c) else c
                out.append((line[x] - (0, a, b, (a + b) // 2, paeth)[kind]) % 256)
            raw, before = raw + bytes([kind, *out]), line
        chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
        return media.PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", 4, len(lines), 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""), b"".join(lines)

    blob, samples = png([0, 1, 2, 3, 4, 4, 3])
    wav = b"RIFF" + struct.pack("<I", 4 + 24 + 12) + b"WAVEfmt " + struct.pack("<I", 16) + b"\1\0\1\0" + b"\0" * 12 + b"data" + struct.pack("<I", 4) + b"abcd"
    rows = [(1, 5, "image/gif", blob), (2, 0, None, None), (3, 0, "x", b""), (4, 3, "x", b"abc"), (5, 9, "text/plain", b"junk" + wav + blob), (None, None, None, blob[:-3])]
    stored = spark.createDataFrame(rows, "doc_id long, n_bytes long, declared string, media binary").withColumn("feature", F.lit("clash"))
    got = {r.doc_id: r for r in media.read_media(stored).collect()}
    sha = lambda x: hashlib.sha256(x).hexdigest()
    assert (got[1].payload_sha256, got[1].media_type, got[1].declared, got[1].payload_bytes) == (sha(samples), "image/png", "image/gif", 28)
    for k, body in ((2, b""), (3, b""), (4, b"abc"), (None, blob[:-3])):
        assert (got[k].payload_sha256, got[k].media_type, got[k].n_media, got[k].media_bytes) == (sha(body), media.OTHER, 0, len(body))
    assert (got[5].payload_sha256, got[5].media_type, got[5].n_media, got[5].media_sha256) == (sha(wav), "audio/wav", 2, sha(b"junk" + wav + blob))
    assert got[1].feature.startswith("image/png 4x7 ") and media.read_media(stored.limit(0)).count() == 0


def test_stored_png_by_another_decoder(spark):
    """Chunks, checksums and samples read by hand; features from numpy."""
    import struct

    import numpy as np

    row = media.store_texts(docs(spark, [(1, prose(3, 300))])).first()
    at, data = 8, {}
    while at < len(row.media):
        n, kind = struct.unpack_from(">I4s", row.media, at)
        body = bytes(row.media[at + 8 : at + 8 + n])
        assert struct.unpack_from(">I", row.media, at + 8 + n)[0] == zlib.crc32(kind + body)
        data[kind], at = data.get(kind, b"") + body, at + 12 + n
    width, height = struct.unpack_from(">II", data[b"IHDR"])
    lines = np.frombuffer(zlib.decompress(data[b"IDAT"]), np.uint8).reshape(height, width + 1)
    samples = lines[:, 1:].ravel()
    text = prose(3, 300).encode()
    assert not lines[:, 0].any() and samples.tobytes() == text + b"\xff" * (-len(text) % 576)
    got = media.read_media(media.store_texts(docs(spark, [(1, prose(3, 300))]))).first()
    share = np.unique(samples, return_counts=True)[1] / len(samples)
    assert got.feature == f"image/png 576x{height} mean={samples.mean():.4f} sd={samples.std():.4f} bits={-(share * np.log2(share)).sum():.4f}"
    assert (got.media_bytes, got.media_sha256) == (len(row.media), hashlib.sha256(row.media).hexdigest())


# 9: chat


@pytest.mark.parametrize("text", ["", "<s>", "</s>[INST] ok [/INST]", "<\\/s>", "<\\\\<|turn|>", "[\\INST]", "a < b <| c", "<|done|>" * 3, "<" + "\\" * 5 + "/s>", "<|turn\\|>"])
def test_escaping_is_reversible(text):
    safe = chat.escape(text)
    assert chat.unescape(safe) == text and not any(c in safe for c in chat.CONTROL)
    assert chat.parse(chat.OPEN + chat.escape("role<s>") + chat.SAYS + safe + chat.CLOSE) == ("role<s>", text)


def test_chat(spark):
    rows = [(1, 1, "assistant", "b </s>"), (1, 0, "user", "a"), (1, 2, "user", None), (1, 3, "assistant", "d"), (2, 0, None, "x"), (None, 0, "user", "q"), (None, 1, "assistant", "r"), (3, None, "assistant", ""), (3, 5, "user", "same"), (3, 5, "user", "same")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("piece", F.lit(9))
    pieces = chat.format_chat(table)
    got = {r.conv_id: r for r in chat.digests(pieces).collect()}
    assert {k: v.n_turns for k, v in got.items()} == {1: 4, 2: 1, None: 2, 3: 3}
    for conv in (1, 2, None, 3):
        mine = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1]))
        loss = "".join(r[3] or "" for r in mine if r[2] == "assistant")
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in mine).encode()).hexdigest()
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    examples = {(r.conv_id, r.example): r for r in chat.expanded(pieces).collect()}
    last = examples[1, 1]
    assert chat.unescape(last.input[last.loss_start : last.loss_end]) == "d" and last.input.count(chat.OPEN) == 4
    mixed = pieces.repartition(7, "piece").orderBy(F.rand(3))
    assert sorted(map(tuple, chat.digests(mixed).collect()), key=str) == sorted(map(tuple, got.values()), key=str)
    for e in examples.values():  # every example is the transcript's beginning, its reply at the end
        mine = sorted((r for r in pieces.collect() if r.conv_id == e.conv_id), key=lambda r: r.piece)
        reply = next(r for r in mine if r.example == e.example)
        assert e.input == "".join(r.formatted for r in mine[: reply.piece + 1])
        assert (reply.context_chars, reply.context_crc32) == (sum(len(r.formatted) for r in mine[: reply.piece]), zlib.crc32("".join(r.formatted for r in mine[: reply.piece]).encode()))
    for broken in (pieces.where("not (conv_id = 1 and piece = 0)"), pieces.unionByName(pieces), pieces.withColumn("context_chars", F.col("context_chars") + 1), pieces.withColumn("context_crc32", F.lit(1).cast("long"))):
        with pytest.raises(Exception, match="conversation"):
            chat.digests(broken).collect()
    assert chat.format_chat(table.limit(0)).count() == chat.digests(chat.format_chat(table.limit(0))).count() == 0


def test_long_conversations(spark):
    rows = [(1, k, "assistant" if k % 2 else "user", f"t{k} </s> " * (1 + 20_000 * (k == 3))) for k in range(400)] + [(2, 0, "user", "x")]
    got = {r.conv_id: r for r in chat.digests(chat.format_chat(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    loss = "".join(t for c, _, role, t in rows if c == 1 and role == "assistant")
    assert (got[1].n_turns, got[1].n_examples, got[1].loss_chars, got[1].loss_sha256) == (400, 200, len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_examples_are_written_out(spark, monkeypatch):
    monkeypatch.setattr(chat, "WRITTEN", 50)
    rows = [(1, 1, "assistant", "b </s>"), (1, 0, "user", "a"), (1, 2, "user", None), (1, 3, "assistant", "d<|done|>"), (1, 4, "user", "after"), (2, 0, None, "x"), (None, 0, "user", "q"), (None, 1, "assistant", ""), (3, 0, "assistant", "n\n")]
    pieces = chat.format_chat(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    written = chat.examples(pieces)
    got = {(r.conv_id, r.example): r for r in written.collect()}
    assert set(got) == {(1, 0), (1, 1), (1, None), (2, None), (None, 0), (3, 0)}
    for e in chat.expanded(pieces).collect():
        r = got[e.conv_id, e.example]
        assert (r.input, r.loss_start, r.loss_end) == (e.input, e.loss_start, e.loss_end)
    whole = "".join(chat.OPEN + role + chat.SAYS + chat.escape(text) + chat.CLOSE for role, text in (("user", "a"), ("assistant", "b </s>"), ("user", ""), ("assistant", "d<|done|>"), ("user", "after")))
    assert got[1, None].input == whole and got[1, None].turns == 5 and got[1, 1].input == whole[: len(got[1, 1].input)]
    want = sorted(map(tuple, chat.digests(pieces).collect()), key=str)
    for back in (chat.examples_read(written), chat.examples_read(written.repartition(5, "turns").orderBy(F.rand(3)))):
        assert sorted(map(tuple, back.collect()), key=str) == want
    for broken in (written.where("not (conv_id = 1 and example = 0)"), written.unionByName(written), written.withColumn("loss_start", F.lit(0).cast("long")), written.withColumn("input", F.expr("if(example = 1, replace(input, 'user', 'User'), input)"))):
        with pytest.raises(Exception):
            chat.examples_read(broken).collect()
    assert chat.examples_read(chat.examples(pieces.limit(0))).count() == 0


# 10: urls


def test_urls(spark):
    pages = [(1, "http://A.Example.org/es/x"), (2, "https://example.org/en/12?q"), (3, "x.org/none"), (4, None), (5, "ftp://com/fr/"), (6, "http://notcom/de/"), (7, "http://a.com/de/#f"), (7, "http://a.com/de/#f"), (8, "://"), (9, "http://www.bad.net/a/"), (10, "http://bad.net/b"), (None, "http://net.org")]
    rules = spark.createDataFrame(urls.RULES, "host string, path string, verdict string")
    listed = spark.createDataFrame([("bad.net/a",), (None,)], "url string")
    frame = spark.createDataFrame(pages, "page_id long, url string").withColumn("key", F.lit(1)).withColumn("host", F.lit("h"))
    got = sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in urls.url_filter(frame, rules, listed).collect()), key=str)
    assert got == sorted(
        [
            (1, "a.example.org", "/es/x", "example.org/es/", "block"), (2, "example.org", "/en/12", "example.org/en/1", "block"), (3, "", "", None, "allow"), (4, "", "", None, "allow"),
            (5, "com", "/fr/", "com/fr/", "allow"), (6, "notcom", "/de/", None, "allow"), (7, "a.com", "/de/", "com/de/", "block"), (7, "a.com", "/de/", "com/de/", "block"), (8, "", "", None, "allow"),
            (9, "www.bad.net", "/a/", None, "block"), (10, "bad.net", "/b", None, "allow"), (None, "net.org", "", None, "allow"),
        ],
        key=str,
    )
    assert urls.url_filter(frame.limit(0), rules, listed).count() == 0
    assert {r.verdict for r in urls.url_filter(frame, rules.limit(0), listed.limit(0)).collect()} == {"allow"}
