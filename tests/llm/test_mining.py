"""Hard negatives, collocations and the quality classifier against brute force and held-out rows."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from orbweave.llm import collocations, hard_negatives, quality

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


# -- hard negatives ----------------------------------------------------------------------------------------------------


def mined(rows, anchors, positives=5, negatives=5, low=80, high=100):
    dot = lambda a, b: max(-(2**63) + 1, min(2**63 - 1, sum(x * y for x, y in zip(a, b, strict=False))))
    out = []
    for i, label, q in sorted({(i, k, tuple(q)) for i, k, q in anchors}):
        near = sorted((-dot(q, b), j) for j, other, b in rows if other == label and j != i)[:positives]
        for minus, j in near:
            p = -minus
            fits = sorted((-s, n) for n, other, b in rows if other != label and low * p <= 100 * (s := dot(q, b)) <= high * p)[:negatives]
            out += [(i, j, place + 1, n, p, -s) for place, (s, n) in enumerate(fits)]
    return sorted(out)


def vectors(spark, rows):
    return spark.createDataFrame([(i, k, list(q)) for i, k, q in rows], "id long, label long, q array<long>")


def got(df):
    return sorted(map(tuple, df.collect()))


def cloud(n, dims, labels, seed, spread=60):
    r = np.random.default_rng(seed)
    centres = r.integers(-spread, spread, (9, dims))
    return [(int(i), int(r.integers(labels)), [int(x) for x in centres[r.integers(9)] + r.integers(-9, 10, dims)]) for i in range(n)]


@pytest.mark.parametrize("settings", [{}, {"block_cells": 8 * 40, "leaf": 4}, {"block_cells": 8 * 200, "slice_rows": 7, "leaf": 16}, {"positives": 2, "negatives": 9, "low": 30, "high": 90, "leaf": 2}])
def test_hard_negatives_equal_brute_force(spark, settings):
    rows = cloud(600, 8, 5, 1) + [(i, i % 3, [3] * 8) for i in range(600, 700)]  # a group of equal vectors
    anchors = rows[::20]
    out = hard_negatives.hard_negatives(vectors(spark, rows), vectors(spark, anchors), **settings)
    more = {k: v for k, v in settings.items() if k in ("positives", "negatives", "low", "high")}
    want = mined(rows, anchors, **more)
    assert got(out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")) == want and len(want) > 100


def test_hard_negatives_of_odd_rows(spark):
    big = 1 << 61
    rows = [(1, 0, [2, 3]), (2, 0, [4]), (3, 1, []), (4, 1, [7, 1, 5]), (5, None, [1, 1]), (6, 1, None), (None, 1, [1, 2]), (7, 1, [1, None]), (1, 0, [2, 3]), (8, 0, [big, big]), (9, 1, [big, big, big]), (10, 0, [-big, 1]), (11, 2, [3, 3]), (12, 2, [3, 3])]
    used = [r for r in rows if r[0] is not None and r[1] is not None and r[2] is not None and None not in r[2]]
    df = spark.createDataFrame([(i, k, q, "x", 1) for i, k, q in rows], "id long, label long, q array<long>, place string, anchor_key int")
    assert got(hard_negatives.hard_negatives(df, df, leaf=2)) == mined(used, used)
    assert hard_negatives.hard_negatives(df.limit(0), df.limit(0)).count() == 0
    assert hard_negatives.hard_negatives(df, df.limit(0)).count() == 0
    whole = spark.createDataFrame([([0.1, -0.1],), ([1e30, -1e30],), ([float("nan")],), ([float("inf")],), ([None],), (None,), ([],)], "v array<float>").select(hard_negatives.whole(F.col("v"))).collect()
    assert [r[0] for r in whole] == [[25, -26], [1 << 62, -(1 << 62)], None, None, None, None, []]


def test_ball_tree_passes_over_nodes_outside_the_window():
    r = np.random.default_rng(5)
    x = np.concatenate([r.integers(-5, 6, (200, 6)) + c for c in ((100, 0, 0, 0, 0, 0), (0, 100, 0, 0, 0, 0), (-100, 0, 0, 0, 0, 0), (0, 0, 0, 0, 0, 60))])
    ids, labels = np.arange(800), np.repeat([0, 1], 400)
    tree = hard_negatives.BallTree(ids, labels, x, leaf=16)
    a = np.array([[10, 0, 0, 0, 0, 0]])
    names, best = tree.search(np.array([-1]), np.array([1]), a, np.array([[900, 990]]), np.array([[1040, 1000]]), 3, same=False)
    assert tree.scored < 400
    for w, (lo, hi) in enumerate(((900, 1040), (990, 1000))):
        want = sorted((-int(v @ a[0]), i) for i, v in enumerate(x) if i < 400 and lo <= v @ a[0] <= hi)[:3]
        assert [(-s, n) for s, n in zip(best[0, w].tolist(), names[0, w].tolist(), strict=True)] == want
    lo, hi = hard_negatives.windows(np.array([7, -7, 0, 100, 2**62]), 80, 100)
    assert lo.tolist() == [6, -5, 0, 80, -(-(80 * 2**62) // 100)] and hi.tolist() == [7, -7, 0, 100, 2**62]


# -- collocations ------------------------------------------------------------------------------------------------------


def counted(texts, max_words=3):
    f, n = defaultdict(Counter), Counter()
    for lang, t in texts:
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            w = [x for x in re.split(r"[\x20\x09]", piece) if x]
            n[lang or "und"] += len(w)
            for m in range(1, max_words + 1):
                f[lang or "und"].update(tuple(w[i : i + m]) for i in range(len(w) - m + 1))
    return f, n


def collocated(texts, min_count=10, max_words=3, percent=50, limit=2000):
    f, n = counted(texts, max_words)
    out = []
    for lang, c in f.items():
        cands = {w: a for w, a in c.items() if len(w) > 1 and a >= min_count}
        inner = defaultdict(int)
        for w, a in cands.items():
            for m in range(2, len(w)):
                for i in range(len(w) - m + 1):
                    inner[w[i : i + m]] = max(inner[w[i : i + m]], a)
        kept = []
        for w, a in cands.items():
            if w in inner and 100 * inner[w] >= percent * a:
                continue
            score, _, left, right = min((1_000_000 * a * a // (c[w[:k]] * c[w[k:]]), k, c[w[:k]], c[w[k:]]) for k in range(1, len(w)))
            kept.append((-score, -a, " ".join(w).encode(), a, left, right, score))
        kept.sort()
        out += [(lang, i + 1, p.decode(), a, left, right, n[lang], s) for i, (_, _, p, a, left, right, s) in enumerate(kept[:limit])]
    return sorted(out)


ODD = [None, "", " \t ", ".", "...", "a", "A a A a a a a a a a a a", "é É é É", "x" * 5000, "\x0bone\x0ctwo\rthree four", "a b a b", "naïve 日本語 \U0001f642 naïve 日本語 \U0001f642", "of the", "of the.Of THE\tof  the;of the"]


def talk(seed, n):
    r = random.Random(seed)
    stock = ["new york city", "new york", "of the", "in the end", "San  José", "a b a b a b", "once upon a time"]
    noun = [f"w{i}" for i in range(40)]
    say = lambda: " ".join(r.choice(stock) if r.random() < 0.4 else r.choice(noun) + r.choice(["", "", ".", ",", "\n"]) for _ in range(r.randrange(60)))
    return [(r.choice(["en", "de", None, "und"]), say()) for _ in range(n)]


@pytest.mark.parametrize("settings", [{}, {"slots": 64}, {"min_count": 3, "max_words": 4, "subsumed_percent": 80, "limit": 7}, {"min_count": 2, "max_words": 2}])
def test_collocations_equal_brute_force(spark, monkeypatch, settings):
    """With a roomy sketch, and with one of 64 slots that lets nearly everything through."""
    monkeypatch.setattr(collocations, "BLOCK_BYTES", 4_000)
    monkeypatch.setattr(collocations, "PART_BYTES", 300)
    texts = talk(1, 150) + [("en", t) for t in ODD for _ in range(4)]
    docs = spark.createDataFrame([(i, t, k, "s", i, "x") for i, (k, t) in enumerate(texts)], DOCS + ", phrase string").repartition(5)
    out = collocations.collocations(docs, **settings)
    names = {"min_count": "min_count", "max_words": "max_words", "subsumed_percent": "percent", "limit": "limit"}
    want = collocated(texts, **{names[k]: v for k, v in settings.items() if k in names})
    assert got(out) == want and len(want) > 4
    assert out.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def test_collocations_of_nothing(spark):
    docs = spark.createDataFrame([(1, None, None, None, None), (2, "one two", "en", None, None)], DOCS)
    assert collocations.collocations(docs).count() == 0
    assert collocations.collocations(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        collocations.collocations(docs, min_count=300)


def test_rare_phrases_stay_below_and_none_is_lost(spark):
    texts = talk(4, 120)
    docs = spark.createDataFrame([(i, t, k, "s", i) for i, (k, t) in enumerate(texts)], DOCS)
    f, n = counted(texts)
    want = {(k, len(w), " ".join(w)): a for k, c in f.items() for w, a in c.items() if a >= 10} | {(k, 0, ""): v for k, v in n.items()}
    for slots in (32, 1 << 18):
        assert {(r["lang"], r["words"], r["phrase"]): r["a"] for r in collocations.counted_phrases(docs, slots=slots).collect()} == want
    bits = collocations.frequent_slots(docs.select("lang", "text"), 1 << 18, 10, 3)
    assert 0 < np.unpackbits(bits[0]).sum() <= len(want)  # rare n-grams are sorted out by the sketch, before they are counted as strings


def test_sketch_slots_stop_and_sum():
    sketch = np.zeros(8, np.uint8)
    collocations.add(sketch, np.array([3, 1, 3, 3]), np.array([200, 5, 30, 100]))
    collocations.add(sketch, np.array([1, 3]), np.array([1, 1]))
    assert sketch.tolist() == [0, 6, 0, 255, 0, 0, 0, 0]
    codes, words, pieces = collocations.tokenised(pa.array(["b a. B", None, "a", "c"]))
    assert [words[i].as_py() for i in codes.tolist()] == [b"b", b"a", b"b", b"a", b"c"]
    assert len(set(pieces.tolist())) == 4 and pieces[0] == pieces[1]


# -- quality ------------------------------------------------------------------------------------------------------------


def prose(r, bad):
    w = ["".join(r.choice(["ta", "re", "mo", "li", "é", "zu"]) for _ in range(r.randrange(1, 4))) for _ in range(r.randrange(20, 90))]
    kind = r.randrange(3)
    if bad and kind == 0:
        return " ".join(x.upper() + "!!" for x in w)
    if bad and kind == 1:
        return " | ".join(w)
    if bad:
        return " ".join(x for x in w[:6] for _ in range(9))
    return " ".join(x + ("." if r.random() < 0.1 else "") for x in w).capitalize() + "."


def labelled(spark, n=400, seed=2):
    r = random.Random(seed)
    rows = [(i, prose(r, i % 4 == 0), "en", "s", 0) for i in range(n)]
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame([(i, int(i % 4 != 0)) for i in range(n)], "doc_id long, label int"), rows


def test_quality_of_held_out_rows(spark):
    docs, labels, rows = labelled(spark)
    model = quality.fit(docs, labels)
    scores = {r["doc_id"]: r["score"] for r in quality.score(docs, model).collect()}
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(held) > 50 and all((scores[i] >= quality.GOOD) == (i % 4 != 0) for i in held)
    # The vote, the plain way.
    for i in held[:20]:
        x = next(iter(quality.weights([rows[i][1]])))
        y = model.unit(model.scaled(x, model.idf) @ model.projection)[0]
        near = sorted(((round(float(y @ v), 9), j) for j, v in enumerate(model.vectors)), reverse=True)
        last = near[model.k - 1][0]
        votes = [(c**quality.SHARPNESS * model.votes[j], model.labels[j]) for c, j in near if c >= max(last, 1e-9)]
        assert scores[i] == pytest.approx(sum(v * k for v, k in votes) / sum(v for v, _ in votes), abs=1e-5)


def test_quality_learns_from_a_bounded_sample_of_rows_that_are_not_held_out(spark):
    docs, labels, _ = labelled(spark)
    model = quality.fit(docs, labels, per_class=30)
    assert len(model.vectors) <= 60 and model.prior == pytest.approx(0.75, abs=0.03)
    turned = labels.withColumn("label", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("label")).otherwise(F.col("label")))
    a, b = quality.fit(docs, labels), quality.fit(docs, turned)
    assert np.array_equal(a.labels, b.labels) and np.allclose(a.vectors, b.vectors)


def test_quality_of_odd_rows(spark):
    docs, labels, _ = labelled(spark, 120)
    odd = [None, "", " \n", "x" * 40_000, "ta " * 9000, "naïve 日本語 \U0001f642", "SAME!! TEXT!!", "SAME!! TEXT!!"]
    table = spark.createDataFrame([(None if i == 3 else 1000 + i, t, None, None, None, 0.5) for i, t in enumerate(odd)], DOCS + ", score double")
    model = quality.fit(docs.unionByName(table.drop("score")), labels.union(spark.createDataFrame([(None, 1), (5, None), (1000, 1), (1001, 0)], labels.schema)))
    rows = quality.score(table, model).collect()
    by_text = defaultdict(set)
    for r in rows:
        assert 0 <= r["score"] <= 1
        by_text[r["text"] or ""].add(r["score"])
    assert len(rows) == len(odd) and all(len(s) == 1 for s in by_text.values())
    assert by_text[""] == {round(model.prior, 6)}
    assert quality.score(table.limit(0), model).count() == 0
    none = quality.fit(docs, labels.limit(0))
    assert {r["score"] for r in quality.score(table, none).collect()} == {0.5}
    one = quality.fit(docs, labels.where("label = 1"))
    assert quality.score(docs.limit(3), one).first()["score"] == 1.0


def test_blocks_do_not_change_scores(spark, monkeypatch):
    docs, labels, rows = labelled(spark, 150)
    model = quality.fit(docs, labels)
    texts = [r[1] for r in rows] + ["", None]
    whole = model(texts)
    monkeypatch.setattr(quality, "BLOCK_CHARS", 50)
    assert np.allclose(whole, model(texts), atol=1e-6)
