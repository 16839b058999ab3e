"""N-gram join, line dedup and SpotSigs against brute force."""

import hashlib
import random

import numpy as np
import pytest
import xxhash

from orbweave.llm import line_dedup, ngram_join, shingles, spotsigs

SCHEMA = "doc_id long, text string"
ODD = [(900, None), (901, ""), (902, " \n\t"), (903, "one two"), (904, "One  TWO"), (905, "one two three four five"), (906, "x " * 5000), (907, "x " * 4000)]


def words(r, n):
    return [r.choice("abcdefgh") + str(r.randrange(400)) for _ in range(n)]


def families(seed=1, n=12, copies=8):
    r, rows = random.Random(seed), []
    for f in range(n):
        base = words(r, r.choice([6, 30, 90, 200]))
        for _ in range(copies):
            w = base[:]
            for _ in range(r.randrange(0, max(1, len(w) // 12) + 1)):
                w[r.randrange(len(w))] = f"edit{r.randrange(10**6)}"
            rows.append((len(rows) * 3, " ".join(w)))
        rows.append((len(rows) * 3, " ".join(words(r, 40) + base[: min(len(base), 25)])))
    return rows


def test_gram_sets_equal_plain_sets():
    r = random.Random(2)
    texts = ["", " ", "A b", "a B", "a\tb\x0bc d e f", "é É a b c", "x" * 3000] + [" ".join(words(r, 40)) for _ in range(50)]
    sets = list(shingles.gram_sets(texts, 5))
    plain = []
    for t in texts:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t).split() if "é" not in t.lower() else "".join(c.lower() if "A" <= c <= "Z" else c for c in t).split(" ")
        plain.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    assert [len(s) for s in sets] == [len(p) for p in plain]
    flat, known = {}, {}
    for s, p in zip(sets, plain, strict=True):
        for h in s.tolist():
            flat[h] = flat.get(h, 0) + 1
        for g in p:
            known[g] = known.get(g, 0) + 1
    assert sorted(flat.values()) == sorted(known.values())
    assert np.array_equal(sets[2], sets[3])


def test_trie_finds_what_counting_finds():
    r = np.random.default_rng(3)
    sets = []
    for _ in range(60):
        base = np.unique(r.integers(0, 500, 40).astype(np.uint64))
        for _ in range(4):
            sets.append(np.unique(np.concatenate([r.choice(base, len(base) - r.integers(0, 6), replace=False), r.integers(500, 900, r.integers(0, 5)).astype(np.uint64)])))
    trie = ngram_join.GramTrie()
    for i, s in enumerate(sets):
        trie.add(s, i)
    for p in sets[::17]:
        want = {i: n for i, s in enumerate(sets) if 100 * (n := len(np.intersect1d(p, s))) >= 75 * (len(p) + len(s) - n)}
        assert dict(trie.search(p)) == want


def test_components_equal_brute_force(spark):
    rows = families() + ODD + [(0, families()[0][1])]
    got = sorted(tuple(r) for r in ngram_join.components(spark.createDataFrame(rows, SCHEMA)).collect())
    want = ngram_join.brute_force(rows)
    assert got == sorted((i, *want[i]) for i, _ in rows)
    assert len({c for *_, c in got}) < len(got) - 30


def test_links_are_whole_and_exact(spark):
    rows = families(5, 5, 6)
    members, links, _ = ngram_join.classes_and_links(spark.createDataFrame(rows, SCHEMA))
    sets = dict(zip([i for i, _ in rows], shingles.gram_sets([t for _, t in rows], 5), strict=True))
    for a, b, n in (tuple(x) for x in links.collect()):
        assert n == len(np.intersect1d(sets[a], sets[b])) and 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n)
    assert members.count() == len(rows)


def test_large_group_of_copies(spark):
    r = random.Random(8)
    base, rows = words(r, 120), []
    for i in range(300):
        w = base[:]
        for _ in range(r.randrange(0, 9)):
            w[r.randrange(len(w))] = f"e{r.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, " ".join(words(r, 60) + base[:30])) for i in range(100)]
    got = {x[0]: (x[1], x[2]) for x in ngram_join.components(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == ngram_join.brute_force(rows)


def test_join_without_rows_or_ids(spark):
    assert ngram_join.components(spark.createDataFrame([], SCHEMA)).count() == 0
    got = [tuple(r) for r in ngram_join.components(spark.createDataFrame([(None, "a b c"), (None, "a b c"), (4, "a b c")], SCHEMA)).collect()]
    assert sorted(got, key=str) == [(4, 1, 4), (None, 1, None), (None, 1, None)]
    extra = spark.createDataFrame([(1, "q w", 5, "n")], "doc_id long, text string, label int, rep string")
    assert [tuple(r) for r in ngram_join.components(extra).collect()] == [(1, 1, 1)]


# -- lines -------------------------------------------------------------------------------------------------------------------


def drop_by_hand(rows, tiers=line_dedup.TIERS, variable_share=line_dedup.VARIABLE_SHARE, copies=False):
    """The same rule over dictionaries; a text is told by itself, or with ``copies`` by itself and its doc_id."""
    import re
    from collections import Counter, defaultdict

    def template(line):
        return tuple("<*>" if re.search("[0-9]", w) else w for w in re.split(r"[ \t\r\f]+", line) if w)

    key = lambda d: (d is not None, d or 0)
    owner = {}
    own = lambda d, text: (text, d if copies else None)
    for d, text in rows:
        if text is not None:
            owner[own(d, text)] = min(owner.get(own(d, text), key(d)), key(d))
    where, leaves = defaultdict(list), defaultdict(list)
    for text in sorted(owner, key=owner.get):
        for p, line in enumerate(text[0].split("\n")):
            t = template(line)
            if t and t.count("<*>") < variable_share * len(t):
                where[t].append((text, p))
    texts_of = lambda at: len({x for x, _ in at})
    for t in where:
        leaves[len(t), t[: line_dedup.DEPTH]].append(t)
    shape = {}
    for (size, _), members in leaves.items():
        n = sum(texts_of(where[t]) for t in members)
        if len(members) < 2 or n < line_dedup.LEAF_DOCS:
            continue
        held = Counter()
        for t in members:
            for p in range(line_dedup.DEPTH, size):
                held[p, t[p]] += texts_of(where[t])
        for t in members:
            fixed = tuple((p, t[p]) for p in range(line_dedup.DEPTH, size) if t[p] != "<*>" and held[p, t[p]] >= max(line_dedup.LEAF_DOCS, line_dedup.LEAF_SHARE * n))
            if line_dedup.FIXED_SHARE * (size - line_dedup.DEPTH) <= len(fixed) < size - line_dedup.DEPTH:
                shape[t] = (size, t[: line_dedup.DEPTH], fixed)
    wide = defaultdict(list)
    for t, g in shape.items():
        wide[g] += where[t]
    wide = {g: min(at, key=lambda x: (owner[x[0]], x[1])) for g, at in wide.items() if texts_of(at) >= line_dedup.LEAF_DOCS}
    gone = defaultdict(set)
    for t, at in where.items():
        first = wide.get(shape.get(t))
        if first is None and any(len(t) >= least and texts_of(at) >= docs for least, docs in tiers):
            first = at[0]
        if first is not None:
            for x, p in at:
                if (x, p) != first:
                    gone[x].add(p)
    out = []
    for d, x in rows:
        lost = gone.get(own(d, x), ())
        out.append((d, "\n".join(line for p, line in enumerate(x.split("\n")) if p not in lost) if lost else x, len(lost)))
    return sorted(out, key=str)


def test_lines(spark):
    r = random.Random(4)
    shared, short = " ".join(words(r, 55)).translate(str.maketrans("0123456789", "qrstuvwxyz")), "Contact us at number {} for more details today"
    names = ["Ann", "Bob", "Cy", "Di", "Ed", "Flo", "Gus"]
    rows = []
    for i in range(40):
        lines = [" ".join("w" + c for c in r.choices("abcdefghijklmnopq", k=30)) for _ in range(6)]
        if i % 4 == 0:
            lines.insert(r.randrange(6), shared)
        if i % 3 == 0:
            lines.insert(0, short.format(i))
        if i % 2 == 0:
            lines.append(f"This was posted by {names[i % 7]} in our section about garden and home")
        if i in (5, 6):
            lines.append("a passage of more than twenty words that stands in two documents only and that is long enough to be taken for a shared one")
        lines.append("the same lead but " + " ".join(r.choices("abcdefgh", k=6)))
        rows.append((i, "\n".join(lines)))
    rows += [(100 + i, rows[1][1]) for i in range(4)] + [(None, None), (None, "a b"), (200, ""), (201, "\n\n"), (202, "z " * 20_000), (1, rows[1][1])]
    rows += [(300 + i, f"Yes it is\nonly {'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}x{'uvwxyz'[i % 6]} here\n1 2 3 4 5 a") for i in range(110)]
    got = sorted((tuple(x) for x in line_dedup.drop_recurring_lines(spark.createDataFrame(rows, SCHEMA)).select("doc_id", "text", "lines_dropped").collect()), key=str)
    assert got == drop_by_hand(rows)
    texts = {d: t for d, t, _ in got}
    assert sum(shared in (t or "") for t in texts.values()) == 1 and shared in texts[0]
    assert "posted by Ann" in texts[0] and not any("posted by" in (texts[i] or "") for i in range(2, 40)), "a name without a digit is a variable field"
    assert "passage of more than" in texts[5] and "passage of more than" not in texts[6]
    assert texts[100] == texts[1], "copies of a whole text are treated alike"
    assert sum("Yes it is" in (t or "") for t in texts.values()) == 1 and all("same lead" in texts[i] for i in range(40))
    assert sum("1 2 3 4 5 a" in texts[300 + i] for i in range(110)) == 1, "mostly variable, but a template"


@pytest.mark.parametrize("how", [{}, {"tiers": ((1, 2),)}, {"variable_share": 0.5}, {"copies": True}, {"tiers": ((1, 2),), "copies": True}])
def test_what_recurs_is_a_parameter(spark, how):
    rows = [(i, f"{i} {i + 1} {i * 7} total x\n{i} {i + 2}\nown line {'abcdefgh'[i % 8]}{'ijklmno'[i % 7]}{'pqrstuvwxyz'[i % 11]}\n{'a short one' if i in (3, 8) else ''}") for i in range(300)]
    rows += [(1000 + i, "the same text as in all these copies\nof which there are fifty") for i in range(50)]
    got = sorted((tuple(x) for x in line_dedup.drop_recurring_lines(spark.createDataFrame(rows, SCHEMA), **how).select("doc_id", "text", "lines_dropped").collect()), key=str)
    assert got == drop_by_hand(rows, **how)
    texts = {d: t for d, t, _ in got}
    assert sum("total x" in t for t in texts.values()) == (300 if how.get("variable_share") else 1)
    assert all(f"{i} {i + 2}" in texts[i] for i in range(300)), "a row of numbers has no fixed token"
    assert ("a short one" in texts[8]) == ("tiers" not in how) and "a short one" in texts[3]
    assert sum("same text" in t for t in texts.values()) == (1 if how.get("copies") else 50)


def test_lines_without_rows_and_with_clashing_columns(spark):
    assert line_dedup.drop_recurring_lines(spark.createDataFrame([], SCHEMA)).count() == 0
    line = " ".join("abcdefghijklmnopqrstuvwxyz")
    odd = spark.createDataFrame([(i, line + f"\n{i}", i, i + 1, i + 2, i + 3, 9) for i in range(2)], "doc_id long, text string, d int, h int, gone int, `drop` int, lines_dropped int")
    got = line_dedup.drop_recurring_lines(odd)
    assert got.columns == ["doc_id", "text", "d", "h", "gone", "drop", "lines_dropped"]
    assert sorted(tuple(r) for r in got.collect()) == [(0, line + "\n0", 0, 1, 2, 3, 0), (1, "1", 1, 2, 3, 4, 1)]


# -- SpotSigs ------------------------------------------------------------------------------------------------------------------


def by_hand(rows):
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, 42 if r[1] is None else signed(xxhash.xxh64_intdigest(r[1].encode(), seed=42)), r[1] or ""))
    out = []
    for i, (d, t) in enumerate(rows):
        t, following = t or "", rows[(i + 1) % len(rows)][1] or ""
        half = len(t) // 2
        e = t[: len(t) - half] + following[:half]
        a, b, c = map(spotsigs.signatures, (t, e, following))
        like = lambda x, y: float(not x and not y) if not x or not y else len(set(x) & set(y)) / len(set(x) | set(y))
        out.append((d, len(t), hashlib.sha256(e.encode()).hexdigest(), spotsigs.to_hex(a), spotsigs.to_hex(b), like(a, b), like(a, c)))
    return sorted(out, key=str)


@pytest.mark.parametrize("rows", [
    [], [(1, "a b")], [(None, None), (None, "x"), (5, "the cat sat on mat"), (5, "the cat sat on mat"), (5, "abc"), (900, "")], [(7, "q"), (7, "r"), (7, "the s t u v")],
    [(i * i * 1000, f"the word{i} follows it and is \U0001f642 there") for i in range(60)], [(-(2**62), "the a1 b1"), (2**62, "the a2 b2"), (0, "x" * 50_000)],
])
def test_fingerprints_of_edited_texts(spark, rows):
    got = sorted((tuple(r) for r in spotsigs.edit_fingerprints(spark.createDataFrame(rows, SCHEMA), 8).collect()), key=str)
    assert got == by_hand(rows)


def test_spot_signatures_and_pruning():
    assert len(spotsigs.signatures("The quick brown fox is a red animal")) == 3
    assert spotsigs.signatures("") == [] and len(spotsigs.signatures("nothing here")) == 1
    r = random.Random(1)
    for _ in range(300):
        a, b = (sorted(r.sample(range(60), r.randrange(1, 50))) for _ in range(2))
        j = len(set(a) & set(b)) / len(set(a) | set(b))
        assert spotsigs.jaccard(a, b) == j and spotsigs.jaccard(a, b, 0.6) == (j if j >= 0.6 else 0)
    sigs = spotsigs.signatures("the quick brown fox is a red animal")
    assert sigs == sorted(hashlib.md5(s.encode()).hexdigest()[:16] for s in ("the quick brown", "is red animal", "a red animal"))
    assert spotsigs.from_hex(spotsigs.to_hex(sigs)) == sigs


def test_ranges_hold_outliers_and_hot_ids(spark):
    rows = [(i, f"the w{i} x{i}") for i in range(4000)] + [(2**62, "a b"), (-(2**62), "c d")] + [(7, f"the hot{i} text{i}") for i in range(3000)] + [(None, f"the lost{i} t{i}") for i in range(2000)]
    random.Random(1).shuffle(rows)
    dealt = spotsigs.with_next(spark.createDataFrame(rows, SCHEMA), 8).rdd.glom().map(len).collect()
    assert len(dealt) == 8 and max(dealt) < 2500 and sum(dealt) <= len(rows) + 8
    got = spotsigs.edit_fingerprints(spark.createDataFrame(rows, SCHEMA), 8)
    assert sorted(r[0] for r in got.where("doc_id IS NOT NULL").select("doc_id").collect()) == sorted(i for i, _ in rows if i is not None) and got.count() == len(rows)


def test_similar_equals_brute_force(spark):
    r = random.Random(9)
    rows = []
    for f in range(10):
        base = [x for _ in range(25) for x in (r.choice(["the", "of", "is", "and"]), *words(r, 2))]
        for _ in range(6):
            w = base[:]
            for _ in range(r.randrange(6)):
                w[r.randrange(len(w))] = f"new{r.randrange(999)}"
            rows.append((len(rows), " ".join(w)))
    rows += [(500, None), (501, ""), (502, rows[0][1])]
    comp, links = spotsigs.similar(spark.createDataFrame(rows, SCHEMA))
    sets = {i: spotsigs.signatures(t) for i, t in rows}
    label = {i: i for i in sets}

    def root(i):
        return i if label[i] == i else root(label[i])

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and spotsigs.jaccard(sets[a], sets[b]) >= 0.75:
                x, y = root(a), root(b)
                label[max(x, y)] = min(x, y)
    assert {x[0]: x[1] for x in comp.collect()} == {i: root(i) for i in sets}
    assert all(spotsigs.jaccard(sets[a], sets[b]) == j for a, b, j in links.collect())


def test_similar_across_length_partitions_in_a_large_group(spark):
    r = random.Random(3)
    spots = sorted({"the " + " ".join(words(r, 2)) for _ in range(3000)}, key=lambda s: hashlib.md5(s.encode()).hexdigest())
    common, own = spots[:8], spots[8:]  # all documents share the signatures that come first
    r.shuffle(own)
    rows = []
    for f in range(60):
        mine = own[f * 40 : f * 40 + 40]
        rows += [(f, " ".join(common + mine[:12])), (100 + f, " ".join(common + mine[20:34])), (200 + f, " ".join(common + mine[:16]))]
    sets = {i: spotsigs.signatures(t) for i, t in rows}
    assert {len(s) for s in sets.values()} == {20, 22, 24}
    want = {(a, b) for a in sets for b in sets if a < b and spotsigs.jaccard(sets[a], sets[b]) >= spotsigs.THRESHOLD}
    assert len(want) == 60
    comp, links = spotsigs.similar(spark.createDataFrame(rows, SCHEMA))
    assert {(x["a"], x["b"]) for x in links.collect()} == want
    assert {x["doc_id"]: x["component_id"] for x in comp.collect()} == {i: i - 200 if i >= 200 else i for i in sets}


def test_no_query_is_its_own_oracle():
    from orbweave.llm import registry

    assert all(isinstance(sql, str) for sql in registry.ORACLES.values())


def all_links(sets):
    """Pairs of ids (a < b) whose sets link, with the overlap."""
    ids, out = sorted(i for i in sets if len(sets[i])), {}
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            n = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
            if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
                out[a, b] = n
    return out


def test_all_links_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 16)
    r = random.Random(12)
    base, rows = words(r, 100), families(6, 6, 7) + ODD
    for i in range(120):  # near copies, many of which link with many others
        w = base[:]
        for _ in range(r.randrange(0, 4)):
            w[r.randrange(len(w))] = f"e{r.randrange(10**6)}"
        rows.append((2000 + i, " ".join(w)))
    rows += [(3000, rows[0][1]), (None, rows[0][1]), (None, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    sets = dict(zip([i for i, _ in rows if i is not None], shingles.gram_sets([t for i, t in rows if i is not None], 5), strict=True))
    want = all_links(sets)
    members, links, _ = ngram_join.classes_and_links(docs)
    reps = {x["rep"] for x in members.collect()}
    assert sorted(tuple(x) for x in links.collect()) == sorted((a, b, n) for (a, b), n in want.items() if a in reps and b in reps)
    got = ngram_join.components_and_links(docs).collect()
    ends = [i for pair in want for i in pair]
    assert sorted((x["doc_id"], x["n_links"]) for x in got if x["doc_id"] is not None) == sorted((i, ends.count(i)) for i in sets)
    assert [x["n_links"] for x in got if x["doc_id"] is None] == [0, 0] and len(got) == len(rows)


def test_repeated_ids_are_one_node_whatever_the_order(spark):
    r = random.Random(21)
    a, b = words(r, 60), words(r, 60)
    near = lambda w: " ".join([*w[:-1], "end"])
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, near(a)), (3, near(b)), (1, None), (None, near(a))]
    want = ngram_join.brute_force([x for x in rows if x[0]])
    for order in (rows, rows[::-1]):
        got = ngram_join.components_and_links(spark.createDataFrame(order, SCHEMA)).collect()
        assert {x["doc_id"]: x["component_id"] for x in got if x["doc_id"]} == {i: c for i, (_, c) in want.items()}
        assert sorted((x["doc_id"] or 0, x["n_shingles"], x["n_links"]) for x in got) == [(0, 56, 0), (1, 0, 1), (1, 56, 1), (1, 56, 1), *sorted([(2, 56, int(want[2][1] == 1)), (3, 56, int(want[3][1] == 1))])]


def test_sketches_blocks_and_small_tries_lose_nothing(spark, monkeypatch):
    rows = families(31, 8, 8)
    docs = spark.createDataFrame(rows, SCHEMA)
    want = sorted(tuple(x) for x in ngram_join.components_and_links(docs).collect())
    monkeypatch.setattr(ngram_join, "HOT", 2)
    monkeypatch.setattr(ngram_join, "TRIE_SETS", 2)
    monkeypatch.setattr(ngram_join, "levels", lambda table: np.where(table > 1, np.log2(np.maximum(table, 1)).astype(np.uint8) + 1, 0).astype(np.uint8))
    assert sorted(tuple(x) for x in ngram_join.components_and_links(docs, sketched=False).collect()) == want
    all_first = lambda sets: docs.sparkSession.createDataFrame([], "a long, b long")
    monkeypatch.setattr(ngram_join, "neighbour_pairs", all_first)  # so that every link comes from the prefixes
    assert sorted(tuple(x) for x in ngram_join.components_and_links(docs).collect()) == want
    members, n = ngram_join.brute_force(rows), {i: len(x) for i, x in zip([i for i, _ in rows], shingles.gram_sets([t for _, t in rows], 5), strict=True)}
    assert [(i, n[i], members[i][1]) for i, *_ in want] == [x[:3] for x in want]


def test_spotsigs_compares_few_fingerprints_and_loses_no_link(spark):
    """Of all pairs of sets, those left by their bits hold every link and few others; full bits leave all pairs."""
    r = random.Random(12)
    sets = [sorted({hashlib.md5(f"{i}-{j}".encode()).hexdigest()[: spotsigs.DIGITS] for j in range(r.randint(1, 120))}) for i in range(20)]
    sets += [sorted({*s[: len(s) - r.randint(0, len(s) // 6)], hashlib.md5(str(i).encode()).hexdigest()[: spotsigs.DIGITS]}) for i, s in enumerate(sets)]
    sets += [sorted({hashlib.md5(f"{i}.{j}".encode()).hexdigest()[: spotsigs.DIGITS] for j in range(6000)}) for i in range(2)]
    reps = spark.createDataFrame([(i, spotsigs.to_hex(s), len(s)) for i, s in enumerate(sets)], "doc_id long, fingerprint string, n long")
    every = [(a, b) for a in range(len(sets)) for b in range(a + 1, len(sets))]
    left = {tuple(x) for x in spotsigs.possible(spark.createDataFrame(every, "a long, b long"), reps).collect()}
    want = {(a, b) for a, b in every if spotsigs.jaccard(sets[a], sets[b]) >= spotsigs.THRESHOLD}
    assert want and want <= left and len(left) < len(want) + 10 and (40, 41) in left


def test_common_signatures_make_no_pairs_of_fingerprints(spark, monkeypatch):
    """Sets of common signatures, whose hashes come first, and of others of their own: pairs by common ones would be all of them."""
    r = random.Random(4)
    spots = sorted({"the " + " ".join(words(r, 2)) for _ in range(9000)}, key=lambda s: hashlib.md5(s.encode()).hexdigest())
    common, own = spots[:100], spots[100:]
    r.shuffle(own)
    rows = [(f, " ".join(r.sample(common, 12) + own[f * 28 : f * 28 + 28])) for f in range(300)]
    rows += [(300 + f, rows[f][1] + " " + own[8990 - 100 - f]) for f in range(20)]
    seen, possible = [], spotsigs.possible

    def counted(pairs, reps):
        seen.append(pairs.count())
        return possible(pairs, reps)

    monkeypatch.setattr(spotsigs, "possible", counted)
    comp, links = spotsigs.similar(spark.createDataFrame(rows, SCHEMA))
    assert {(x["a"], x["b"]) for x in links.collect()} == {(f, 300 + f) for f in range(20)}
    assert {x["doc_id"]: x["component_id"] for x in comp.collect()} == {i: i - 300 if i >= 300 else i for i in range(320)}
    assert sum(seen) < 8000, seen
