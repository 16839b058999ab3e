"""WARC, quotation linking, mixing and the pipeline."""

import hashlib
import io
import math
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from orbweave.llm import bpe, chat, mixing, warc

PAGES = "page_id long, url string, html string"


def plan_by_hand(rows):
    first = {}
    for p, _, h in rows:
        h = h or ""
        if len(h.encode()) >= 1000 and p is not None:
            first[h] = max(first.get(h, p), p)
    out = []
    for p, _, h in rows:
        raw = (h or "").encode()
        f = first.get(h or "")
        revisit = f is not None and p != f
        out.append((p, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", f if revisit else None))
    return sorted(out, key=str)


def test_warc_round_trip(spark, monkeypatch):
    big = "<p>é</p>" * 200
    rows = [(1, "http://a/ b\r\nX: y", big), (7, None, big), (3, "u", big), (7, "again", big), (4, "u", "small"), (5, "u", "small"), (6, "u", None), (8, "u", ""), (None, "u", big), (None, None, None), (9, "u", "z" * 300_000)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], PAGES + ", payload string")
    monkeypatch.setattr(warc, "FILE_BYTES", 500)
    manifest = warc.write_archives(warc.plan_records(pages))
    back = warc.read_archives(manifest, with_payload=True).collect()
    got = sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in back), key=str)
    assert got == plan_by_hand(rows)
    assert {r["page_id"]: r["payload"] for r in back if r["record_type"] == "response"}[9] == b"z" * 300_000
    assert all(not r["payload"] for r in back if r["record_type"] == "revisit")
    assert manifest.agg(F.sum("records")).first()[0] == len(rows)
    none = warc.write_archives(warc.plan_records(spark.createDataFrame([], PAGES)))
    assert warc.read_archives(none).count() == 0


def test_reader_goes_on_over_small_chunks_and_sees_faults(monkeypatch):
    monkeypatch.setattr(warc, "CHUNK", 7)
    digest = hashlib.sha1(b"abc").hexdigest()
    one = warc.page_record(1, "u", b"abc", digest, 3, None, False)
    two = warc.page_record(2, "u", b"", digest, 3, 1, True)
    found = [warc.read_page(h, b, at) for at, h, b in warc.Reader(io.BytesIO(one + two))]
    assert [f[:5] for f in found] == [(1, 3, digest, "response", None), (2, 3, digest, "revisit", 1)]
    assert [at for at, *_ in warc.Reader(io.BytesIO(one + two))] == [0, len(one)]
    plain = zlib.decompress(one, 31)
    z = lambda raw: (c := zlib.compressobj(6, zlib.DEFLATED, 31)).compress(raw) + c.flush()
    n = int(next(iter(warc.Reader(io.BytesIO(one))))[1]["content-length"])
    framed = plain.replace(b"Content-Length: %d\r\n\r\nHTTP" % n, b"Content-Length: %d\r\n\r\nHTTP" % (n - 2))
    assert framed != plain
    for bad in (one[:-9], z(plain.replace(b"abc", b"abd")), z(plain + b"more"), z(plain[:-3]), z(b"HTTP/1.1\r\n\r\n"), z(framed)):
        with pytest.raises((warc.WarcError, zlib.error)):
            list(warc.Reader(io.BytesIO(bad)))


def test_passages():
    text = "Hi\nOn Monday, A wrote:\n> > deep one\n> > deep two\n> shallow\nanswer\n>no space"
    assert chat.passages(text) == [(0, "Hi"), (2, "deep one\ndeep two"), (1, "shallow"), (0, "answer"), (1, "no space")]
    assert chat.unquoted(text) == "Hi\nanswer"
    assert chat.passages(None) == [] and chat.unquoted("") == "" and chat.keys(" \n") == []
    assert chat.quote("b", "> x\na") == ">> x\n> a\nb" and chat.quote(None, None) == ""
    for own in ("> mine\nown line\n", "\n\n  > x", " > y\n z", ">", "", "\n"):
        mail = chat.quote(own, chat.quote("before\n> as such\n", chat.quote("\n> first", None)))
        assert chat.unquoted(mail) == own
        assert [t for level, t in chat.passages(mail) if level == 1] == ["before\n> as such\n"] and [t for level, t in chat.passages(mail) if level == 2] == ["\n> first"]


def test_links_to_another_conversation_than_the_first(spark):
    rows = [(1, 3, "u", "> the passage\nanswer"), (1, 5, "u", "the passage"), (2, 0, "u", "the passage"), (3, 1, "u", "the passage"), (3, 0, "u", "> the passage\nwhat")]
    got = {(x["conv_id"], x["turn"]): (x["parent_conv"], x["parent_turn"]) for x in chat.link_quotes(spark.createDataFrame(rows, MESSAGES)).collect()}
    assert got[1, 3] == (2, 0) and got[3, 0] == (1, 5)


def test_mail_keeps_own_lines_and_clashing_columns(spark):
    rows = [(1, 0, "u", "> a quoted line of mine\nown line\n", "x"), (1, 1, "u", "\nanswer\n", "y"), (1, 2, "u", " > third", "z"), (None, 0, "u", "> n", "w"), (2, 0, None, None, "v")]
    mail = chat.as_mail(spark.createDataFrame(rows, MESSAGES + ", q1 string"))
    got = {x["q1"]: x for x in chat.link_quotes(mail).collect()}
    assert {k: x["text"] for k, x in got.items()} == {q: t or "" for *_, t, q in rows}
    assert [got[k]["parent_turn"] for k in "xyzwv"] == [None, 0, 1, None, None]
    assert chat.link_quotes(chat.as_mail(spark.createDataFrame([], MESSAGES))).count() == 0


MESSAGES = "conv_id long, turn long, role string, text string"


def test_links(spark):
    long = "a passage that is long enough to be matched by itself"
    rows = [
        (1, 0, "user", "What is it?"), (1, 1, "bot", "> What is  IT?\nA thing.\n" + long), (1, 2, "user", ">> What is it?\n> A thing.\n> " + long + "\nThanks"), (1, 3, "bot", "> " + long + "\nPartly"),
        (1, 4, "user", "> never said\nHm"), (2, 0, "user", "What is it?"), (2, 1, "bot", "> What is it?\nOther."), (3, 5, "user", "> Other.\nFrom elsewhere"), (3, 6, "user", None), (None, 1, "user", "> x\ny"), (4, None, "user", "z"), (2, 2, "x", "> Other.\n" + "w " * 20_000),
    ]
    got = {(r["conv_id"], r["turn"]): r for r in chat.link_quotes(spark.createDataFrame(rows, MESSAGES)).collect()}
    parent = {k: (r["parent_conv"], r["parent_turn"]) for k, r in got.items() if r["parent_turn"] is not None}
    assert parent == {(1, 1): (1, 0), (1, 2): (1, 1), (1, 3): (1, 1), (2, 1): (2, 0), (3, 5): (2, 1), (2, 2): (2, 1)}
    assert {k: (r["thread"], r["depth"]) for k, r in got.items() if k[0] == 1} == {(1, 0): (0, 0), (1, 1): (0, 1), (1, 2): (0, 2), (1, 3): (0, 2), (1, 4): (4, 0)}
    assert got[1, 2]["text"] == "Thanks" and got[3, 6]["text"] == "" and got[None, 1]["text"] == "y" and len(got) == len(rows)
    assert chat.link_quotes(spark.createDataFrame([], MESSAGES)).count() == 0


def test_mail_is_linked_again(spark):
    r = random.Random(1)
    rows = [(c, t, "user", " ".join(r.choices("abcdefghij", k=12)) if c else "all the same") for c in range(6) for t in range(9)] + [(7, t, "u", f"hot {t}") for t in range(70)]
    df = spark.createDataFrame(rows, MESSAGES)
    got = {(x["conv_id"], x["turn"]): x for x in chat.link_quotes(chat.as_mail(df)).collect()}
    assert len(got) == len(rows)
    for c, t, _, text in rows:
        x = got[c, t]
        assert (x["text"], x["parent_turn"], x["thread"], x["depth"]) == (text, t - 1 if t else None, 0, t)


def test_thresholds_are_poisson():
    for rate in (0.0, 0.3, 2.5, 8.0):
        t = mixing.thresholds(rate)
        assert t[0] == pytest.approx(math.exp(-rate)) and t[-1] == pytest.approx(1, abs=1e-9)
        assert sum(1 - x for x in t) == pytest.approx(rate, abs=1e-6)


def test_mix(spark):
    rows = [(i, f"t{i}", "en", "big" if i % 10 else "rare", 1) for i in range(4000)] + [(5000, None, None, None, None), (None, "", "en", "big", 0), (3, "t3", "en", "big", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, copy long")
    out = mixing.mix(docs, {"big": 1.0, "rare": 3.0, mixing.REST: 0.0}, 4000).collect()
    n = Counter(r["source"] for r in out)
    assert n["big"] == pytest.approx(1000, rel=0.15) and n["rare"] == pytest.approx(3000, rel=0.1) and None not in n
    by_doc = Counter(r["doc_id"] for r in out)
    again = Counter(r["doc_id"] for r in mixing.mix(docs.repartition(7), {"big": 1.0, "rare": 3.0, mixing.REST: 0.0}, 4000).collect())
    assert by_doc == again
    assert max(by_doc.values()) > 8, "rates above the step are reached in parts"
    assert mixing.mix(docs.limit(0)).count() == 0
    weights = {"big": 1.0, mixing.REST: 1.0}
    means = mixing.rates(docs, weights)
    want = Counter()
    for i, _, _, s, _ in rows:
        g, total = (s if s == "big" else mixing.REST), 0
        parts = max(1, math.ceil(means[g] / mixing.STEP))
        for p in range(parts):
            u = int(hashlib.md5(f"{'' if i is None else i}:{p}".encode()).hexdigest()[:8], 16) / 2**32
            total += sum(c <= u for c in mixing.thresholds(means[g] / parts))
        want[i] += total
    assert Counter(r["doc_id"] for r in mixing.mix(docs, weights).collect()) == Counter({k: v for k, v in want.items() if v})


def test_rows_without_ids_draw_one_by_one(spark):
    """Their source has its target, and they spread over the partitions; rows that share an id spread with one count."""
    weights = {"a": 1.0, "b": 1.0, mixing.REST: 0.0}
    rows = [(None, "same text", "en", "a", 1)] * 3000 + [(7, f"text {i % 5}", "en", "b", 1) for i in range(3000)] + [(10_000 + i, "x", "en", "a", 1) for i in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = mixing.mix(docs, weights, 8000)
    assert out.columns == [*docs.columns, "copy"]
    got = Counter(r["source"] for r in out.collect())
    assert abs(got["a"] - 4000) < 300 and got["b"] % 3000 == 0
    sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < 1.5 * sum(sizes) / len(sizes)
    alone = Counter(r["doc_id"] for r in mixing.mix(docs.where("doc_id >= 10000"), {"a": 1.0, mixing.REST: 0.0}).collect())
    means = mixing.rates(docs.where("doc_id >= 10000"), {"a": 1.0, mixing.REST: 0.0})
    assert means == {"a": 1.0}
    table = mixing.thresholds(1.0)
    want = {i: sum(c <= int(hashlib.md5(f"{i}:0".encode()).hexdigest()[:8], 16) / 2**32 for c in table) for i in range(10_000, 11_000)}
    assert alone == Counter({i: n for i, n in want.items() if n})


def test_pipeline(spark):
    import corpus_pipeline as cp
    from orbweave.llm import ngram_join

    r = random.Random(2)
    en, de = "the of and to in is that it was for".split(), "der die und den von das mit ist des im".split()
    rows = []
    for i in range(60):
        w = [r.choice(en if i % 2 else de) + r.choice(["", "abc", "xyz", "kl"]) + r.choice(["", "m", "n"]) for _ in range(80)]
        rows.append((i, "\n".join(" ".join(w[j : j + 20]) for j in range(0, 80, 20)), "en" if i % 2 else "de", f"src{i % 3}", 0))
    rows += [(100 + i, rows[5][1] + f" extra{i}", "en", "src0", 0) for i in range(5)] + [(200, "12 34", None, "src0", 5), (201, None, None, None, None)]
    docs, kept = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), []
    for name, stage in cp.STAGES:
        docs = stage(spark, docs, "")
        if name != "byte_bpe":
            assert docs.columns == cp.COLUMNS
        docs = docs.cache()
        kept.append({x["doc_id"]: x for x in docs.collect()})
    assert 200 not in kept[0] and 201 not in kept[0] and {*range(60)} <= set(kept[0])
    assert set(kept[1]) <= set(kept[0]) and {*range(60)} <= set(kept[1])
    want = ngram_join.brute_force([(i, x["text"]) for i, x in kept[1].items()])
    assert set(kept[2]) == {i for i, (_, c) in want.items() if c == i} and len({*range(100, 105)} & set(kept[2])) <= 1
    assert set(kept[3]) <= set(kept[2]) and set(kept[4]) == set(kept[3])
    for i, x in kept[4].items():
        assert bpe.load().decode(x["ids"]).decode() == kept[3][i]["text"]


def test_near_duplicates_keep_rows_without_ids_and_other_texts(spark):
    import corpus_pipeline as cp

    long = " ".join(f"w{i}" for i in range(60))
    rows = [(1, long), (2, long + " end"), (None, "p q r"), (None, "s t u"), (None, "s t u"), (5, "a b c d e f"), (5, "g h i j k l"), (5, "a b c d e f")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(x["doc_id"], x["text"]) for x in cp.near_duplicates(spark, docs, "").collect()]
    assert sorted(got, key=str) == sorted({(i, t) for i, t in rows if i != 2}, key=str)


def test_near_duplicates_judge_each_text_of_a_shared_id(spark):
    import corpus_pipeline as cp

    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(3, a), (5, a + " end"), (5, b), (6, c), (7, b + " end"), (7, a), (9, c + " end"), (9, c + " end")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted((x["doc_id"], x["text"]) for x in cp.near_duplicates(spark, docs, "").collect())
    assert got == [(3, a), (5, b), (6, c)]


def test_stages_on_odd_tables(spark):
    import corpus_pipeline as cp

    schema = "doc_id long, text string, lang string, source string, n_chars long, component_id int, label int, h int, d int, copy int"
    text = " ".join("word" + c for c in "abcdefghijklmnopqrstuvwxyz")
    rows = [(None, None, None, None, None), (None, "some text of its own", "en", "s", 1), (1, "", "en", "s", 0), (2, text, "en", "s", 1), (2, text, "en", "s", 1), (3, text + "\n", "en", None, 1), (4, "w " * 30_000, "en", "s", 1)]
    odd = spark.createDataFrame([(*r, 1, 2, 3, 4, 5) for r in rows], schema)
    none = spark.createDataFrame([], schema)
    for name, stage in cp.STAGES:
        got = stage(spark, odd, "")
        assert stage(spark, none, "").count() == 0
        if name != "byte_bpe":
            assert got.columns == cp.COLUMNS
        ids = [x["doc_id"] for x in got.collect()]
        if name == "line_dedup":
            assert len(ids) == 6 and 3 not in ids, "its only line stands in two texts"
        if name == "ngram_jaccard":
            assert sorted(ids, key=str) == [1, 2, 4, None, None]
        if name == "byte_bpe":
            assert len(ids) == len(rows)
