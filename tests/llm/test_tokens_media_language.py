"""BPE, audio columns, language ID and the language model."""

import hashlib
import random
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest

from orbweave.llm import bpe, langid, lm, media

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [None, "", " ", "\n\n  x", "a" * 30_000, "naïve \U0001f642́ 日本語", "it's 12345 -- <|endoftext|>", "The cat.", "The cat.", "1234 !!"]


def table(spark, texts, more=()):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)] + list(more), SCHEMA)


@pytest.fixture(scope="module")
def tok():
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load().ranks, special_tokens={})


def test_bpe_equals_the_library(tok):
    r = random.Random(3)
    texts = [t or "" for t in ODD] + ["".join(r.choice(["a", "b", "the", "ing", " ", "  ", "\n", "é", "日", "x1", "'s", "--", "\U0001f642"]) for _ in range(r.randint(0, 200))) for _ in range(400)]
    coder = bpe.load()
    packed = list(coder.encode(texts))
    assert [np.frombuffer(p, "<u4").tolist() for p in packed] == [tok.encode_ordinary(t) for t in texts]
    assert [coder.decode(p).decode() for p in packed] == texts


def test_bpe_keeps_few_words(monkeypatch, tok):
    monkeypatch.setattr(bpe, "KEPT_WORDS", 3)  # so tables are begun anew all the time
    monkeypatch.setattr(bpe, "BLOCK_CHARS", 5)
    coder = bpe.MergeReplay(bpe.load().ranks, bpe.load().pattern.pattern)
    texts = ["one two three", "two three four", "w" * 90, "one"]
    assert [np.frombuffer(p, "<u4").tolist() for p in coder.encode(texts)] == [tok.encode_ordinary(t) for t in texts]


def test_bpe_table(spark, tok):
    got = {r["doc_id"]: r for r in bpe.encode_documents(table(spark, ODD, [(None, "x", None, None, None)])).collect()}
    for i, t in enumerate(ODD):
        ids = tok.encode_ordinary(t or "")
        assert got[i]["n_tokens"] == len(ids) and np.frombuffer(got[i]["ids"], "<u4").tolist() == ids
        assert got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    assert got[None]["n_tokens"] == 1
    assert bpe.encode_documents(table(spark, [])).count() == 0


def test_media_round_trip(spark):
    docs = table(spark, ODD, [(None, "x", None, None, None)])
    rows = media.media_features(media.encode_media(docs), with_tensors=True).collect()
    got = {r["doc_id"]: r for r in rows}
    assert len(rows) == len(ODD) + 1
    for i, t in enumerate(ODD):
        raw = (t or "").encode()
        payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        wav = media.to_wav(payload)
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"], r["media_bytes"], r["media_sha256"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(wav), hashlib.sha256(wav).hexdigest())
        t = pa.ipc.open_stream(r["log_mel"]).read_all()
        assert t.schema.field("log_mel").type.shape == [media.WINDOW, media.MELS]
        assert t.column("end_s")[-1].as_py() <= len(payload) / media.RATE + media.FRAME / 12_000
        assert t.schema.field("active").type.shape == [media.WINDOW]
        # The stored tensors hold the frames, from which the feature follows; the last frame reaches the last sample.
        mel, active = media.analyse(payload)
        back, segments = media.frames_of(pa.ipc.open_stream(r["log_mel"]).read_next_batch())
        assert np.array_equal(back, mel.astype(np.float16).astype(np.float32)) and np.array_equal(segments, active)
        assert r["feature"] == media.describe(back, active)
        assert (len(mel) - 1) * media.HOP + media.FRAME >= len(media.resample(np.zeros(len(payload), np.float32)))
    assert got[7]["feature"] == got[8]["feature"] and got[0]["feature"] == got[1]["feature"]
    assert media.media_features(media.encode_media(table(spark, []))).count() == 0


def test_resampling_and_segments():
    t = np.arange(16_000) / 16_000
    x = np.sin(2 * np.pi * 500 * t).astype(np.float32)
    y = media.resample(x)
    assert len(y) == 12_000
    assert np.argmax(np.abs(np.fft.rfft(y))) == 500
    assert np.sqrt((y[200:-200] ** 2).mean()) == pytest.approx(np.sqrt(0.5), rel=0.05)
    k = 7  # one output by hand: phase and input of the polyphase form
    at, phase = k * media.DOWN // media.UP, k * media.DOWN % media.UP
    assert y[k] == pytest.approx(sum(media.PHASES[phase][j] * x[at - j] for j in range(media.TAPS) if at - j >= 0), abs=1e-5)
    db = np.array([0, 0, 5, 9, 5, 5, 0, 0, 5, 5, 0, 0], float)
    assert media.segments(db).tolist() == [[2, 6], [8, 10]]
    assert media.segments(np.zeros(4)).tolist() == []
    assert media.from_wav(media.to_wav(b"abcd")) == b"abcd"
    with pytest.raises(ValueError):
        media.from_wav(b"RIFFxxxxWAVEfmt ")


def test_language_id_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    samples = langid.fit(docs)
    assert all(len(s) <= langid.SAMPLE_BYTES + 1000 for s in samples.values())
    out = langid.identify(docs, samples).withColumn("held", langid.is_held_out("doc_id")).where("held").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in out]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in out)
    assert [r["doc_id"] for r in out if zlib.crc32(str(r["doc_id"]).encode()) % 5] == []


def test_language_id_edges(spark):
    lines = {"en": "the cat sat on the mat and looked at the rain ", "de": "die katze sass auf der matte und sah in den regen "}
    learn = [(i, lines[k] * 3 + str(i), k, "s", 1) for i, k in enumerate(["en", "de"] * 10)]
    learn += [(500, lines["en"], None, "s", 1), (None, lines["de"] * 2, "xx", "s", 1)]
    docs = spark.createDataFrame(learn, SCHEMA)
    samples = langid.fit(docs)
    assert set(samples) == {"en", "de"}
    asked = table(spark, [None, "", "123 ...", lines["de"], lines["en"].upper(), "x" * 200_000, lines["de"]]).withColumnRenamed("n_chars", "lang_pred")
    got = {r["doc_id"]: r for r in langid.identify(asked, samples).collect()}
    assert [got[i]["lang_pred"] for i in range(5)] == ["und", "und", "und", "de", "en"]
    assert all(got[i]["rejected"] and got[i]["score"] == 0 for i in range(3)) and not got[3]["rejected"]
    assert got[3]["score"] == got[6]["score"]
    assert [r["lang_pred"] for r in langid.identify(table(spark, ["abc"]), {}).collect()] == ["und"]
    assert langid.fit(table(spark, [])) == {} and langid.identify(table(spark, []), samples).count() == 0


def slow_features(payload):
    """Frames by the definitions, one output at a time."""
    x = (np.frombuffer(payload, np.uint8).astype(float) - 128) / 128
    taps = media.PHASES.astype(float)
    y = [sum(taps[n * media.DOWN % media.UP][j] * x[n * media.DOWN // media.UP - j] for j in range(media.TAPS) if 0 <= n * media.DOWN // media.UP - j < len(x)) for n in range(len(x) * media.UP // media.DOWN)]
    frames = []
    while not frames or len(frames) * media.HOP + media.FRAME - media.HOP < len(y):
        at = len(frames) * media.HOP
        frames.append([y[i] if i < len(y) else 0.0 for i in range(at, at + media.FRAME)])
    power = [np.abs(np.fft.fft(np.array(f) * media.HANN)[: media.FRAME // 2 + 1]) ** 2 for f in frames]
    db = [10 * np.log10(p.sum() + 1e-6) for p in power]
    level, on, segments = [v - np.mean(db) for v in db], None, []
    for i, v in enumerate([*level, -np.inf]):
        if v > media.LOW_DB and on is None:
            on = i
        elif v <= media.LOW_DB and on is not None:
            if max(level[on:i]) > media.HIGH_DB:
                segments.append([on, i])
            on = None
    return np.array([10 * np.log10(p @ media.BANK + 1e-6) for p in power]), segments


@pytest.mark.parametrize("n", [0, 1, 700, 1700])
def test_features_equal_the_slow_form(n):
    r = random.Random(n)
    payload = media.pad(bytes(r.choices(b"the quick brown fox \xc3\xa9", k=n)))
    mel, segments = media.analyse(payload)
    want, wanted = slow_features(payload)
    assert mel.shape == want.shape and np.abs(mel - want).max() < 0.05 and segments.tolist() == wanted


def test_every_language_is_learned_and_copies_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(langid, "DRAWN", 20)
    alphabet = "abcdefghijklmnopqrst"
    word = lambda r, k: "".join(r.choice(alphabet[k % 17 : k % 17 + 4]) for _ in range(6))
    rows = []
    for k in range(80):
        r = random.Random(k)
        rows += [(len(rows) + j, " ".join(word(r, k) for _ in range(12)), f"l{k:02d}", "s", 1) for j in range(5)]
    rows += [(10_000 + j, " ".join(f"long{j}text" for _ in range(1200)), "only_long", "s", 1) for j in range(40)]
    rows += [(7, "the same text again", "hot", "s", 1)] * 3000
    docs = spark.createDataFrame(rows, SCHEMA)
    samples = langid.fit(docs)
    learnable = {r[2] for r in rows if zlib.crc32(str(r[0]).encode()) % 5}
    assert set(samples) == learnable and {"only_long"} <= set(samples)
    assert samples.get("hot", b"the same text again") == b"the same text again"
    assert len(samples["only_long"]) <= langid.SAMPLE_BYTES + langid.SAMPLE_TEXT


def test_scores_are_log_probabilities():
    counts = np.arange(lm.VOCABULARY)[::-1]
    place = lm.places(counts)
    net = lm.beginning(counts, place)
    near = np.full((lm.VOCABULARY, len(lm.OFFSETS)), 5)
    assert np.exp(net.log_probability(near, np.arange(lm.VOCABULARY))).sum() == pytest.approx(1, abs=1e-3)


def test_training_steps_raise_the_likelihood():
    r = np.random.default_rng(1)
    place = lm.places(np.ones(lm.VOCABULARY))
    net = lm.beginning(np.ones(lm.VOCABULARY), place)
    words = r.integers(0, 4, 4000)
    words[1::2] = (words[::2] + 1) % 4 + 100  # every other word follows from the one before
    near, before = lm.neighbours(words, np.array([0, len(words)])), None
    for _ in range(60):
        at = r.integers(0, len(words), 256)
        before = before if before is not None else net.log_probability(near, words).mean()
        net.step(near[at], words[at], 0.5)
    assert net.log_probability(near, words).mean() > before + 2


def test_neighbours_stop_at_texts():
    near = lm.neighbours(np.array([1, 2, 3, 4]), np.array([0, 3, 3, 4]))
    e = lm.VOCABULARY
    assert near.tolist() == [[e, e, 2, 3], [e, 1, 3, e], [1, 2, e, e], [e, e, e, e]]


def test_lm_table(spark):
    texts = [*ODD, "The cat sat on the mat. " * 40]
    docs = table(spark, texts, [(None, "x", None, None, None)])
    net, place = lm.fit(docs)
    got = {r["doc_id"]: r for r in lm.score(docs, net, place).collect()}
    assert got[0]["n_words"] == 0 and got[0]["log_likelihood"] == 0 and got[0]["mean_log_likelihood"] is None
    assert got[7]["log_likelihood"] == got[8]["log_likelihood"] < 0
    assert got[10]["n_words"] == 240 and len(got) == len(texts) + 1
    counts = lm.bucket_counts(docs)
    assert counts.sum() == sum(r["n_words"] for r in got.values())
    empty = table(spark, [])
    net, place = lm.fit(empty)
    assert lm.score(empty, net, place).count() == 0


def test_every_word_is_trained_on(spark, monkeypatch):
    texts = [f"w{i}" for i in range(40)] + ["a b c", ""]
    seen = []
    monkeypatch.setattr(lm.Network, "step", lambda self, near, place, rate: seen.append(len(place)))

    class Docs:  # runs the function of the partitions here
        sparkSession = spark

        def chained(self, *_):
            return self

        where = select = repartitionById = sortWithinPartitions = chained

        def mapInArrow(self, run, schema):
            batch = pa.RecordBatch.from_arrays([pa.array([0] * len(texts)), pa.array(texts, pa.string())], ["group", "text"])
            self.rows = [b.column("seen")[0].as_py() for b in run([batch.slice(0, 7), batch.slice(7)])]
            return spark.createDataFrame([], schema)

    docs, counts = Docs(), np.ones(lm.VOCABULARY)
    lm.train(docs, lm.beginning(counts, lm.places(counts)), lm.places(counts), 43)
    assert sum(seen) == 43 and docs.rows == [43]


def test_scores_do_not_depend_on_partitions(spark, monkeypatch):
    monkeypatch.setattr(lm, "FAN_IN", 3)
    r = random.Random(5)
    texts = [" ".join(r.choice("abcdefgh") * r.randrange(1, 4) for _ in range(r.randrange(60))) for _ in range(300)] + ["again and again"] * 50
    docs, got = table(spark, texts), []
    for n in (1, 16):
        dealt = docs.repartition(n)
        counts = lm.bucket_counts(dealt)
        net, place = lm.fit(dealt, counts, 700)
        got.append({x["doc_id"]: x["log_likelihood"] for x in lm.score(dealt, net, place, counts, lm.word_counts(dealt)).collect()})
    assert got[0].keys() == got[1].keys() and all(abs(got[0][i] - got[1][i]) <= 0.002 * len(texts[i].split()) + 1e-9 for i in got[0])
    start = lm.beginning(counts, place)
    before = {x["doc_id"]: x["log_likelihood"] for x in lm.score(docs, start, place, counts, lm.word_counts(docs)).collect()}
    assert sum(got[0].values()) > sum(before.values()), "training raises the likelihood"


def slow_log_probability(net, near, place):
    """Of one word, by the definition."""
    h = np.tanh(net.bias.astype(float) + sum(net.vector[node].astype(float) * net.scale[k] for k, node in enumerate(near)))
    c, m = divmod(int(place), lm.IN_CLASS)
    upper, lower = h @ net.of_class + net.class_bias, h @ net.of_member[c] + net.member_bias[c]
    return upper[c] - np.log(np.exp(upper).sum()) + lower[m] - np.log(np.exp(lower).sum())


def test_scores_equal_the_slow_form():
    r = np.random.default_rng(3)
    net = lm.Network(r.normal(0, 0.5, lm.SIZE).astype(np.float32))
    place, near = r.integers(0, lm.VOCABULARY, 200), r.integers(0, lm.VOCABULARY + 1, (200, len(lm.OFFSETS)))
    want = [slow_log_probability(net, near[i], place[i]) for i in range(200)]
    assert np.allclose(net.log_probability(near, place), want, atol=1e-3)


def test_a_step_follows_the_gradient():
    r = np.random.default_rng(4)
    flat = r.normal(0, 0.3, lm.SIZE).astype(np.float32)
    near, place = r.integers(0, lm.VOCABULARY + 1, (1, len(lm.OFFSETS))), r.integers(0, lm.VOCABULARY, 1)
    net = lm.Network(flat.copy())
    net.step(near, place, 1e-2)
    value = lambda f: slow_log_probability(lm.Network(f), near[0], place[0])
    change, at = lm.Network(net.flat - flat), 0
    for name, shape in lm.SHAPES.items():
        size, moved = int(np.prod(shape)), getattr(change, name).ravel()
        rate = 1e-2 / 8 if name == "vector" else 1e-2
        for i in np.argsort(-np.abs(moved))[:3]:
            up, down = flat.astype(float), flat.astype(float)
            up[at + i] += 1e-4
            down[at + i] -= 1e-4
            slope = (value(up) - value(down)) / 2e-4
            assert moved[i] / rate == pytest.approx(slope, rel=0.05, abs=2e-3), name
        at += size


def plain_step(net, near, place, rate):
    """One step with shifted softmaxes, each class and bias by itself, and all gradients of a vector added one by one in order."""

    def softmax(x):
        e = np.exp(x - x.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    n, rate, row = len(place), np.float32(rate), np.arange(len(place))
    group, member = place // lm.IN_CLASS, place % lm.IN_CLASS
    seen = [net.vector[near[:, k]] for k in range(len(lm.OFFSETS))]
    h = np.tanh(sum(seen[k] * net.scale[k] for k in range(len(lm.OFFSETS))) + net.bias)
    error = -softmax(h @ net.of_class + net.class_bias)
    error[row, group] += 1
    back = error @ net.of_class.T
    net.of_class += rate / n * (h.T @ error)
    net.class_bias += rate / n * error.sum(0)
    for c in np.unique(group):
        at = np.flatnonzero(group == c)
        error = -softmax(h[at] @ net.of_member[c] + net.member_bias[c])
        error[np.arange(len(at)), member[at]] += 1
        back[at] += error @ net.of_member[c].T
        net.of_member[c] += rate / len(at) * (h[at].T @ error)
        net.member_bias[c] += rate / len(at) * error.sum(0)
    back *= 1 - h * h
    net.bias += rate / n * back.sum(0)
    for k in range(len(lm.OFFSETS)):
        np.add.at(net.vector, near[:, k], back * net.scale[k] * (rate / 8))
    for k in range(len(lm.OFFSETS)):
        net.scale[k] += rate / n * (seen[k] * back).sum(0)


def test_steps_equal_the_plain_form():
    r = np.random.default_rng(6)
    counts = np.ones(lm.VOCABULARY)
    start = lm.beginning(counts, lm.places(counts)).flat
    net, plain = lm.Network(start.copy()), lm.Network(start.copy())
    for _ in range(40):
        words = (lm.VOCABULARY * r.random(lm.BATCH + 4) ** 3).astype(np.int64)  # few frequent places, many rare ones
        near, place = lm.neighbours(words, np.array([0, 500, len(words)]))[: lm.BATCH], words[: lm.BATCH]
        net.step(near, place, lm.RATE)
        plain_step(plain, near, place, lm.RATE)
    assert np.allclose(net.flat, plain.flat, atol=1e-3) and np.abs(net.flat - start).max() > 0.1


def test_far_logits_are_shifted():
    r = np.random.default_rng(7)
    net = lm.Network(r.normal(0, 8, lm.SIZE).astype(np.float32))
    place, near = r.integers(0, lm.VOCABULARY, 100), r.integers(0, lm.VOCABULARY + 1, (100, len(lm.OFFSETS)))
    assert np.abs(net.hidden(near)[1] @ net.upper).max() > lm.FAR
    want = [slow_log_probability(net, near[i], place[i]) for i in range(100)]
    assert np.allclose(net.log_probability(near, place), want, rtol=1e-4, atol=1e-2)
    plain = lm.Network(net.flat.copy())
    net.step(near, place, 0.1)
    plain_step(plain, near, place, 0.1)
    assert np.isfinite(net.flat).all() and np.allclose(net.flat, plain.flat, atol=1e-2)


def test_words_split_the_probability_of_their_bucket(spark, monkeypatch):
    monkeypatch.setattr(lm, "HEAD", 5)
    texts = [" ".join(f"word{j % 97}" for j in range(i, 3 * i)) for i in range(60)] + [f"rare{i} word1" for i in range(6000)] + [None, ""]
    docs = table(spark, texts, [(None, "word1 word2", None, None, None)] * 2)
    counts, words = lm.bucket_counts(docs), lm.word_counts(docs)
    net, place = lm.fit(docs, counts)
    plain = {r["doc_id"]: r for r in lm.score(docs, net, place).collect()}
    got = lm.score(docs, net, place, counts, words).collect()
    n = {r["word"]: r["n"] for r in words.collect()}
    assert sum(n.values()) == counts.sum() and len(n) > lm.VOCABULARY
    assert len(got) == len(texts) + 2 and sum(r["doc_id"] is None for r in got) == 2
    for r in got:
        text = texts[r["doc_id"]] if r["doc_id"] is not None else "word1 word2"
        word = np.concatenate([np.zeros(0, np.uint64), *(w for _, w, _ in lm.blocks(pa.array([text], pa.string())))])
        more = sum(np.log(n[int(w)] / counts[b]) for w, b in zip(word.view(np.int64), lm.buckets(word), strict=True))
        assert r["log_likelihood"] == pytest.approx(plain[r["doc_id"]]["log_likelihood"] + more, abs=0.002 * len(word) + 0.002)


def test_language_id_equals_plain_compression(spark):
    """All rows against zstandard used directly with the same samples."""
    import zstandard

    r = random.Random(14)
    stock = {"en": "the of and to in is that it was for".split(), "de": "der die und den von das mit ist des im".split(), "fr": "le la les et des en un du une que".split()}
    rows = [(i, " ".join(r.choice(stock[k]) + r.choice(["", "", "ing", "ung", "eau"]) for _ in range(r.randrange(1, 60))), k, "s", 0) for i, k in enumerate(r.choice(list(stock)) for _ in range(150))]
    docs = spark.createDataFrame(rows + [(900 + i, t, None, "s", 0) for i, t in enumerate(ODD)], SCHEMA)
    samples = langid.fit(docs)
    got = {x["doc_id"]: x for x in langid.identify(docs, samples).collect()}

    def size(text, sample):
        content = zstandard.ZstdCompressionDict(sample, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        return len(zstandard.ZstdCompressor(level=langid.LEVEL, dict_data=content, write_content_size=False, write_checksum=False, write_dict_id=False).compress(text.lower().encode()))

    for i, text, *_ in [*rows, *((900 + i, t) for i, t in enumerate(ODD))]:
        if not text or not any(c.isalpha() for c in text):
            assert got[i]["lang_pred"] == "und" and got[i]["score"] == 0 and got[i]["rejected"]
            continue
        sizes = {k: size(text, s) for k, s in samples.items()}
        order = sorted(sizes, key=lambda k: (sizes[k], k))
        margin = 1 - sizes[order[0]] / sizes[order[1]]
        assert got[i]["lang_pred"] == order[0] and got[i]["margin"] == pytest.approx(margin) and got[i]["rejected"] == (margin < langid.MIN_MARGIN)
        assert got[i]["score"] == pytest.approx(min(1, 0.5 + 2 * margin))
