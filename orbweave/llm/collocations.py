"""Collocations: phrases whose words stand together more often than apart, by merged count-min sketches.

A-Z is lower-cased; ``[.,;:!?\\x0A-\\x0D]`` cut a text into pieces, spaces and tabs a piece into words. f(phrase) counts
all its places within pieces, overlaps included, for each language; n counts the words.

First pass: each task adds the 1- to ``max_words``-grams of its texts to a count-min sketch of ROWS rows of one-byte
slots that stop at 255. Sketches are cut into shards, compressed, shuffled by shard and added; of a sum only one bit a
slot is kept: whether it reaches ``min_count``. An n-gram with a cleared bit in either row is rare for certain; a set
bit may be due to others (an overestimate). Second pass: the n-grams with set bits, counted exactly within a block of
texts, are summed as strings by Spark, so every count is exact and nothing frequent is lost. The number of slots
follows the bytes of text up to MAX_SLOTS; beyond, more rare n-grams survive into the second pass, which stays whole.
The bits (at most ROWS * MAX_SLOTS / 8 bytes, 8 MB) are the only broadcast.

Scores and drops are joins and aggregations over the frequent phrases: a candidate is cut after each word and meets
the counts of both parts; the lowest floor(scale * a^2 / (l * r)), in decimals of 38 digits (exact up to 10^15
places of a phrase), counts. A candidate inside a longer one that has half of its places or more is dropped.
Frequent words are in many cuts, so these joins are ones that adaptive execution can split.

Null texts are empty; a null language is ``und``, together with a language of that name. Texts of any length are whole;
repeated rows count each time. Phrases are ordered by UTF-8 bytes. Extra columns are left behind. An empty table, or
one without candidates, gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orbweave.llm import shingles
from orbweave.plans.shared import drop_table, materialize

#: Rows of the sketch; least and most slots of a row; slots of a shard.
ROWS, MIN_SLOTS, MAX_SLOTS, SHARD = 2, 1 << 18, 1 << 25, 1 << 18
#: Bytes of text that are counted together (a longer text is a block of its own).
BLOCK_BYTES, PART_BYTES = 1 << 21, 1 << 18
#: A language's candidates are ranked in so many groups before the groups' best are ranked together.
SPREAD = 16

U = np.uint64
_GAP, _BREAK = np.zeros(256, bool), np.zeros(256, bool)
_GAP[[32, 9]] = True
_BREAK[[*b".,;:!?", *range(10, 14)]] = True
_INSIDE = ~(_GAP | _BREAK)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_STEP = U(0xD6E8FEB86659FD93)


def _split(raw: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word bytes one after another, the words' lengths, and the piece of each word, for lower-cased texts."""
    inside = _INSIDE[raw]
    step = np.diff(inside.astype(np.int8), prepend=0, append=0)
    cut = np.unique(edges[(edges > 0) & (edges < len(raw))])
    cut = cut[inside[cut] & inside[cut - 1]]  # a text begins right after another one's last word
    start, end = np.flatnonzero(step > 0), np.flatnonzero(step < 0)
    if len(cut):
        start, end = np.sort(np.concatenate([start, cut])), np.sort(np.concatenate([end, cut]))
    breaks = np.flatnonzero(_BREAK[raw])
    piece = np.searchsorted(np.sort(np.concatenate([breaks, edges[:-1]]), kind="stable"), start, "right")
    return raw[inside], end - start, piece


def tokenised(texts: pa.Array) -> tuple[np.ndarray, pa.LargeBinaryArray, np.ndarray]:
    """Codes of all words in order, the distinct words, and the piece of each word; nulls are empty."""
    texts = texts.fill_null("").cast(pa.large_binary())
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = _LOWER[np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]]] if data is not None else np.zeros(0, np.uint8)
    bounds = bounds - bounds[0]
    held, sizes, pieces, base, at = [], [], [], 0, 0
    while at < len(texts):  # parts that fit into a cache
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + PART_BYTES, "right")) - 1)
        chars, size, piece = _split(raw[bounds[at] : bounds[to]], bounds[at : to + 1] - bounds[at])
        held.append(chars), sizes.append(size), pieces.append(piece + base)
        base += int(piece[-1]) + 1 if len(piece) else 0
        at = to
    if not sum(map(len, sizes)):
        return np.zeros(0, np.int64), pa.array([], pa.large_binary()), np.zeros(0, np.int64)
    ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(np.concatenate(sizes), dtype=np.int64)])
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(np.concatenate(held))]).dictionary_encode()
    return words.indices.to_numpy().astype(np.int64), words.dictionary.cast(pa.large_binary()), np.concatenate(pieces)


def ngrams(codes: np.ndarray, pieces: np.ndarray, distinct: int, max_words: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For 1 to ``max_words`` words: the distinct n-grams (a row of codes each) and their counts."""
    counts = np.bincount(codes, minlength=distinct)
    rows = np.arange(distinct)[:, None]
    yield rows, counts
    name = codes  # of the n-gram that begins at each word; -1 where its piece ends too early
    for m in range(2, max_words + 1):
        if len(codes) < m:
            return
        fits = pieces[m - 1 :] == pieces[: len(pieces) - m + 1]
        key = name[: len(fits)][fits] * distinct + codes[m - 1 :][fits]
        if m < max_words:
            distinct_keys, name_of, counts = np.unique(key, return_inverse=True, return_counts=True)
            name = np.full(len(fits), -1)
            name[fits] = name_of
        else:
            distinct_keys, counts = np.unique(key, return_counts=True)
        rows = np.column_stack([rows[distinct_keys // distinct], distinct_keys % distinct])
        yield rows, counts


def slots_of(rows: np.ndarray, hashes: np.ndarray, language: int, slots: int) -> list[np.ndarray]:
    """The slot of each n-gram in each row of the sketch."""
    h = np.full(len(rows), U(language & (1 << 64) - 1))
    for column in rows.T:
        h = shingles.mix(h * _STEP + hashes[column])
    return [((h >> U(32 * i)) & U(slots - 1)).astype(np.int64) for i in range(ROWS)]


def add(sketch: np.ndarray, slots: np.ndarray, counts: np.ndarray) -> None:
    """Add counts to one-byte slots that stop at 255."""
    order = np.argsort(slots, kind="stable")
    slots, counts = slots[order], counts[order]
    first = np.flatnonzero(np.diff(slots, prepend=-1))
    if len(first):
        slots, total = slots[first], np.add.reduceat(counts, first)
        sketch[slots] = np.minimum(total + sketch[slots], 255)


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[str, pa.Array]]:
    """(language, texts) of at most BLOCK_BYTES or one text."""
    lang = batch.column("lang").fill_null("und")
    for k in pc.unique(lang).to_pylist():
        texts = batch.column("text").filter(pc.equal(lang, k)).fill_null("")
        ends = np.concatenate([[0], np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))])
        at = 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + BLOCK_BYTES, "right")) - 1)
            yield k, texts.slice(at, to - at)
            at = to


def _hashes(words: pa.LargeBinaryArray) -> np.ndarray:
    """A 64-bit hash of each word."""
    return np.concatenate([h for _, h, _ in shingles.blocks(words.cast(pa.large_string()))] or [np.zeros(0, np.uint64)])


def _language(lang: str) -> int:
    h = 0xCBF29CE484222325
    for b in lang.encode("utf-8", "surrogatepass"):
        h = (h ^ b) * 0x100000001B3 & (1 << 64) - 1
    return h


def frequent_slots(docs: DataFrame, slots: int, min_count: int, max_words: int) -> np.ndarray:
    """ROWS rows of bits (packed): slots whose merged count reaches ``min_count``."""
    shard = min(SHARD, slots)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, used = np.zeros((ROWS, slots), np.uint8), False
        for batch in batches:
            for lang, texts in _blocks(batch):
                codes, words, pieces = tokenised(texts)
                hashes, language = _hashes(words), _language(lang)
                for rows, counts in ngrams(codes, pieces, len(words), max_words):
                    used = used or len(rows) > 0
                    for i, at in enumerate(slots_of(rows, hashes, language, slots)):
                        add(sketch[i], at, counts)
            pa.default_memory_pool().release_unused()
        press = zstandard.ZstdCompressor(level=1)
        for i in range(ROWS if used else 0):
            for at in range(0, slots, shard):
                part = sketch[i, at : at + shard]
                if part.any():
                    yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([at // shard], pa.int32()), pa.array([press.compress(part.tobytes())], pa.binary())], ["row", "shard", "counts"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total = None, np.zeros(shard, np.int32)
        out = lambda: pa.RecordBatch.from_arrays([pa.array([at[0]], pa.int32()), pa.array([at[1]], pa.int32()), pa.array([np.packbits(total >= min_count).tobytes()], pa.binary())], ["row", "shard", "bits"])
        for batch in batches:
            for row, part, counts in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if (row, part) != at:
                    if at:
                        yield out()
                    at, total = (row, part), np.zeros(shard, np.int32)
                total = np.minimum(total + np.frombuffer(zstandard.decompress(counts), np.uint8), 255)
        if at:
            yield out()

    # A byte holds counts up to 255, so a slot that stops there passes every threshold below.
    sketches = docs.mapInArrow(count, "row int, shard int, counts binary")
    merged = sketches.repartition("row", "shard").sortWithinPartitions("row", "shard").mapInArrow(merge, "row int, shard int, bits binary")
    bits = np.zeros((ROWS, slots // 8), np.uint8)
    for r in merged.collect():  # one bit a slot
        bits[r["row"], r["shard"] * shard // 8 : (r["shard"] + 1) * shard // 8] = np.frombuffer(r["bits"], np.uint8)
    return bits


def counted_phrases(docs: DataFrame, min_count: int = 10, max_words: int = 3, slots: int | None = None) -> DataFrame:
    """(lang, words, phrase, a): exact counts of all n-grams with at least ``min_count``; words 0 holds all words of a language."""
    if not 1 <= min_count <= 255:
        raise ValueError("min_count must be from 1 to 255, as slots stop there")
    spark = docs.sparkSession
    docs = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    if slots is None:
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        slots = min(MAX_SLOTS, max(MIN_SLOTS, 1 << (size // 4).bit_length()))
    bits = spark.sparkContext.broadcast(frequent_slots(docs, slots, min_count, max_words))  # at most 8 MB

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = bits.value
        names = ["lang", "words", "phrase", "a"]
        for batch in batches:
            for lang, texts in _blocks(batch):
                codes, words, pieces = tokenised(texts)
                if not len(codes):
                    continue
                yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([0], pa.int32()), pa.array([""]), pa.array([len(codes)], pa.int64())], names)
                hashes, language, strings = _hashes(words), _language(lang), words.cast(pa.large_string())
                for rows, counts in ngrams(codes, pieces, len(words), max_words):
                    alive = np.ones(len(rows), bool)
                    for i, at in enumerate(slots_of(rows, hashes, language, slots)):
                        alive &= (table[i, at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
                    kept = np.flatnonzero(alive)
                    for some in np.split(kept, range(1 << 16, len(kept), 1 << 16)):
                        if len(some):
                            parts = [strings.take(pa.array(rows[some, j])) for j in range(rows.shape[1])]
                            phrase = pc.binary_join_element_wise(*parts, pa.scalar(" ", pa.large_string())) if len(parts) > 1 else parts[0]
                            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some)), pa.array(np.full(len(some), rows.shape[1], np.int32)), phrase.cast(pa.string()), pa.array(counts[some].astype(np.int64))], names)
            pa.default_memory_pool().release_unused()

    found = docs.mapInArrow(count, "lang string, words int, phrase string, a long")
    return found.groupBy("lang", "words", "phrase").agg(F.sum("a").alias("a")).where((F.col("a") >= min_count) | (F.col("words") == 0))


def collocations(docs: DataFrame, min_count: int = 10, max_words: int = 3, subsumed_percent: int = 50, limit: int = 2000, scale: int = 1_000_000, slots: int | None = None) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best ``limit`` phrases of 2 to ``max_words`` words."""
    counted = materialize(counted_phrases(docs, min_count, max_words, slots), "phrases")
    candidates = counted.where("words >= 2")
    part = lambda at, size: F.array_join(F.slice("w", at, size), " ")
    split = candidates.withColumn("w", F.split("phrase", " "))
    cuts = split.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    sides = cuts.select("lang", "phrase", "a", "k", F.explode(F.array(F.struct(F.lit("l").alias("side"), part(F.lit(1), F.col("k")).alias("part")), F.struct(F.lit("r").alias("side"), part(F.col("k") + 1, F.col("words") - F.col("k")).alias("part")))).alias("s"))
    sides = sides.select("lang", "phrase", "a", "k", "s.side", F.struct("lang", "s.part").alias("key"), F.xxhash64("lang", "s.part").alias("h"))
    known = counted.where("words >= 1").select(F.struct("lang", F.col("phrase").alias("part")).alias("key"), F.xxhash64("lang", "phrase").alias("h"), F.col("a").alias("f"))
    # Both sides are exchanged by this join alone, so the rows of a frequent word can be split.
    met = sides.join(known, ["key", "h"])
    both = met.groupBy("lang", "phrase", "a", "k").agg(F.max(F.when(F.col("side") == "l", F.col("f"))).alias("l"), F.max(F.when(F.col("side") == "r", F.col("f"))).alias("r"))
    big = lambda c: F.col(c).cast("decimal(19,0)")
    square = (big("a") * big("a")).cast("decimal(38,0)") * F.lit(scale).cast("decimal(10,0)")
    both = both.withColumn("top", square.cast("decimal(38,0)")).withColumn("under", (big("l") * big("r")).cast("decimal(38,0)"))
    scored = both.withColumn("score", F.expr("top div under"))
    lowest = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    # Shorter phrases within a candidate, with its count.
    inside = split.where("words > 2").select("lang", "a", "w", F.explode(F.sequence(F.lit(2), F.col("words") - 1)).alias("size"), "words")
    inside = inside.select("lang", "a", "w", "size", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("size") + 1)).alias("at"))
    longest = inside.groupBy("lang", part(F.col("at"), F.col("size")).alias("phrase")).agg(F.max("a").alias("longer"))
    left = lowest.join(longest, ["lang", "phrase"], "left")
    left = left.where(F.col("longer").isNull() | (100 * F.col("longer").cast("decimal(25,0)") < subsumed_percent * F.col("a").cast("decimal(25,0)")))
    best = [F.desc("cut.score"), F.desc("a"), F.asc("phrase")]
    some = F.row_number().over(Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(SPREAD))).orderBy(*best))
    left = left.withColumn("some", some).where(F.col("some") <= limit).drop("some")  # so a language's last ranking sees SPREAD * limit rows
    ranked = left.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best))).where(F.col("rank") <= limit)
    total = counted.where("words = 0").select("lang", F.col("a").alias("n"))
    out = ranked.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "cut.l", "cut.r", "n", F.col("cut.score").cast("long").alias("score"))
    out = materialize(out, "collocations")  # at most ``limit`` rows a language
    drop_table(counted)
    return out


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = """
WITH p AS (SELECT doc_id, coalesce(lang, 'und') lang, row_number() OVER () doc, coalesce(text, '') t FROM documents),
s AS (SELECT lang, doc, unnest(string_split_regex(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?' || chr(10) || chr(11) || chr(12) || chr(13) || ']')) piece FROM p),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[ ' || chr(9) || ']'), lambda x: x <> '') w FROM s),
g AS (SELECT lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) phrase FROM w, range(1, 4) r(m) WHERE len(w) >= m),
f AS MATERIALIZED (SELECT lang, m, phrase, count(*)::HUGEINT a FROM g GROUP BY lang, m, phrase HAVING count(*) >= 10),
t AS (SELECT lang, sum(len(w)) n FROM w GROUP BY lang),
c AS MATERIALIZED (SELECT *, string_split(phrase, ' ') w FROM f WHERE m >= 2),
u AS MATERIALIZED (SELECT lang, phrase, a, k, array_to_string(w[1:k], ' ') lp, array_to_string(w[k + 1:], ' ') rp FROM (SELECT *, unnest(range(1, m)) k FROM c)),
k AS (SELECT u.lang, u.phrase, u.a, k, l.a l, r.a r, 1000000 * u.a * u.a // (l.a * r.a) score FROM u JOIN f l ON l.lang = u.lang AND l.phrase = u.lp JOIN f r ON r.lang = u.lang AND r.phrase = u.rp),
b AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
x AS (SELECT lang, phrase, max(a) longer FROM (SELECT lang, array_to_string(w[1:2], ' ') phrase, a FROM c WHERE m = 3 UNION ALL SELECT lang, array_to_string(w[2:3], ' '), a FROM c WHERE m = 3) GROUP BY lang, phrase),
o AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, b.a DESC, b.phrase) rank FROM b LEFT JOIN x USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 50 * b.a)
SELECT lang, rank::BIGINT "rank", phrase, a::BIGINT a, l::BIGINT l, r::BIGINT r, n::BIGINT n, score::BIGINT score FROM o JOIN t USING (lang) WHERE rank <= 2000
"""
