"""LM scoring by masked pseudo-likelihood.

A bidirectional window network predicts every word of a document from the REACH words on either side; the sum of the
log-probabilities scores the document. Words are hashed to VOCABULARY buckets. The hidden layer is the tanh of the
position-scaled sum of the neighbours' vectors; the output is a softmax over classes of buckets and one within the
class. Classes hold buckets of neighbouring frequency. A word has the share of its bucket's probability that it has
of the bucket's words, by exact counts of all words (64-bit hashes).

Counts come from every word of every document. The network is trained in numpy, in one pass over the corpus: rows are
dealt by a hash of (text, doc_id) into groups of about WORDS_A_COPY words, each of which trains a copy from the same
beginning on every word of each of its documents, in order of that hash. The copies are averaged, weighted by the
words that they saw. Groups depend on the rows alone, so the result doesn't depend on files or partitions. What is
gathered is one copy of the parameters for each group, so it grows with the corpus; they are summed block by block,
FAN_IN at a time, so no task and not the driver gets more than a bounded part. The averaged parameters have a fixed size and are broadcast for scoring. The table of
word counts grows with the vocabulary: the HEAD most frequent words are broadcast, one for each slot of their leading
bits, all others are joined.

Null and empty texts have no words: score 0 and a null mean. A null doc_id stays null. Repeated rows get equal
scores, but for the rounding of 32-bit floats in blocks (0.001 a word). A text of one word is predicted from the padding alone. Very long texts are scored whole, in blocks. Extra
columns are not carried. On an empty table the network keeps its beginning.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbweave.llm.shingles import U, blocks
from orbweave.plans.shared import materialize, splittable_join

CLASSES, IN_CLASS, HIDDEN, REACH = 64, 64, 24, 2
VOCABULARY = CLASSES * IN_CLASS
BATCH, RATE = 1024, 0.6
#: Words that train a copy, about; copies that are summed at once.
WORDS_A_COPY, FAN_IN = 4_000_000, 256
#: Words that are held between two rounds of training steps, about.
HELD = 1 << 16
#: Parameters are summed in blocks of so many.
PART = 8192
SEED = 20240311
#: Logits whose exponentials are taken as they are: sums of IN_CLASS of them stay within 32-bit floats.
FAR = 60
#: Words that are scored at once.
AT_ONCE = 1 << 12
#: Words whose counts are broadcast for scoring, and distinct words that a task counts before it sends them on.
HEAD, COUNTED = 1 << 18, 1 << 20
#: Leading bits of a word that tell its slot in the table of broadcast counts.
SLOT_BITS = 20

OFFSETS = [*range(-REACH, 0), *range(1, REACH + 1)]


@dataclass
class Network:
    """All parameters are views of one flat float32 array; biases are the last rows of the outputs' matrices."""

    flat: np.ndarray

    def __post_init__(self):
        at = 0
        for name, shape in SHAPES.items():
            n = int(np.prod(shape))
            setattr(self, name, self.flat[at : at + n].reshape(shape))
            at += n
        self.of_class, self.class_bias = self.upper[:HIDDEN], self.upper[HIDDEN]
        self.of_member, self.member_bias = self.lower[:, :HIDDEN], self.lower[:, HIDDEN]

    def hidden(self, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For rows of neighbours' places (VOCABULARY is padding): the neighbours' vectors, and the layer with a last column of ones."""
        seen = self.vector.take(near.T, 0)
        total = np.einsum("knh,kh->nh", seen, self.scale)
        total += self.bias
        out = np.ones((len(near), HIDDEN + 1), np.float32)
        out[:, :HIDDEN] = np.tanh(total, out=total)
        return seen, out

    def log_probability(self, near: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Log-probability of each place (class * IN_CLASS + member) given its neighbours."""
        order, group, some = _by_class(place)
        _, h = self.hidden(near[order])
        own = _log_softmax_at(h @ self.upper, group)
        x = np.empty((len(place), IN_CLASS), np.float32)
        for c, i, j in some:
            np.dot(h[i:j], self.lower[c], out=x[i:j])
        own += _log_softmax_at(x, place[order] % IN_CLASS)
        out = np.empty(len(place), np.float32)
        out[order] = own
        return out

    def step(self, near: np.ndarray, place: np.ndarray, rate: float) -> None:
        """One step of stochastic gradient ascent."""
        n, rate = len(place), np.float32(rate)
        order, group, some = _by_class(place)
        near, row, each = near[order], np.arange(n), np.ones(n, np.float32)
        seen, h = self.hidden(near)
        error = _minus_softmax(h @ self.upper)
        error[row, group] += 1
        back = error @ self.of_class.T
        self.upper += rate / np.float32(n) * (h.T @ error)
        error = np.empty((n, IN_CLASS), np.float32)
        for c, i, j in some:
            np.dot(h[i:j], self.lower[c], out=error[i:j])
        error = _minus_softmax(error)
        error[row, place[order] % IN_CLASS] += 1
        more, change = np.empty((n, HIDDEN), np.float32), np.zeros(self.lower.shape, np.float32)
        size = np.zeros(CLASSES, np.float32)
        for c, i, j in some:
            size[c] = j - i
            np.dot(error[i:j], self.of_member[c].T, out=more[i:j])
        error *= (rate / size[group])[:, None]
        for c, i, j in some:
            np.dot(h[i:j].T, error[i:j], out=change[c])
        back += more
        self.lower += change
        h = h[:, :HIDDEN]
        back *= 1 - h * h
        self.bias += rate / np.float32(n) * (each @ back)
        change = back * (self.scale * (rate / np.float32(8)))[:, None]
        self.scale += rate / np.float32(n) * np.einsum("knh,nh->kh", seen, back)
        # The four neighbours of a word at once: gradients of equal vectors are summed first, two columns as one complex number.
        flat = near.T.ravel()
        by = np.argsort(flat.astype(np.uint16), kind="stable")
        node, change = flat[by], change.reshape(-1, HIDDEN).take(by, 0)
        first = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
        self.vector[node[first]] += np.add.reduceat(change.view(np.complex64), first).view(np.float32)


SHAPES = {
    "vector": (VOCABULARY + 1, HIDDEN), "scale": (len(OFFSETS), HIDDEN), "bias": (HIDDEN,),
    "upper": (HIDDEN + 1, CLASSES), "lower": (CLASSES, HIDDEN + 1, IN_CLASS),
}
SIZE = sum(int(np.prod(s)) for s in SHAPES.values())


def _by_class(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, int]]]:
    """An order of the rows in which each class is a slice, the classes in it, and (class, begin, end) of each that occurs."""
    group = place // IN_CLASS
    order = np.argsort(group.astype(np.uint8), kind="stable")
    group = group[order]
    cuts = np.searchsorted(group, np.arange(CLASSES + 1)).tolist()
    return order, group, [(c, cuts[c], cuts[c + 1]) for c in range(CLASSES) if cuts[c] < cuts[c + 1]]


def _bounded(x: np.ndarray) -> np.ndarray:
    """Rows shifted in place to a maximum of 0, unless all exponentials are far from the limits of 32 bits anyway."""
    if not (x.size and -FAR < x.min() and x.max() < FAR):
        x -= x.max(1, keepdims=True)
    return x


def _sums(x: np.ndarray) -> np.ndarray:
    return x @ np.ones(x.shape[1], np.float32)


def _minus_softmax(x: np.ndarray) -> np.ndarray:
    """Row by row, in place."""
    np.exp(_bounded(x), out=x)
    x *= (-1 / _sums(x))[:, None]
    return x


def _log_softmax_at(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The logarithm of each row's softmax at one place; overwrites x."""
    own = _bounded(x)[np.arange(len(x)), at]
    return own - np.log(_sums(np.exp(x, out=x)))


def beginning(counts: np.ndarray, place: np.ndarray) -> Network:
    """Small random vectors; biases give each bucket its share of all words."""
    drawn = np.random.default_rng(SEED).normal(0, 0.1, SIZE).astype(np.float32)
    net = Network(drawn.copy())
    net.of_member[:] = drawn[SIZE - net.lower.size :][: net.of_member.size].reshape(net.of_member.shape)
    net.scale[:] = 1
    net.bias[:] = 0
    share = np.empty(VOCABULARY)
    share[place] = (counts + 0.5) / (counts + 0.5).sum()
    share = share.reshape(CLASSES, IN_CLASS)
    net.class_bias[:] = np.log(share.sum(1))
    net.member_bias[:] = np.log(share / share.sum(1, keepdims=True))
    return net


def buckets(word: np.ndarray) -> np.ndarray:
    return (word >> U(20)).astype(np.int64) % VOCABULARY


def bucket_counts(docs: DataFrame, words: DataFrame | None = None) -> np.ndarray:
    """How many words of all texts fall into each bucket; ``words`` are their counts (see ``word_counts``) where those exist already."""
    bucket = F.shiftrightunsigned("word", 20) % VOCABULARY
    out = np.zeros(VOCABULARY, np.int64)
    counted = word_counts(docs) if words is None else words
    for r in counted.groupBy(bucket.alias("bucket")).agg(F.sum("n").alias("n")).collect():  # VOCABULARY rows
        out[r["bucket"]] = r["n"]
    return out


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n): how often each word hash stands in all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def send() -> pa.RecordBatch:
            word, at = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True)
            n = np.bincount(at, weights=np.concatenate([h[1] for h in held])).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(n)], ["word", "n"])

        held, size = [], 0
        for batch in batches:
            for _, word, _ in blocks(batch.column(0)):
                held.append(np.unique(word, return_counts=True))
                size += len(held[-1][0])
                if size > COUNTED:
                    yield send()
                    held, size = [], 0
        if size:
            yield send()

    counted = docs.select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return materialize(counted, "word-counts")


def places(counts: np.ndarray) -> np.ndarray:
    """Place by bucket: buckets in order of frequency, cut into classes."""
    place = np.empty(VOCABULARY, np.int64)
    place[np.argsort(-counts, kind="stable")] = np.arange(VOCABULARY)
    return place


def neighbours(place: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Places around each word; VOCABULARY beyond the ends of its text."""
    n = len(place)
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    out = np.full((n, len(OFFSETS)), VOCABULARY, np.int64)
    for k, o in enumerate(OFFSETS):
        here = np.arange(max(0, -o), min(n, n - o))
        same = here[text[here] == text[here + o]] if len(here) else here
        out[same, k] = place[same + o]
    return out


def train(docs: DataFrame, net: Network, place: np.ndarray, words: int, words_a_copy: int = WORDS_A_COPY) -> Network:
    """The weighted mean of the copies that groups of documents train; ``words`` is how many there are in all."""
    start, shipped = net.flat, docs.sparkSession.sparkContext.broadcast((net.flat, place))  # SIZE floats
    parts, groups = -(-SIZE // PART), max(1, -(-words // words_a_copy))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat, place = shipped.value
        own, seen, group = Network(flat.copy()), 0, 0
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def steps() -> int:
            p = np.concatenate([h[0] for h in held])
            near = np.concatenate([h[1] for h in held])
            chosen = np.random.default_rng(SEED + len(p)).permutation(len(p))
            for at in range(0, len(chosen), BATCH):
                rows = chosen[at : at + BATCH]
                own.step(near[rows], p[rows], RATE)
            held.clear()
            return len(chosen)

        size = 0
        for batch in batches:
            group = batch.column("group")[0].as_py() if len(batch) else group
            for _, word, bounds in blocks(batch.column("text")):
                p = place[buckets(word)]
                near = neighbours(p, bounds)
                # Cut at ends of texts only, wherever a batch or a block ends.
                for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                    held.append((p[i:j], near[i:j]))
                    size += j - i
                    if size >= HELD:
                        seen, size = seen + steps(), 0
        if size:
            seen += steps()
        if seen:
            weighted = np.pad(own.flat.astype(np.float64) * seen, (0, parts * PART - SIZE)).reshape(parts, PART)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(parts)), pa.array(np.full(parts, group, np.int64)), pa.array(np.full(parts, seen, np.int64)), pa.array([w.tobytes() for w in weighted], pa.binary())], ["part", "group", "seen", "total"])

    def add(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("group")  # one order of sums
        total = sum(np.frombuffer(t.as_buffer(), np.float64) for t in rows.column("total"))
        own = {"part": key[0].as_py(), "group": key[1].as_py(), "seen": sum(rows.column("seen").to_pylist()), "total": total.tobytes()}
        return pa.Table.from_pylist([own], pa.schema([("part", pa.int64()), ("group", pa.int64()), ("seen", pa.int64()), ("total", pa.binary())]))

    schema = "part long, group long, seen long, total binary"
    order = F.xxhash64("text", "doc_id")
    dealt = docs.where("text <> ''").select("text", order.alias("order"), F.pmod(order, F.lit(groups)).cast("int").alias("group"))
    summed = dealt.repartitionById(groups, "group").sortWithinPartitions("order", "text").select("group", "text").mapInArrow(run, schema)
    while True:
        groups = -(-groups // FAN_IN)
        summed = summed.groupBy("part", F.floor(F.col("group") / FAN_IN).alias("to")).applyInArrow(add, schema)
        if groups == 1:
            break
    got = {r["part"]: np.frombuffer(bytes(r["total"]), np.float64) / r["seen"] for r in summed.collect()}  # SIZE floats
    if not got:
        return Network(start)
    return Network(np.concatenate([got[i] for i in range(parts)])[:SIZE].astype(np.float32))


def score(docs: DataFrame, net: Network, place: np.ndarray, counts: np.ndarray | None = None, words: DataFrame | None = None) -> DataFrame:
    """doc_id, n_words, the sum of the words' log-probabilities, and their mean.

    With ``counts`` of buckets and ``words`` (see ``word_counts``), probabilities are those of words, a word that wasn't
    counted being taken as seen once; otherwise they are those of buckets.
    """
    head, share = None, np.zeros(VOCABULARY)
    if words is not None:
        words = words.withColumn("level", F.floor(F.log2(F.col("n").cast("double")) * 16))
        lowest, sum_ = 1 << 20, 0
        for r in sorted(words.groupBy("level").count().collect(), key=lambda r: -r["level"]):  # at most 16 * 63 rows
            sum_ += r["count"]
            if sum_ > HEAD:
                break
            lowest = r["level"]
        head = words.where(F.col("level") >= lowest).select("word", "n").toArrow()  # at most HEAD rows
        share = np.round(-np.log(np.maximum(counts, 1)), 3)
    known, often = (head.column(k).to_numpy() if head else np.zeros(0, np.int64) for k in ("word", "n"))
    order = np.lexsort((known, often))  # the most frequent word of a slot stays; the others are joined
    known, often = known.view(np.uint64)[order], often[order]
    slots, gain = ~(np.arange(1 << SLOT_BITS, dtype=np.uint64) << U(64 - SLOT_BITS)), np.zeros(1 << SLOT_BITS)
    slots[known >> U(64 - SLOT_BITS)] = known
    gain[known >> U(64 - SLOT_BITS)] = np.round(np.log(often.astype(float)), 3)
    shipped = docs.sparkSession.sparkContext.broadcast((net.flat, place, share, slots, gain))
    split = words is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat, place, share, slots, gain = shipped.value
        net, row = Network(flat), TaskContext.get().partitionId() << 40
        for batch in batches:
            sizes, sums, others, other_sizes = [], [], [np.zeros(0, np.uint64)], [np.zeros(1, np.int64)]
            for _, word, bounds in blocks(batch.column("text")):
                bucket = buckets(word)
                p = place[bucket]
                near = neighbours(p, bounds)
                each = [net.log_probability(near[at : at + AT_ONCE], p[at : at + AT_ONCE]) for at in range(0, len(p), AT_ONCE)]
                # Rounded, so that a document's score doesn't depend on what shares its block.
                each = np.round(np.concatenate([np.zeros(0), *each]), 3) + share[bucket]
                if split:
                    at = (word >> U(64 - SLOT_BITS)).astype(np.int64)
                    found = slots[at] == word
                    each += np.where(found, gain[at], 0)
                    others.append(word[~found])
                    other_sizes.append(np.diff(np.concatenate([[0], np.cumsum(~found)])[bounds]))
                total = np.concatenate([[0.0], np.cumsum(each)])
                sizes.append(np.diff(bounds))
                sums.append(np.round(total[bounds[1:]] - total[bounds[:-1]], 3))
            n, s = np.concatenate([np.zeros(0, np.int64), *sizes]), np.concatenate([np.zeros(0), *sums])
            cuts = np.cumsum(np.concatenate(other_sizes)) if split else np.zeros(len(n) + 1)
            rest = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(np.concatenate(others).view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(row + np.arange(len(n))), batch.column("doc_id").cast(pa.int64()), pa.array(n, pa.int64()), pa.array(s, pa.float64()), rest], ["row", "doc_id", "n_words", "s", "rest"])
            row += len(n)

    scored = docs.select("doc_id", "text").mapInArrow(run, "row long, doc_id long, n_words long, s double, rest array<long>")
    if words is not None:
        scored = materialize(scored, "scored")
        more = splittable_join(scored.select("row", F.explode("rest").alias("word")), words.where("n > 1").select("word", "n"), "word")
        more = more.groupBy("row").agg(F.sum(F.round(F.log(F.col("n").cast("double")), 3)).alias("more"))
        scored = scored.drop("rest").join(more, "row", "left").withColumn("s", F.round(F.col("s") + F.coalesce("more", F.lit(0.0)), 3))
    mean = F.when(F.col("n_words") > 0, F.round(F.col("s") / F.col("n_words"), 6))
    return scored.select("doc_id", "n_words", F.col("s").alias("log_likelihood"), mean.alias("mean_log_likelihood"))


def fit(docs: DataFrame, counts: np.ndarray | None = None, words_a_copy: int = WORDS_A_COPY) -> tuple[Network, np.ndarray]:
    counts = bucket_counts(docs) if counts is None else counts
    place = places(counts)
    return train(docs, beginning(counts, place), place, int(counts.sum()), words_a_copy), place


def op4_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    words = word_counts(docs)
    counts = bucket_counts(docs, words)
    net, place = fit(docs, counts)
    return score(docs, net, place, counts, words)
