"""Text quality by voting of the nearest labelled documents in a latent-semantic space.

Terms of a text: the shapes of its tokens (runs of upper case, other letters, digits and each punctuation mark), pairs
of consecutive shapes, tokens that repeat the one before, lengths, and hashed words. A text's weights are the square
roots of its terms' shares, by inverse document frequency; shapes and words are each brought to a fixed length. A
singular value decomposition of the labelled sample gives the latent space. Every document's vector is compared with
all labelled vectors by exact cosines, in blocks; the votes of the K nearest (all that tie with the K-th) are weighted
by similarity and by how many labelled rows of that class a sampled one stands for.

The classifier is fitted on a bounded sample: at most PER_CLASS labelled rows for each of the two classes, drawn by the
hash of doc_id among rows that aren't held out; copies of one text count once. What is broadcast is at most
2 * PER_CLASS vectors of DIMENSIONS numbers and one projection of BUCKETS rows. Class sizes are counted over all
labelled rows. Everything else covers every document and its whole text.

A score is from 0 to 1, higher where label 1 is likelier. A null text is empty; an empty text is near nothing and gets
the share of label 1 (0.5 without any labelled row). Rows with a null doc_id or null label aren't learned from; of
conflicting labels of one doc_id each counts. Equal texts have equal scores. Extra columns of ``docs`` are kept,
``score`` is replaced. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbweave.llm.langid import is_held_out
from orbweave.llm.shingles import mix

#: Labelled rows of a class that are drawn; latent dimensions; neighbours that vote.
PER_CLASS, DIMENSIONS, K = 2048, 48, 25
#: Buckets of shape terms and of words, and the weight of words against shapes.
SHAPES, WORDS, WORD_WEIGHT = 2048, 2048, 0.3
BUCKETS = SHAPES + WORDS
#: Votes weigh by this power of the cosine.
SHARPNESS = 8
#: Characters that are worked on at once (a longer text is a block of its own), and documents compared at once.
BLOCK_CHARS, BLOCK_DOCS = 1 << 18, 256
#: From this score on a document is of good quality.
GOOD = 0.3

U = np.uint64
#: Character classes: space, upper case, other letters (and all beyond the table), digits, other symbols, then each ASCII mark.
SPACE, UPPER, LETTER, DIGIT, SYMBOL, MARK = 0, 1, 2, 3, 4, 5
_KNOWN = 0x3000


def _class_of(c: str) -> int:
    if c.isspace():
        return SPACE
    if c.isalpha():
        return UPPER if c.isupper() else LETTER
    if c.isdigit():
        return DIGIT
    return MARK + ord(c) - 33 if 33 <= ord(c) < 127 else SYMBOL


_CLASS = np.array([_class_of(chr(i)) for i in range(_KNOWN)] + [LETTER], np.uint8)
_rng = np.random.default_rng(11)
_OF_CLASS = _rng.integers(1, 1 << 62, 256, dtype=np.uint64)
_BASE, _INVERSE = U(0x9E3779B97F4A7C15 | 1), U(pow(0x9E3779B97F4A7C15 | 1, -1, 1 << 64))


def _folded(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of ``values[starts[i]:ends[i]]`` for each i."""
    n = len(values)
    power = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n, _BASE)]))
    back = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n, _INVERSE)]))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * power[:n])])
    return mix((total[ends] - total[starts]) * back[starts] + (ends - starts).astype(np.uint64))


def _terms(points: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, bucket) of every term of the texts ``points[bounds[i]:bounds[i + 1]]``."""
    kind = _CLASS[np.minimum(points, _KNOWN)]
    edge = np.zeros(len(points) + 1, bool)
    edge[bounds] = True
    inside = kind != SPACE
    begins = inside & (edge[:-1] | ~np.concatenate([[False], inside[:-1]]))
    ends = inside & (edge[1:] | ~np.concatenate([inside[1:], [False]]))
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    doc = np.searchsorted(bounds, start, "right") - 1
    token = _folded(points.astype(np.uint64) + U(1), start, end)
    # A shape: the token's characters where their class changes.
    change = np.concatenate([[True], kind[1:] != kind[:-1]]) | begins
    change &= inside
    at = np.concatenate([[0], np.cumsum(change)])
    shape = _folded(_OF_CLASS[kind[change]], at[start], at[end])
    same_doc = doc[1:] == doc[:-1]
    pair = mix(shape[:-1] * U(3) + shape[1:] * U(7) + U(1))[same_doc]
    again = (token[1:] == token[:-1])[same_doc]
    size = np.minimum(np.log2(end - start).astype(np.int64), 12).astype(np.uint64)
    buckets = [shape % U(SHAPES), pair % U(SHAPES), mix(again.astype(np.uint64) + U(101)) % U(SHAPES), mix(size + U(201)) % U(SHAPES), U(SHAPES) + token % U(WORDS)]
    after = doc[1:][same_doc]
    return np.concatenate([doc, after, after, doc, doc]), np.concatenate(buckets).astype(np.int64)


def weights(texts: list[str | None]) -> Iterator[np.ndarray]:
    """Blocks of rows (one for each text in order) of square roots of shares: shapes, then words."""
    at = 0
    while at < len(texts):
        raw, size = [], 0
        while at < len(texts) and len(raw) < BLOCK_DOCS and (not raw or size + len(texts[at] or "") <= BLOCK_CHARS):
            raw.append(np.frombuffer((texts[at] or "").encode("utf-32-le", "surrogatepass"), np.uint32))
            size += len(raw[-1])
            at += 1
        bounds = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
        doc, bucket = _terms(np.concatenate(raw), bounds)
        counts = np.bincount(doc * BUCKETS + bucket, minlength=len(raw) * BUCKETS).reshape(len(raw), BUCKETS).astype(float)
        for lo, hi in ((0, SHAPES), (SHAPES, BUCKETS)):
            counts[:, lo:hi] = np.sqrt(counts[:, lo:hi] / np.maximum(counts[:, lo:hi].sum(1, keepdims=True), 1))
        yield counts


class Neighbours:
    """Labelled vectors, and what brings a text to their space."""

    def __init__(self, idf: np.ndarray, projection: np.ndarray, vectors: np.ndarray, labels: np.ndarray, votes: np.ndarray, prior: float, k: int = K):
        self.idf, self.projection, self.vectors, self.labels, self.votes, self.prior, self.k = idf, projection, vectors, labels, votes, prior, k

    @staticmethod
    def scaled(x: np.ndarray, idf: np.ndarray) -> np.ndarray:
        x = x * idf
        for lo, hi, length in ((0, SHAPES, 1.0), (SHAPES, BUCKETS, WORD_WEIGHT)):
            norm = np.sqrt((x[:, lo:hi] ** 2).sum(1, keepdims=True))
            x[:, lo:hi] *= length / np.where(norm > 0, norm, 1)
        return x

    @classmethod
    def fit(cls, x: np.ndarray, labels: np.ndarray, votes: np.ndarray, prior: float, dimensions: int = DIMENSIONS, k: int = K) -> Neighbours:
        """From rows of weights; ``votes`` is how many labelled rows each stands for."""
        idf = np.log((1 + len(x)) / (1 + (x > 0).sum(0))) + 1
        x = cls.scaled(x, idf)
        # The leading right singular vectors, by subspace iteration from a fixed start.
        q = np.linalg.qr(np.random.default_rng(7).standard_normal((BUCKETS, min(dimensions + 16, BUCKETS))))[0]
        for _ in range(6):
            q = np.linalg.qr(x.T @ (x @ q))[0]
        _, _, v = np.linalg.svd(x @ q, full_matrices=False)
        projection = (q @ v.T)[:, :dimensions]
        return cls(idf, projection, cls.unit(x @ projection), labels.astype(float), votes.astype(float), prior, k)

    @staticmethod
    def unit(x: np.ndarray) -> np.ndarray:
        norm = np.sqrt((x**2).sum(1, keepdims=True))
        return x / np.where(norm > 0, norm, 1)

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        out = []
        for x in weights(texts):
            if not len(self.vectors):
                out.append(np.full(len(x), self.prior))
                continue
            y = self.unit(self.scaled(x, self.idf) @ self.projection)
            near = np.round(y @ self.vectors.T, 9)  # so equal texts have equal ties, whatever block they are in
            k = min(self.k, near.shape[1])
            last = np.partition(near, near.shape[1] - k, axis=1)[:, near.shape[1] - k]
            vote = np.where(near >= np.maximum(last, 1e-9)[:, None], near, 0.0) ** SHARPNESS * self.votes
            total = vote.sum(1)
            out.append(np.round(np.where(total > 0, (vote @ self.labels) / np.where(total > 0, total, 1), self.prior), 6))
        return np.concatenate(out) if out else np.zeros(0)


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, k: int = K) -> Neighbours:
    """From ``docs`` (doc_id, text) and ``labels`` (doc_id, label), rows that aren't held out."""
    learn = labels.select("doc_id", (F.col("label") == 1).cast("int").alias("label")).where(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & ~is_held_out("doc_id")).distinct()
    counts = {r["label"]: r["n"] for r in learn.groupBy("label").agg(F.count("*").alias("n")).collect()}  # two rows
    drawn = None
    for c in sorted(counts):
        some = learn.where(F.col("label") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        drawn = some if drawn is None else drawn.unionByName(some)
    prior = counts.get(1, 0) / sum(counts.values()) if counts else 0.5
    empty = Neighbours(np.ones(BUCKETS), np.zeros((BUCKETS, 1)), np.zeros((0, 1)), np.zeros(0), np.zeros(0), prior, k)
    if drawn is None:
        return empty

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # A few hundred distinct terms a text: of each its bucket and weight.
            rows = [(np.flatnonzero(r), r[r > 0]) for block in weights(batch.column("text").to_pylist()) for r in block]
            yield pa.RecordBatch.from_arrays([batch.column("h"), batch.column("label"), pa.array([r[0].astype(np.int16) for r in rows], pa.list_(pa.int16())), pa.array([r[1].astype(np.float32) for r in rows], pa.list_(pa.float32()))], ["h", "label", "at", "weight"])

    # At most 2 * per_class ids are broadcast, and as many rows of at most BUCKETS terms come back.
    chosen = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").where("text <> ''").select(F.xxhash64("text").alias("h"), "label", "text")
    table = chosen.mapInArrow(run, "h long, label int, at array<short>, weight array<float>").dropDuplicates(["h", "label"]).toArrow()
    if not len(table):
        return empty
    order = np.lexsort((table["label"].to_numpy(), table["h"].to_numpy()))
    x, label = np.zeros((len(table), BUCKETS)), table["label"].to_numpy()[order]
    at, weight = table["at"].to_pylist(), table["weight"].to_pylist()
    for i, j in enumerate(order):
        x[i, at[j]] = weight[j]
    stands = np.array([counts[c] / max(1, int((label == c).sum())) for c in label])
    return Neighbours.fit(x, label, stands, prior, k=k)


def score(docs: DataFrame, model: Neighbours) -> DataFrame:
    """``docs`` with score."""
    from pyspark.sql.types import DoubleType, StructField, StructType

    docs = docs.drop("score")
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # 2 * PER_CLASS vectors and a projection, about 3 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        say = shipped.value
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(say(batch.column("text").to_pylist()), pa.float64())], [*batch.schema.names, "score"])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("score", DoubleType())]))


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    out = score(docs, fit(docs, labels))
    return out.select("doc_id", is_held_out("doc_id").alias("held_out"), "score", (F.col("score") >= GOOD).cast("int").alias("predicted"))
