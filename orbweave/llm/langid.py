"""Language identification by compression.

Each language's raw-content zstandard dictionary is made of whole lower-cased sample texts of that language. A text, lower-cased, is compressed
with every dictionary; the language whose dictionary gives the fewest bytes is predicted. The margin is the share of
bytes that the best saves against the second best; a margin below ``min_margin`` is rejected as too narrow.

A null text or one without any letter is ``und`` with score 0 and is rejected. Ties go to the language that comes
first in order. A null doc_id is never held out and never learned from. Rows without a language are predicted but not
learned from. Extra columns are kept by :func:`identify`. Without any labelled row every text is ``und``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bounds of what is fitted: sample bytes kept for a language, and bytes of the longest sample text.
SAMPLE_BYTES, SAMPLE_TEXT = 400_000, 6_000
#: Different texts drawn for a language before the bytes are bounded (in expectation).
DRAWN = 600
LEVEL = 9
#: Below this share of bytes saved a text is rejected.
MIN_MARGIN = 0.004

LETTER = regex.compile(r"\p{L}")
FIELDS = "lang_pred string, score double, margin double, rejected boolean"


def is_held_out(doc_id: Column | str) -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0 if isinstance(doc_id, str) else F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, sample_bytes: int = SAMPLE_BYTES) -> dict[str, bytes]:
    """Dictionary content by language, from texts of labelled rows that aren't held out.

    The sample is bounded: about DRAWN different texts of at most SAMPLE_TEXT bytes for each language, drawn by their
    hash, of which the first ``sample_bytes`` bytes are kept. A language that has longer texts only is learned from
    as many characters of the beginnings of texts drawn likewise. Every language of a learnable row is learned.
    """
    learn = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~is_held_out("doc_id") & (F.octet_length("text") > 0))
    draw = F.xxhash64("text")
    learn = learn.select("lang", draw.alias("h"), (F.octet_length("text") <= SAMPLE_TEXT).alias("short"), "text")
    kinds = learn.groupBy("lang", "short").agg(F.approx_count_distinct("h").alias("n")).collect()  # two rows a language
    has_short = {r["lang"] for r in kinds if r["short"]}
    used = [r for r in kinds if r["short"] or r["lang"] not in has_short]
    if not used:
        return {}
    wanted = lambda r: DRAWN if r["short"] else max(1, sample_bytes // SAMPLE_TEXT)
    # 63 bits of the hash against the share that is wanted, so the draw has a bound for any number of texts.
    limit = lambda r: min((1 << 63) - 1, int((1 << 63) * min(1.0, wanted(r) / max(1, r["n"]))))
    chosen = reduce(lambda a, b: a | b, ((F.col("lang") == r["lang"]) & (F.col("short") == r["short"]) & (F.shiftrightunsigned("h", 1) <= limit(r)) for r in used))
    # Equal texts are drawn once; their number has a bound in each language, whatever repeats.
    rows = learn.where(chosen).select("lang", "h", F.substring("text", 1, SAMPLE_TEXT).alias("text")).groupBy("lang", "h").agg(F.min("text").alias("text")).collect()
    out = {}
    for k in sorted({r["lang"] for r in used}):
        kept, size, seen = [], 0, set()
        for r in sorted((r for r in rows if r["lang"] == k), key=lambda r: (r["h"], r["text"])):
            raw = r["text"].lower().encode("utf-8", "surrogatepass")
            if (size + len(raw) <= sample_bytes or not kept) and raw not in seen:
                kept.append(raw)
                seen.add(raw)
                size += len(raw)
        if kept:
            out[k] = b"\n".join(kept)
    return out


class Classifier:
    def __init__(self, samples: dict[str, bytes], level: int = LEVEL):
        self.languages = sorted(samples)
        self.coders = []
        for k in self.languages:
            content = zstandard.ZstdCompressionDict(samples[k], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            content.precompute_compress(level=level)
            self.coders.append(zstandard.ZstdCompressor(dict_data=content, write_content_size=False, write_checksum=False, write_dict_id=False))

    def __call__(self, text: str | None) -> tuple[str, float, float, bool]:
        """Language, score from 0 to 1, margin, and whether it is rejected for having no letters."""
        if not text or not self.coders or not LETTER.search(text):
            return "und", 0.0, 0.0, True
        raw = text.lower().encode("utf-8", "surrogatepass")
        sizes = [len(c.compress(raw)) for c in self.coders]
        best = min(range(len(sizes)), key=lambda i: sizes[i])
        if len(sizes) == 1:
            return self.languages[0], 1.0, 1.0, False
        second = min(s for i, s in enumerate(sizes) if i != best)
        margin = 1 - sizes[best] / second
        return self.languages[best], min(1.0, 0.5 + 2 * margin), margin, False


def identify(docs: DataFrame, samples: dict[str, bytes], min_margin: float = MIN_MARGIN, level: int = LEVEL) -> DataFrame:
    """``docs`` with lang_pred, score, margin and rejected; columns of those names are replaced."""
    from pyspark.sql.types import _parse_datatype_string

    added = _parse_datatype_string(FIELDS)
    docs = docs.drop(*added.names)
    schema = type(added)([*docs.schema.fields, *added.fields])
    shipped = docs.sparkSession.sparkContext.broadcast(samples)  # SAMPLE_BYTES a language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        say = Classifier(shipped.value, level)
        for batch in batches:
            found = [say(t) for t in batch.column("text").to_pylist()]
            cols = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), pa.array([f[2] for f in found], pa.float64()), pa.array([f[3] or f[2] < min_margin for f in found], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *cols], [*batch.schema.names, *added.names])

    return docs.mapInArrow(run, schema)


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    out = identify(docs.select("doc_id", "text"), fit(docs))
    return out.select("doc_id", is_held_out("doc_id").alias("held_out"), "lang_pred", "score", "margin", "rejected")
