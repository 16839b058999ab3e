"""Document fingerprints: SpotSigs.

A signature is a common word (the anchor) with the chain of the CHAIN content words that follow it; punctuation and
case don't count and other common words are passed over. A fingerprint is the set of the signatures' 64-bit hashes in
order, as hex. A text with words but without any full chain has one signature, its whole word sequence; so has every
text in a language without anchors here, which then is like another one only if their words are equal. Sets are
partitioned by length so that only neighbouring partitions can hold similar ones, and compared by Jaccard with two
prunings: sets whose lengths differ too much, and a merge that stops once the rest cannot reach the threshold.

Null and empty texts have no signatures and the empty fingerprint; two empty fingerprints are alike (1). The next
document is the next one by doc_id, nulls first, among equal ones by the text's xxhash64 and then by text, and the
first after the last; an only document follows itself. Extra columns are not carried. Very long texts are
fingerprinted whole. An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orbweave.llm import ngram_join
from orbweave.operators.components import connected_components
from orbweave.plans.shared import materialize, splittable_join

# Common words of English, German, French and Spanish that serve as anchors.
ANCHORS = frozenset(
    "the of and to in is that it was for on are as with be by this from or have an they which a at not "
    "der die und den von das mit ist des im dem nicht ein eine als auch es an auf für sich zu "
    "le la les et des du en un une que est pour qui dans par sur au pas plus ne ce il de "
    "el los las y del que en un una es por con no se para como al lo su más o".split()
)
CHAIN = 2
#: Similarity for near duplicates.
THRESHOLD = 0.75
#: Hexadecimal digits of a signature.
DIGITS = 16
#: Bytes of a signature.
BYTES = DIGITS // 2
#: Rank error of the doc_id quantiles: one part in so many of a partition.
ACCURACY = 50
MISSING = -(1 << 63)

_WORD = re.compile(r"\w+")
_md5 = hashlib.md5


def signatures(text: str | None) -> list[str]:
    """Hashes of a text's signatures, sorted and distinct."""
    words = _WORD.findall((text or "").lower())
    content, spots = [], []
    for w in words:
        if w in ANCHORS:
            spots.append((w, len(content)))
        else:
            content.append(w)
    last = len(content) - CHAIN
    found = {" ".join((w, *content[i : i + CHAIN])) for w, i in spots if i <= last}
    if not found and words:
        found = {" ".join(words)}
    return sorted({_md5(s.encode("utf-8", "surrogatepass"), usedforsecurity=False).hexdigest()[:DIGITS] for s in found})


def to_hex(sigs: list[str]) -> str:
    return "".join(sigs)


def from_hex(fingerprint: str) -> list[str]:
    return [fingerprint[i : i + DIGITS] for i in range(0, len(fingerprint), DIGITS)]


def jaccard(a: list[str], b: list[str], threshold: float = 0.0) -> float:
    """Jaccard similarity of sorted sets; 0 where pruning shows it to be below ``threshold``."""
    if not a or not b:
        return float(not a and not b)
    if threshold <= 0:
        same = len(set(a).intersection(b))
        return same / (len(a) + len(b) - same)
    if min(len(a), len(b)) < threshold * max(len(a), len(b)):
        return 0.0
    allowed = (len(a) + len(b)) * (1 - threshold) / (1 + threshold) + 1e-9  # items that only one of them has
    i = j = apart = same = 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            i, j, same = i + 1, j + 1, same + 1
            continue
        if a[i] < b[j]:
            i += 1
        else:
            j += 1
        apart += 1
        if apart > allowed:
            return 0.0
    out = same / (len(a) + len(b) - same)
    return out if out >= threshold else 0.0


def _bounds(keyed: DataFrame, partitions: int) -> list[tuple[int, int]]:
    """Lower bounds (key, text hash) of ranges with about equal numbers of rows; a key that fills several ranges is cut by its texts' hashes."""
    shares = [i / partitions for i in range(1, partitions)]
    cuts = keyed.agg(F.percentile_approx("key", shares, ACCURACY * partitions)).first()[0] if shares else None
    out = [(MISSING, MISSING)]
    for key, group in itertools.groupby(cuts or []):
        n = len(list(group))
        out += [(key, MISSING + i * ((1 << 64) // n)) for i in range(n)]
    return sorted(set(out))


def with_next(docs: DataFrame, partitions: int) -> DataFrame:
    """Rows of (doc_id, text) dealt by ranges of doc_id: each range also gets the first row of the next range as a guest.

    The ranges come from quantiles of doc_id; one number pair a range reaches the driver. Texts are shuffled once.
    """
    keyed = docs.select("doc_id", "text", F.coalesce(F.col("doc_id").cast("long"), F.lit(MISSING)).alias("key"))
    bounds = _bounds(keyed, partitions)
    keyed = keyed.withColumn("th", F.xxhash64("text"))
    ids = lambda values: F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")
    # The last bound that isn't above a row, by halving steps.
    n, steps = len(bounds), max(1, (len(bounds) - 1).bit_length())
    key, text_hash = ids(k for k, _ in bounds), ids(h for _, h in bounds)

    def step(at: Column, i: Column) -> Column:
        to = at + F.element_at(F.array(*(F.lit(1 << (steps - 1 - j)) for j in range(steps))), i)
        place = F.least(to, F.lit(n - 1)) + 1
        k, h = F.element_at(key, place), F.element_at(text_hash, place)
        return F.when((to < n) & ((k < F.col("key")) | ((k == F.col("key")) & (h <= F.col("th")))), to).otherwise(at)

    placed = keyed.withColumn("own", F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.lit(0), step))
    firsts = {r["own"]: (r["f"]["key"], r["f"]["th"]) for r in placed.groupBy("own").agg(F.min(F.struct("key", "th")).alias("f")).collect()}  # at most `partitions` rows
    order = sorted(firsts)
    before = {r: order[i - 1] for i, r in enumerate(order)}
    of = lambda values: F.element_at(ids(values), F.col("own") + 1)
    is_first = (F.col("key") == of(firsts.get(r, (0, 0))[0] for r in range(n))) & (F.col("th") == of(firsts.get(r, (0, 0))[1] for r in range(n)))
    guest = F.struct(of(before.get(r, 0) for r in range(n)).cast("int").alias("range"), F.lit(True).alias("guest"))
    own = F.struct(F.col("own").alias("range"), F.lit(False).alias("guest"))
    dealt = placed.withColumn("to", F.explode(F.when(is_first, F.array(own, guest)).otherwise(F.array(own))))
    dealt = dealt.select("doc_id", "text", "key", "th", "to.range", "to.guest")
    return dealt.repartitionById(max(n, partitions), F.col("range")).sortWithinPartitions("range", "guest", "key", "th", "text")


PAIRS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edited(text: str, following: str) -> str:
    """``text`` with its last half replaced by as much of the beginning of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def edit_fingerprints(docs: DataFrame, partitions: int) -> DataFrame:
    """The columns of PAIRS for each document: its fingerprint, its edited text's, and how like it those of the edited text and of the next document are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the row that waits for the next one: (doc_id, text, signatures)
        for batch in batches:
            out = []
            for doc_id, text, guest in zip(*(batch.column(k).to_pylist() for k in ("doc_id", "text", "guest")), strict=True):
                if guest and held is None:
                    continue  # rows that repeat the first id, of which the first has been taken
                text = text or ""
                sigs = signatures(text)
                if held is not None:
                    changed = edited(held[1], text)
                    other = signatures(changed)
                    out.append((held[0], len(held[1]), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), to_hex(held[2]), to_hex(other), jaccard(held[2], other), jaccard(held[2], sigs)))
                held = None if guest else (doc_id, text, sigs)
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], [x.split()[0] for x in PAIRS.split(", ")])

    return with_next(docs, partitions).select("doc_id", "text", "guest").mapInArrow(run, PAIRS)


def packed(docs: DataFrame) -> DataFrame:
    """doc_id, n_signatures, the fingerprint as bytes, and its 128-bit key (k1, k2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [bytes.fromhex(to_hex(signatures(t))) for t in batch.column("text").to_pylist()]
            keys = np.frombuffer(b"".join(_md5(p, usedforsecurity=False).digest() for p in prints), np.int64).reshape(-1, 2)
            sizes = pa.array([len(p) // BYTES for p in prints], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), sizes, pa.array(prints, pa.binary()), *(pa.array(np.ascontiguousarray(k)) for k in keys.T)], ["doc_id", "n_signatures", "print", "k1", "k2"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_signatures long, print binary, k1 long, k2 long")


def _hashes(prints: pa.Array) -> Iterator[np.ndarray]:
    """The signatures of packed fingerprints as numbers, in order."""
    return (np.frombuffer(p, f">u{BYTES}").astype(np.uint64) for p in prints.to_pylist())


def _rare_first(reps: DataFrame, level: np.ndarray) -> DataFrame:
    """The columns that ``ngram_join`` compares sets by."""
    shipped = reps.sparkSession.sparkContext.broadcast(level)  # ngram_join.SLOTS bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = list(_hashes(batch.column("print")))
            found = [ngram_join.rare_first(g, shipped.value) for g in sets]
            rare, prefix, hot = ([x[i] for x in found] for i in range(3))
            early = [g[: ngram_join.EARLY].view(np.int64) for g in sets]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n"), pa.array(rare, pa.int64()), *map(ngram_join.lists, (early, prefix, hot))], ["doc_id", "n_shingles", "rare", "early", "prefix", "hot"])

    return reps.select("doc_id", "n", "print").mapInArrow(run, "doc_id long, n_shingles long, rare long, early array<long>, prefix array<long>, hot array<long>")


def similar(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Near duplicates by fingerprint: (doc_id, component_id) for each row, and the links (a, b, likeness) between representatives of equal fingerprints.

    Sets meet by the signatures of their prefixes, rare ones first (by a count-min table of fixed size, see
    ``ngram_join``), so that common signatures make no pairs: first those next to each other among sets of one length
    partition (of THRESHOLD ** -p to THRESHOLD ** -(p + 1) signatures) or of two neighbouring ones, then those with
    different labels whose lengths and places leave room for a link, so that a large group of copies gives few pairs.
    Fingerprints are written once, and only those of pairs that their bits leave are shuffled.
    """
    spark = docs.sparkSession
    prints = materialize(packed(docs), "fingerprints")
    keys = ["k1", "k2", "n_signatures"]
    some = prints.where("n_signatures > 0 AND doc_id IS NOT NULL")
    reps = materialize(some.groupBy(*keys).agg(F.min("doc_id").alias("doc_id")), "representatives")
    level = ngram_join.levels(ngram_join.count_table(some, column="print", sets=_hashes))
    sets = some.join(ngram_join.small(reps), [*keys, "doc_id"], "left_semi")
    if not some.groupBy("doc_id", *keys).count().where("count > 1").isEmpty():
        sets = sets.dropDuplicates([*keys, "doc_id"])  # rows that are there twice
    sets = sets.select("doc_id", F.col("n_signatures").alias("n"), "print")
    ngram_join.release(spark)
    first = _alike(ngram_join.neighbour_pairs(_rare_first(sets, level)), sets)
    labels = connected_components(first.select("a", "b"))
    ngram_join.release(spark)
    known = ngram_join.small(materialize(labels.withColumnRenamed("node", "doc_id"), "labels"))
    marked = _rare_first(sets, level).join(known, "doc_id", "left").withColumn("label", F.coalesce("label", "doc_id"))
    links = first.unionByName(_alike(ngram_join.label_pairs(marked), sets))
    ngram_join.release(spark)
    labels = connected_components(links.select("a", "b"))
    rep_of = prints.select("doc_id", *keys).join(reps.withColumnRenamed("doc_id", "node"), keys, "left").select("doc_id", "node")
    joined = splittable_join(rep_of, labels, "node", "left")
    return joined.select("doc_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("label", "node", "doc_id")).alias("component_id")), links


def possible(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """The pairs (a, b) without those that can't reach THRESHOLD, by 256 bits a set: loses no link.

    A signature's first byte is its bit. Each bit that only one of two sets has is a signature that the other lacks, which
    bounds what they share, so far fewer pairs fetch whole fingerprints.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = np.zeros((batch.num_rows, 256), bool)
            for row, fingerprint in zip(bits, batch.column("fingerprint").to_pylist(), strict=True):
                row[np.frombuffer(bytes.fromhex(fingerprint), np.uint8)[:: DIGITS // 2]] = True
            words = np.packbits(bits, axis=1).view("<i8")
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n"), *(pa.array(np.ascontiguousarray(x)) for x in words.T)], ["doc_id", "n", "m0", "m1", "m2", "m3"])

    marks = reps.select("doc_id", F.col("n").cast("long").alias("n"), "fingerprint").mapInArrow(run, "doc_id long, n long, m0 long, m1 long, m2 long, m3 long")
    for side in "ab":
        pairs = splittable_join(pairs, marks.select(F.col("doc_id").alias(side), *(F.col(c).alias(side + c) for c in ("n", "m0", "m1", "m2", "m3"))), side)
    alone = lambda x, y: sum(F.bit_count(F.col(f"{x}m{i}").bitwiseAND(F.bitwise_not(F.col(f"{y}m{i}")))) for i in range(4))
    shared = F.least(F.col("an") - alone("a", "b"), F.col("bn") - alone("b", "a"))
    return pairs.where(shared * (1 + THRESHOLD) >= (F.col("an") + F.col("bn")) * THRESHOLD - 1e-6).select("a", "b")


def _alike(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of ``sets`` (doc_id, n, print) that reach THRESHOLD, with their likeness."""
    left = materialize(possible(materialize(pairs, "pairs"), sets.select("doc_id", "n", F.hex("print").alias("fingerprint"))), "pairs")
    ends = materialize(left.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "pair-ends")
    held = sets.select("doc_id", "print").join(ngram_join.small(ends), "doc_id", "left_semi")
    of = lambda side: held.select(F.col("doc_id").alias(side), F.col("print").alias(f"f{side}"))
    met = splittable_join(splittable_join(left, of("a"), "a"), of("b"), "b").select("a", "b", "fa", "fb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            like = [jaccard(from_hex(x.hex()), from_hex(y.hex()), THRESHOLD) for x, y in zip(batch.column("fa").to_pylist(), batch.column("fb").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(like, pa.float64())], ["a", "b", "likeness"])

    return materialize(met.mapInArrow(run, "a long, b long, likeness double").where("likeness > 0"), "links")


def op7_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return edit_fingerprints(docs, int(spark.conf.get("spark.sql.shuffle.partitions")))


def spotsigs_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, component_id: what fingerprints link that are at least THRESHOLD alike."""
    return similar(spark.read.parquet(f"{sf_dir}/documents.parquet"))[0]


def _signatures_sql(texts: str) -> str:
    """CTEs from ``texts`` (doc_id, kind, t) to f (doc_id, kind, sorted list of signatures l)."""
    anchors = ", ".join(f"'{w}'" for w in sorted(ANCHORS))
    chain = " ".join(f"JOIN c c{i} ON c{i}.doc_id = m.doc_id AND c{i}.kind = m.kind AND c{i}.n = m.n + {i}" for i in range(1, CHAIN + 1))
    return f"""{texts},
w AS (SELECT doc_id, kind, regexp_extract_all(lower(t), '[\\p{{L}}\\p{{N}}_]+') ws FROM u),
l AS (SELECT doc_id, kind, unnest(ws) word, unnest(range(len(ws))) p FROM w),
a AS (SELECT *, word IN ({anchors}) anchor FROM l),
m AS (SELECT *, count(*) FILTER (NOT anchor) OVER (PARTITION BY doc_id, kind ORDER BY p ROWS UNBOUNDED PRECEDING) n FROM a),
c AS (SELECT doc_id, kind, n, word FROM m WHERE NOT anchor),
h AS (SELECT m.doc_id, m.kind, list(DISTINCT substr(md5(concat_ws(' ', m.word, {", ".join(f"c{i}.word" for i in range(1, CHAIN + 1))})), 1, {DIGITS})) g FROM m {chain} WHERE m.anchor GROUP BY m.doc_id, m.kind),
f AS (SELECT w.doc_id, w.kind, CASE WHEN g IS NOT NULL THEN list_sort(g) WHEN len(ws) > 0 THEN [substr(md5(array_to_string(ws, ' ')), 1, {DIGITS})] ELSE [] END l FROM w LEFT JOIN h USING (doc_id, kind))"""


def _alike_sql(x: str, y: str) -> str:
    same = f"len(list_intersect({x}, {y}))"
    return f"CASE WHEN len({x}) = 0 OR len({y}) = 0 THEN (len({x}) = len({y}))::INT::DOUBLE ELSE {same}::DOUBLE / (len({x}) + len({y}) - {same}) END"


ORACLE = _signatures_sql("""
WITH o AS (SELECT doc_id, coalesce(text, '') t, row_number() OVER (ORDER BY doc_id) r, count(*) OVER () n FROM documents),
x AS (SELECT a.doc_id, b.doc_id next_id, a.t, left(a.t, length(a.t) - length(a.t) // 2) || left(b.t, length(a.t) // 2) e FROM o a JOIN o b ON b.r = a.r % a.n + 1),
u AS (SELECT doc_id, 0 kind, t FROM x UNION ALL SELECT doc_id, 1 kind, e FROM x)""") + f"""
SELECT x.doc_id, length(x.t) n_chars, sha256(x.e) edited_sha256, array_to_string(s.l, '') fingerprint, array_to_string(c.l, '') edited_fingerprint, {_alike_sql("s.l", "c.l")} near_edited, {_alike_sql("s.l", "y.l")} near_next
FROM x JOIN f s ON s.doc_id = x.doc_id AND s.kind = 0 JOIN f c ON c.doc_id = x.doc_id AND c.kind = 1 JOIN f y ON y.doc_id = x.next_id AND y.kind = 0
"""

NEAR_ORACLE = _signatures_sql("WITH RECURSIVE u AS (SELECT doc_id, 0 kind, coalesce(text, '') t FROM documents)") + f""",
q AS (SELECT l, min(doc_id) rep, len(l) n FROM f WHERE len(l) > 0 GROUP BY l),
i AS (SELECT rep, n, unnest(l) g FROM q),
b AS (SELECT a.rep x, b.rep y FROM i a JOIN i b ON a.g = b.g AND a.rep <> b.rep GROUP BY a.rep, b.rep, a.n, b.n HAVING count(*)::DOUBLE / (a.n + b.n - count(*)) >= {THRESHOLD}),
r(id, label) AS (SELECT rep, rep FROM q UNION SELECT b.y, r.label FROM r JOIN b ON b.x = r.id),
z AS (SELECT id, min(label) label FROM r GROUP BY id)
SELECT f.doc_id, coalesce(z.label, f.doc_id) component_id FROM f LEFT JOIN q ON q.l = f.l LEFT JOIN z ON z.id = q.rep
"""
