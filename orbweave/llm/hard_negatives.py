"""Hard negatives by branch and bound in ball trees.

Every anchor's positives are its best other rows of the same label by inner product; for each positive, the hard
negatives are the best rows of other labels whose score lies in a window below the positive's. Values are dealt into
blocks of bounded size, and each block's task builds one ball tree. A node with centre c and radius r bounds the inner
product with an anchor a by c.a - r|a| and c.a + r|a|. It is passed over where that range lies outside the anchor's
score window, or strictly beneath its current k-th score (a tie may still have a smaller id, so equality is looked at).
Anchors stream through the task in Arrow batches, a node is tried for all anchors of a batch that still need it, and
each anchor first looks into its most promising leaf, which makes the k-th score sharp early.

Two searches, the same code: positives go to the blocks of the anchor's label group only, negatives to all blocks, with
the windows that the positives give. Labels are dealt into GROUPS groups by hash, a group into blocks by the hash of
the id, so a label of a third of all rows spreads over many blocks. Where anchors are many they are cut into slices,
and each (block, slice) is a task; a task holds one block and one batch of anchors. Only the counts of GROUPS groups
come to the driver, and nothing is broadcast. What leaves a block for an anchor is at most k rows a window.

Scores are exact: products of whole numbers in double precision where all sums are below 2^53, Python integers
elsewhere. Scores beyond 64 bits count as the nearest 64-bit number. Missing components of a shorter vector count as
0, so an empty vector scores 0. Rows whose id, label or vector is null, or that have a null component, take no part.
Ties go to the smaller id. Rows that repeat an id are rows of their own among the values (never positives of an anchor
of that id); equal anchors ask once. An anchor without positives gives no row. Extra columns, whatever their names,
are left behind. An empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Groups of labels; components of the vectors of a block (128 MB as doubles); anchors of a slice; rows of a leaf.
GROUPS, BLOCK_CELLS, SLICE, LEAF = 64, 1 << 24, 1 << 18, 128
#: Anchors that go through a tree together.
TOGETHER = 1024

LEAST, MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max
FOUND = "anchor_id long, anchor_key long, place int, positive_id long, positive_score long, id long, score long"


def whole(vector: Column, scale: float = 256.0) -> Column:
    """floor(scale * x) for each component x as a double; null where the vector or a component is null or not finite.

    Components beyond 2^62 count as 2^62.
    """
    v = vector.cast("array<double>")
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    edge = F.lit(float(1 << 62))
    return F.when(v.isNotNull() & ~odd, F.transform(v, lambda x: F.floor(F.greatest(-edge, F.least(edge, x * scale)))))


class BallTree:
    """A ball tree over one block of whole-number vectors; nodes of several labels split by label first."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, leaf: int = LEAF):
        order = np.lexsort((ids, labels))
        self.ids, self.labels, self.x = ids[order], labels[order], x[order]
        self.top = float(np.abs(x.astype(float)).max(initial=0.0))
        lows, highs, kids, centres, radii, uniform = [], [], [], [], [], []
        todo = [(0, len(ids), -1, 0)] if len(ids) else []
        while todo:
            lo, hi, parent, side = todo.pop()
            node = len(lows)
            if parent >= 0:
                kids[parent][side] = node
            part = self.x[lo:hi].astype(float)
            centre = part.mean(0)
            away = ((part - centre) ** 2).sum(1)
            lows.append(lo), highs.append(hi), centres.append(centre), kids.append([-1, -1])
            radii.append(math.sqrt(float(away.max(initial=0.0))) * (1 + 1e-9))
            labels_ = self.labels[lo:hi]
            uniform.append(bool((labels_ == labels_[0]).all()))
            if hi - lo <= leaf:
                continue
            if not uniform[-1]:  # sorted by label as yet: cut where a label begins, near the middle
                starts = np.flatnonzero(labels_[1:] != labels_[:-1]) + 1
                cut = int(starts[np.abs(starts - (hi - lo) // 2).argmin()])
            else:
                one = part[away.argmax()]
                other = part[((part - one) ** 2).sum(1).argmax()]
                cut = (hi - lo) // 2
                turn = np.argpartition(part @ (other - one), cut) + lo
                self.ids[lo:hi], self.labels[lo:hi], self.x[lo:hi] = self.ids[turn], self.labels[turn], self.x[turn]
            todo += [(lo, lo + cut, node, 0), (lo + cut, hi, node, 1)]
        self.lows, self.highs, self.kids, self.radii, self.uniform = lows, highs, kids, np.array(radii), uniform
        self.centres = np.stack(centres) if centres else np.zeros((0, x.shape[1]))
        self.leaves = np.array([i for i, k in enumerate(kids) if k[0] < 0], np.int64)
        self.scored = 0

    def scores(self, lo: int, hi: int, a: np.ndarray) -> np.ndarray:
        """Exact inner products of the rows lo to hi with anchors."""
        self.scored += (hi - lo) * len(a)
        if self.top * float(np.abs(a.astype(float)).max(initial=0.0)) * a.shape[1] < 1 << 53:
            return (self.x[lo:hi].astype(float) @ a.T.astype(float)).astype(np.int64)
        big = self.x[lo:hi].astype(object) @ a.T.astype(object)
        return np.clip(big, LEAST + 1, MOST).astype(np.int64)

    def search(self, ids: np.ndarray, labels: np.ndarray, a: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores (anchor, window, place) of the k best rows in each window [low, high]; LEAST marks none.

        ``same``: rows of the anchor's label but not of its id; otherwise rows of other labels.
        """
        m, w = low.shape
        best, names = np.full((m, w, k), LEAST), np.full((m, w, k), MOST)
        if not len(self.ids) or not m:
            return names, best
        length = np.sqrt((a.astype(float) ** 2).sum(1))
        middle = a.astype(float) @ self.centres.T
        reach = length[:, None] * self.radii
        slack = 1e-9 * (np.sqrt((self.centres**2).sum(1)) * length[:, None] + reach) + 1e-6
        # Clipped as scores are.
        upper, lower = np.maximum(middle + reach + slack, LEAST), np.minimum(middle - reach - slack, MOST)

        def needed(node: int, who: np.ndarray) -> np.ndarray:
            floor = np.maximum(low[who], best[who, :, k - 1]).astype(float)
            # Whole numbers beyond 2^53 are rounded as doubles; the slack of the bounds is wider than that.
            some = ((upper[who, node][:, None] >= floor) & (lower[who, node][:, None] <= high[who])).any(1)
            if self.uniform[node]:
                some &= (labels[who] == self.labels[self.lows[node]]) == same
            return who[some]

        def look(node: int, who: np.ndarray) -> None:
            lo, hi = self.lows[node], self.highs[node]
            s = self.scores(lo, hi, a[who])
            fits = (self.labels[lo:hi, None] == labels[who]) == same
            if same:
                fits &= self.ids[lo:hi, None] != ids[who]
            for j in range(w):
                row, col = np.nonzero(fits & (s <= high[who, j]) & (s >= np.maximum(low[who, j], best[who, j, k - 1])))
                if not len(row):
                    continue
                hit = np.unique(col)
                held = who[hit]
                owner = np.concatenate([np.repeat(held, k), who[col]])
                score = np.concatenate([best[held, j].ravel(), s[row, col]])
                name = np.concatenate([names[held, j].ravel(), self.ids[lo + row]])
                order = np.lexsort((name, ~score, owner))  # ~x falls as x rises, without overflow
                owner, score, name = owner[order], score[order], name[order]
                place = np.arange(len(owner)) - np.searchsorted(owner, owner)
                keep = place < k
                best[owner[keep], j, place[keep]], names[owner[keep], j, place[keep]] = score[keep], name[keep]

        # First each anchor's most promising leaf of a fitting label, then the tree from the top.
        promise = upper[:, self.leaves]
        first = self.labels[[self.lows[n] for n in self.leaves]]
        plain = np.array([self.uniform[n] for n in self.leaves])
        promise = np.where(plain & ((labels[:, None] == first) != same), -np.inf, promise)
        home = self.leaves[promise.argmax(1)]
        for node in np.unique(home):
            who = needed(node, np.flatnonzero(home == node))
            if len(who):
                look(node, who)
        todo = [(0, np.arange(m))]
        while todo:
            node, who = todo.pop()
            who = needed(node, who)
            if not len(who):
                continue
            left, right = self.kids[node]
            if left < 0:
                who = who[home[who] != node]
                if len(who):
                    look(node, who)
            else:
                near = [left, right] if upper[who, left].sum() > upper[who, right].sum() else [right, left]
                todo += [(near[1], who), (near[0], who)]
        return names, best


def _matrix(lists: pa.ListArray, width: int) -> np.ndarray:
    """Rows of whole numbers, filled up with zeros to ``width``, in 32 bits where they fit."""
    sizes = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(lists), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = flat
    return out.astype(np.int32) if len(flat) == 0 or max(-int(flat.min()), int(flat.max())) < 1 << 31 else out


def windows(positive: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest whole scores s with low * positive <= 100 * s <= high * positive."""
    tens, rest = positive // 100, positive % 100
    return tens * low - (-low * rest) // 100, tens * high + (high * rest) // 100


def _search(dealt: DataFrame, width: int, k: int, same: bool, low: int, high: int, leaf: int) -> DataFrame:
    """Rows of FOUND from rows dealt by (block, slice), values (side 0) before anchors (side 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, tree = None, [], None
        for batch in batches:
            place, side, label, ids, key = (batch.column(c).to_numpy() for c in ("place", "side", "label", "id", "anchor_key"))
            x = _matrix(batch.column("q"), width)
            cuts = np.flatnonzero((np.diff(place) != 0) | (np.diff(side) != 0)) + 1
            for part in np.split(np.arange(len(ids)), cuts):
                if not len(part):
                    continue
                if place[part[0]] != at:
                    at, held, tree = place[part[0]], [], None
                if side[part[0]] == 0:
                    held.append((ids[part], label[part], x[part]))
                    continue
                if tree is None and held:
                    tree, held = BallTree(*(np.concatenate([h[i] for h in held]) for i in range(3)), leaf), []
                for some in np.split(part, range(TOGETHER, len(part), TOGETHER)) if tree is not None else []:
                    if same:
                        lo, hi = np.full((len(some), 1), LEAST + 1), np.full((len(some), 1), MOST)
                        pos_id = pos_score = np.zeros((len(some), 1), np.int64)
                    else:
                        lists = batch.column("positives").take(pa.array(some))
                        sizes = np.diff(lists.offsets.to_numpy())
                        most = int(sizes.max(initial=1))
                        there = np.arange(most) < sizes[:, None]
                        pos_id, pos_score = np.zeros((len(some), most), np.int64), np.zeros((len(some), most), np.int64)
                        flat = lists.flatten()
                        pos_id[there], pos_score[there] = (flat.field(f).to_numpy() for f in ("id", "score"))
                        lo, hi = windows(pos_score, low, high)
                        lo, hi = np.where(there, lo, MOST), np.where(there, hi, LEAST)
                    names, best = tree.search(ids[some], label[some], x[some], lo, hi, k, same)
                    a, w, i = np.nonzero(best != LEAST)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids[some][a]), pa.array(key[some][a]), pa.array(w.astype(np.int32) + 1), pa.array(pos_id[a, w]), pa.array(pos_score[a, w]), pa.array(names[a, w, i]), pa.array(best[a, w, i])],
                        [f.split()[0] for f in FOUND.split(", ")],
                    )

    return dealt.mapInArrow(run, FOUND)


def hard_negatives(values: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, block_cells: int = BLOCK_CELLS, slice_rows: int = SLICE, leaf: int = LEAF) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score); both inputs are (id, label, q).

    ``q`` are arrays of whole numbers; a negative's score lies between ``low`` and ``high`` percent of its positive's.
    """
    plain = [F.col("id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), F.col("q").cast("array<long>").alias("q")]
    use = "id IS NOT NULL AND label IS NOT NULL AND q IS NOT NULL AND NOT exists(q, x -> x IS NULL)"
    values, anchors = values.select(*plain).where(use), anchors.select(*plain).where(use)
    group = F.pmod(F.xxhash64("label"), F.lit(GROUPS)).cast("int")
    counts = {r["g"]: (r["n"], r["w"]) for r in values.groupBy(group.alias("g")).agg(F.count("*").alias("n"), F.max(F.size("q")).alias("w")).collect()}  # GROUPS rows
    asked = anchors.agg(F.count("*").alias("n"), F.max(F.size("q")).alias("w")).first()
    width = max([1, asked["w"] or 0, *(w for _, w in counts.values())])
    rows = max(1, block_cells // width)
    slices = max(1, -(-asked["n"] // slice_rows))
    blocks = [-(-counts[g][0] // rows) if g in counts else 0 for g in range(GROUPS)]
    starts = [sum(blocks[:g]) for g in range(GROUPS)]
    total = max(1, sum(blocks))
    of = lambda numbers: F.element_at(F.array(*map(F.lit, numbers)), group + 1)

    key = F.xxhash64("id", "label", "q")
    slice_ = F.pmod(F.xxhash64(F.lit("slice"), "id"), F.lit(slices)).cast("int")
    nobody = F.array().cast("array<struct<id:long,score:long>>")
    block = of(starts) + F.pmod(F.xxhash64(F.lit("block"), "id"), F.greatest(of(blocks), F.lit(1))).cast("int")
    copies = values.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))) if slices > 1 else values.withColumn("slice", F.lit(0))
    entered = copies.select((block * slices + F.col("slice")).alias("place"), F.lit(0).alias("side"), "id", "label", "q", F.lit(0).cast("long").alias("anchor_key"), nobody.alias("positives"))

    def meet(who: DataFrame, where: Column, same: bool, k: int) -> DataFrame:
        asks = who.select(F.explode(where).alias("block"), "*").select((F.col("block") * slices + slice_).alias("place"), F.lit(1).alias("side"), "id", "label", "q", "anchor_key", "positives")
        dealt = entered.unionByName(asks).repartition(min(2 * total * slices, 100_000), "place").sortWithinPartitions("place", "side")
        return _search(dealt, width, k, same, low, high, leaf)

    def top(found: DataFrame, k: int, *keys: str) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "id"))
        return found.withColumn("rank", rank).where(F.col("rank") <= k)

    anchors = anchors.dropDuplicates().withColumn("anchor_key", key)
    own = F.when(of(blocks) > 0, F.sequence(of(starts), of(starts) + F.greatest(of(blocks), F.lit(1)) - 1)).otherwise(F.array().cast("array<int>"))
    near = top(meet(anchors.withColumn("positives", nobody), own, True, positives), positives, "anchor_id", "anchor_key")
    each = near.groupBy(F.col("anchor_id").alias("id"), "anchor_key").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "score"))).alias("p"))  # at most ``positives``
    each = each.select("id", "anchor_key", F.transform("p", lambda r: F.struct(r["id"].alias("id"), r["score"].alias("score"))).alias("positives"))
    found = meet(anchors.join(each, ["id", "anchor_key"]), F.sequence(F.lit(0), F.lit(total - 1)), False, negatives)
    out = top(found, negatives, "anchor_id", "anchor_key", "place")
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    values = rows.select(F.col("vec_id").alias("id"), label.alias("label"), whole(F.col("embedding")).alias("q"))
    return hard_negatives(values, values.where("id % 100 = 0"))


ORACLE = """
WITH e AS (SELECT vec_id id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END label, [floor(256 * x::DOUBLE) FOR x IN embedding] q FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT a.id anchor_id, a.label = b.label same, b.id, list_inner_product(a.q, b.q)::BIGINT score FROM e a JOIN e b ON a.id % 100 = 0 AND a.id <> b.id),
p AS (SELECT anchor_id, id positive_id, score positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
n AS (SELECT p.*, s.id negative_id, s.score negative_score, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.id)::INT "rank"
  FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * s.score AND 100 * s.score <= 100 * positive_score)
SELECT anchor_id, positive_id, "rank", negative_id, positive_score, negative_score FROM n WHERE "rank" <= 5
"""
