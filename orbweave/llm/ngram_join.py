"""N-gram Jaccard join over prefix trees.

Texts link when 100 times the size of the intersection of their n-gram sets is at least 75 times that of the union.
Equal sets form one class, which its smallest doc_id stands for; only representatives are joined.

1. *Order.* A count-min table of fixed size over all n-grams of all documents gives each n-gram a level: 0 unless it
   is far more frequent than the table's noise. The global order is (level, hash), rare n-grams first.
2. *First links.* Among the representatives of like size that share one of their EARLY smallest hashes, each is
   compared with its neighbour and with the plainest of its like; components of the links are labels. This is linear
   work in groups of any size.
3. *All others.* The prefix of n - ceil(0.75 n) + 1 n-grams in the global order must share an n-gram with that of any
   set that links (prefix filter), at positions that leave room for the overlap (position filter). N-grams whose
   holders all carry one label are skipped; the remaining pairs with different labels are compared, so no link between
   labels is lost. The holders of an n-gram that very many documents have are dealt into blocks, of which every two
   meet in a task of their own.
4. *Comparison.* Pairs that a 256-bit one-bit minhash rules out are dropped (a pair at the threshold is lost with a
   probability below 1e-11; ``sketched=False`` compares them all). For the rest, both whole texts meet, the partners' n-gram sets go into a trie in hash
   order, and the other set walks it: shared beginnings are counted once, and a subtree whose remaining length cannot
   reach the required overlap is left. The overlap is exact. A trie holds at most TRIE_SETS sets; further ones go into
   the next.
5. *Links within a label.* Components need none beyond the first ones, but the join does: the sets of a label are dealt
   into blocks of about BLOCK, and every two blocks meet in a cell, where the sets of one walk the trie of the other.
   Each text goes to one cell for each block of its label. The links of a group of near copies grow with its square;
   links per document are counted in the cells, so that only counts leave them.

Sets are written once with their prefixes, and each phase that follows reads them. Nothing but counts reaches the
driver. An empty or null text has an empty set and links with nothing. A null doc_id is counted but linked with
nothing and has a null component. Rows that repeat a doc_id are one node, whose text is the smallest of theirs; each
row's own set is counted. Extra columns are not carried. An empty table gives an empty table.
"""

from __future__ import annotations

import gc
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbweave.llm.shingles import U, gram_sets, mix
from orbweave.operators.components import connected_components
from orbweave.plans.shared import materialize, splittable_join

WORDS = 5
#: Link when HIGH_OF * intersection >= LOW_OF * union.
LOW_OF, HIGH_OF = 75, 100
#: Smallest hashes that find the first links.
EARLY = 8
#: Slots of the count-min table and the blocks that it is summed in.
SLOTS, TABLE_BLOCKS = 1 << 22, 64
#: Most rows of ids and labels (8 or 16 bytes each) that are broadcast; more are joined by a shuffle.
BROADCAST_IDS = 500_000
#: Sets of a label that are compared at once with as many others, and sets of a trie.
BLOCK, TRIE_SETS = 256, 4096
#: N-grams of at least 2 ** (HOT - 1) documents have their holders dealt into blocks, twice as many for each level above.
HOT = 13
#: One-bit minhashes, and the equal ones below which a pair is not compared.
BITS, LEAST_EQUAL = 256, 184

_FACTORS = np.random.default_rng(7).integers(1, 1 << 62, BITS, dtype=np.uint64) * U(2) + U(1)


def least_overlap(a: int, b: int) -> int:
    """Smallest intersection of linked sets of these sizes."""
    return -(-LOW_OF * (a + b) // (HIGH_OF + LOW_OF))


class GramTrie:
    """Sorted sets with shared beginnings stored once; nodes hold runs of n-grams."""

    class Node:
        __slots__ = ("run", "children", "names", "low", "high")

        def __init__(self, run: np.ndarray, size: int):
            self.run, self.children, self.names, self.low, self.high = run, {}, [], size, size

    def __init__(self):
        self.root = self.Node(np.zeros(0, np.uint64), 1 << 62)
        self.root.high = 0

    def add(self, items: np.ndarray, name: object) -> None:
        """``items`` in order; low and high bound the sizes of the sets below a node."""
        node, at, size = self.root, 0, len(items)
        while True:
            node.low, node.high = min(node.low, size), max(node.high, size)
            if at == size:
                node.names.append(name)
                return
            key = int(items[at])
            child = node.children.get(key)
            if child is None:
                child = node.children[key] = self.Node(items[at:], size)
                child.names.append(name)
                return
            m = min(len(child.run), size - at)
            differs = np.flatnonzero(child.run[:m] != items[at : at + m])
            same = int(differs[0]) if len(differs) else m
            if same < len(child.run):
                upper = self.Node(child.run[:same], child.low)
                upper.low, upper.high = child.low, child.high
                child.run = child.run[same:]
                upper.children[int(child.run[0])] = child
                child = node.children[key] = upper
            node, at = child, at + same

    def search(self, probe: np.ndarray) -> Iterator[tuple[object, int]]:
        """(name, overlap) of every set that links with ``probe``."""
        n = len(probe)
        todo = [(self.root, 0, 0)]
        while todo:
            node, depth, overlap = todo.pop()
            if len(node.run):
                at = np.searchsorted(probe, node.run)
                at[at == n] = n - 1
                overlap += int((probe[at] == node.run).sum())
                depth += len(node.run)
                left = min(node.high - depth, n - int(np.searchsorted(probe, node.run[-1], "right")))
            else:
                left = min(node.high, n)
            if overlap + left < least_overlap(n, node.low):
                continue
            if node.names and overlap >= least_overlap(n, depth):
                for name in node.names:
                    yield name, overlap
            todo += [(child, depth, overlap) for child in node.children.values()]


def signature(grams: np.ndarray) -> np.ndarray:
    """One bit of each minhash, as four 64-bit integers."""
    bits = np.empty(BITS, np.uint8)
    step = max(1, min(BITS, (1 << 18) // max(1, len(grams))))
    for at in range(0, BITS, step):
        low = (grams[None, :] * _FACTORS[at : at + step, None]).min(1)
        bits[at : at + step] = mix(low) & U(1)
    return np.packbits(bits).view(np.int64)


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of what is no longer referred to."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def word_grams(texts: pa.Array) -> Iterator[np.ndarray]:
    return gram_sets(texts, WORDS)


def count_table(docs: DataFrame, slots: int = SLOTS, column: str = "text", sets: Callable[[pa.Array], Iterable[np.ndarray]] = word_grams) -> np.ndarray:
    """Count-min table (one row) of the n-grams of all texts, or of what ``sets`` makes of ``column``: fixed size, whatever the corpus."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(slots, np.int64)
        held, size, share = [], 0, 0
        for batch in batches:
            for g in sets(batch.column(0)):
                held.append(g)
                size += len(g)
                share = share or (int(g[0]) if len(g) else 0)
                if size > 1 << 20:
                    table += np.bincount((np.concatenate(held) & U(slots - 1)).astype(np.int64), minlength=slots)
                    held, size = [], 0
        if held:
            table += np.bincount((np.concatenate(held) & U(slots - 1)).astype(np.int64), minlength=slots)
        parts = np.split(table, TABLE_BLOCKS)
        yield pa.RecordBatch.from_arrays([pa.array(range(TABLE_BLOCKS), pa.int32()), pa.array([share % 97] * TABLE_BLOCKS, pa.int32()), pa.array([zlib.compress(p.tobytes(), 1) for p in parts], pa.binary())], ["block", "share", "counts"])

    def add(key: tuple, rows: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(zlib.decompress(c.as_buffer()), np.int64) for c in rows.column("counts"))
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())})

    parts = docs.select(column).mapInArrow(count, "block int, share int, counts binary")
    for keys in (["block", "share"], ["block"]):  # in two steps, so that no task gets a row from every other
        parts = parts.groupBy(*keys).applyInArrow(add, "block int, counts binary") if keys == ["block"] else parts.groupBy(*keys).applyInArrow(lambda k, t: add(k, t).append_column("share", pa.array([k[1].as_py()], pa.int32())), "block int, counts binary, share int")
    blocks = {r["block"]: np.frombuffer(zlib.decompress(bytes(r["counts"])), np.int64) for r in parts.collect()}  # SLOTS counts
    return np.concatenate([blocks.get(i, np.zeros(slots // TABLE_BLOCKS, np.int64)) for i in range(TABLE_BLOCKS)])


def levels(table: np.ndarray) -> np.ndarray:
    """Level by slot: 0 up to the noise, then the binary logarithm of the count beyond it, and 1."""
    noise = float(np.median(table))
    return np.where(table > noise + 6 * np.sqrt(noise) + 16, np.log2(np.maximum(table - noise, 1)).astype(np.uint8) + 1, 0).astype(np.uint8)


def rare_first(g: np.ndarray, level: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """Of a set in order of its hashes: how many are of level 0, its prefix in the global order, and the levels of the prefix's last ones that are hot."""
    own = level[(g & U(len(level) - 1)).astype(np.int64)]
    order = np.argsort(own, kind="stable")[: len(g) - -(-LOW_OF * len(g) // HIGH_OF) + 1]
    last = own[order]
    return int((own == 0).sum()), g[order].view(np.int64), last[last >= HOT].astype(np.int64)


def lists(parts: list[np.ndarray]) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in parts])]), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *parts]), pa.int64()))


SETS = "doc_id long, n_shingles long, k1 long, k2 long, rare long, s0 long, s1 long, s2 long, s3 long, early array<long>, prefix array<long>, hot array<long>"


def gram_rows(docs: DataFrame, level: np.ndarray) -> DataFrame:
    """A row for each document: set size, the set's 128-bit key, its signature, smallest hashes and prefix, and the levels of the prefix's last n-grams that are hot."""
    shipped = docs.sparkSession.sparkContext.broadcast(level)  # SLOTS bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = shipped.value
        for whole in batches:
            for at in range(0, len(whole), 512):
                batch = whole.slice(at, 512)
                size, key, rare, bits, early, prefix, hot = [], [], [], [], [], [], []
                for g in gram_sets(batch.column("text"), WORDS):
                    n = len(g)
                    size.append(n)
                    key.append([int(np.add.reduce(mix(g))), int(np.bitwise_xor.reduce(mix(g ^ U(0x5851F42D4C957F2D)))) if n else 0])
                    early.append(g[:EARLY].view(np.int64))
                    if n:
                        for part, x in zip((rare, prefix, hot), rare_first(g, level), strict=True):
                            part.append(x)
                        bits.append(signature(g))
                    else:
                        rare.append(0)
                        prefix.append(g.view(np.int64))
                        hot.append(prefix[-1])
                        bits.append(np.zeros(4, np.int64))
                keys = np.array(key, np.uint64).reshape(-1, 2).view(np.int64)
                sig = np.array(bits, np.int64).reshape(-1, 4)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(size, pa.int64()), *(pa.array(keys[:, i]) for i in range(2)), pa.array(rare, pa.int64()), *(pa.array(sig[:, i]) for i in range(4)), *map(lists, (early, prefix, hot))], [x.split()[0] for x in SETS.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(run, SETS)


def _fits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether sets of these sizes can link."""
    return HIGH_OF * np.minimum(a, b) >= LOW_OF * np.maximum(a, b)


def _runs(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[dict[str, np.ndarray]]:
    """Columns of batches sorted by the first column, each run of equal values whole."""
    rest: dict[str, np.ndarray] | None = None
    for batch in batches:
        now = {k: batch.column(k).to_numpy() for k in names}
        if rest is not None:
            now = {k: np.concatenate([rest[k], now[k]]) for k in names}
        t = now[names[0]]
        cut = int(np.searchsorted(t, t[-1])) if len(t) else 0
        if cut:
            yield {k: v[:cut] for k, v in now.items()}
        rest = {k: v[cut:].copy() for k, v in now.items()}
    if rest is not None and len(rest[names[0]]):
        yield rest


def _pairs_table(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0) if len(a) else np.zeros((0, 2), np.int64)
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0], pa.int64()), pa.array(pairs[:, 1], pa.int64())], ["a", "b"])


def neighbour_pairs(sets: DataFrame) -> DataFrame:
    """Pairs among the holders of one of their smallest hashes: linear in their number.

    Holders are in order of their smallest hash, so that copies of one text come together, then of their share of rare
    n-grams. Each is paired with the next one, with the first of those that share the smallest hash, and with the one
    of all that has the smallest share of rare n-grams: a plain copy is like most others.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for x in _runs(batches, ["token", "e1", "share", "node", "n"]):
            t, e, v, n = x["token"], x["e1"], x["node"], x["n"]
            here = np.arange(len(t))
            new = np.concatenate([[True], t[1:] != t[:-1]])
            head = np.concatenate([[True], (t[1:] != t[:-1]) | (e[1:] != e[:-1])])
            group = np.cumsum(new) - 1
            order = np.lexsort((v, n, x["share"], group))
            plain = order[np.flatnonzero(np.concatenate([[True], np.diff(group[order]) > 0]))][group]
            top = np.maximum.accumulate(np.where(head, here, 0))
            at = np.concatenate([here[~new], here[~head], here])
            to = np.concatenate([here[~new] - 1, top[~head], plain])
            ok = (v[at] != v[to]) & _fits(n[at], n[to])
            held.append((v[at[ok]], v[to[ok]]))
            if sum(len(h[0]) for h in held) > 1 << 20:
                yield _pairs_table(*map(np.concatenate, zip(*held, strict=True)))
                held = []
        if held:
            yield _pairs_table(*map(np.concatenate, zip(*held, strict=True)))

    share = F.floor(F.col("rare") * 1000 / F.col("n_shingles"))
    # Sets that can link are of one class of sizes or of two neighbouring ones, so each enters its own and the next.
    size = F.floor(F.log("n_shingles") / F.lit(float(np.log(HIGH_OF / LOW_OF))) + F.lit(1e-9))
    rows = sets.select(F.explode("early").alias("token"), F.element_at("early", 1).alias("e1"), share.alias("share"), F.col("n_shingles").alias("n"), F.col("doc_id").alias("node"), size.alias("size"))
    rows = rows.withColumn("size", F.explode(F.array(F.col("size"), F.col("size") + 1))).withColumn("token", F.xxhash64("token", "size")).drop("size")
    rows = rows.repartition("token").sortWithinPartitions("token", "e1", "share", "n", "node")
    return rows.mapInArrow(run, "a long, b long").distinct()


def label_pairs(sets: DataFrame) -> DataFrame:
    """Pairs with different labels that share an n-gram of their prefixes which can be their first common one.

    After the first common n-gram, the rest of either set must still hold the required overlap (position filter).
    Holders of hot n-grams meet in cells of two blocks each; the top bits of ``sizes`` tell the blocks of a cell apart.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out_a, out_b, held = [], [], 0
        for x in _runs(batches, ["token", "label", "sizes", "node"]):
            t, w, v = x["token"], x["label"], x["node"]
            n, left, side = (x["sizes"] >> 32) & 0xFFFFFFF, x["sizes"] & 0xFFFFFFFF, x["sizes"] >> 60
            start = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
            stop = np.concatenate([start[1:], [len(t)]])
            mixed = w[stop - 1] != w[start]  # sorted by label
            for s, e in zip(start[mixed].tolist(), stop[mixed].tolist(), strict=True):
                # Against the holders of later labels, for one holder after the other.
                later = s + np.searchsorted(w[s:e], w[s:e], "right")
                for i in range(s, e):
                    j = later[i - s]
                    if j == e:
                        break
                    need = -(-LOW_OF * (n[i] + n[j:e]) // (HIGH_OF + LOW_OF))
                    hit = j + np.flatnonzero((left[i] >= need) & (left[j:e] >= need) & ((side[j:e] != side[i]) | (side[i] == 0)))
                    if len(hit):
                        out_a.append(np.full(len(hit), v[i]))
                        out_b.append(v[hit])
                        held += len(hit)
                    if held > 1 << 20:
                        yield _pairs_table(np.concatenate(out_a), np.concatenate(out_b))
                        out_a, out_b, held = [], [], 0
        if held:
            yield _pairs_table(np.concatenate(out_a), np.concatenate(out_b))

    size = lambda pos: F.shiftleft(F.col("n_shingles"), 32).bitwiseOR(F.col("n_shingles") - pos)
    cool = F.size("prefix") - F.size("hot")
    some = sets.select(F.posexplode(F.slice("prefix", F.lit(1), cool)).alias("pos", "token"), "label", "n_shingles", F.col("doc_id").alias("node"))
    rows = some.select("token", "label", size(F.col("pos")).alias("sizes"), "node")
    some = sets.where(F.size("hot") > 0).select(F.posexplode(F.arrays_zip(F.slice("prefix", cool + 1, F.size("hot")).alias("token"), F.col("hot").alias("level"))).alias("pos", "h"), cool.alias("cool"), "label", "n_shingles", F.col("doc_id").alias("node"))
    some = some.withColumn("blocks", F.expr(f"shiftleft(2L, cast(h.level as int) - {HOT})")).withColumn("own", F.pmod(F.xxhash64("node"), "blocks"))
    some = some.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    side = F.when(F.col("other") == F.col("own"), 0).when(F.col("other") > F.col("own"), 1).otherwise(2).cast("long")
    cell = F.xxhash64("h.token", F.least("own", "other"), F.greatest("own", "other"))
    rows = rows.unionByName(some.select(cell.alias("token"), "label", size(F.col("cool") + F.col("pos")).bitwiseOR(F.shiftleft(side, 60)).alias("sizes"), "node"))
    rows = rows.repartition("token").sortWithinPartitions("token", "label", "node")
    return rows.mapInArrow(run, "a long, b long").distinct()


def likely(pairs: DataFrame, sets: DataFrame, sketched: bool = True) -> DataFrame:
    """Pairs whose signatures agree in LEAST_EQUAL bits; without ``sketched`` all."""
    if not sketched:
        return pairs.select("a", "b")
    signs = sets.select("doc_id", *(f"s{i}" for i in range(4)))
    for side in "ab":
        pairs = splittable_join(pairs, signs.select(F.col("doc_id").alias(side), *(F.col(f"s{i}").alias(f"{side}{i}") for i in range(4))), side)
    equal = BITS - sum(F.bit_count(F.col(f"a{i}").bitwiseXOR(F.col(f"b{i}"))) for i in range(4))
    return pairs.where(equal >= LEAST_EQUAL).select("a", "b")


def small(table: DataFrame) -> DataFrame:
    """A written table of ids, to be broadcast if it has at most BROADCAST_IDS rows and to be joined by a shuffle otherwise."""
    return F.broadcast(table) if table.count() <= BROADCAST_IDS else table


def linked(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose whole texts link, with the overlap."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    ends = small(materialize(ends, "pair-ends"))
    texts = docs.select("doc_id", "text").join(ends, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    texts = materialize(texts, "pair-texts")
    # A text with very many partners is spread: each part of its partners meets a copy of it.
    spread = F.pmod(F.xxhash64("b"), F.lit(8)).cast("int")
    pairs = pairs.withColumn("part", spread)
    partners = splittable_join(pairs, texts.withColumnRenamed("doc_id", "b"), "b").select("a", "part", F.lit(1).alias("side"), "b", "text")
    probes = splittable_join(pairs.select("a", "part").distinct(), texts.withColumnRenamed("doc_id", "a"), "a").select("a", "part", F.lit(0).alias("side"), F.lit(None).cast("long").alias("b"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, probe, trie, held, found = None, None, GramTrie(), 0, []

        def finish() -> None:
            if probe is not None and len(probe):
                found.extend((key[0], b, n) for b, n in trie.search(probe))

        for batch in batches:
            grams = gram_sets(batch.column("text"), WORDS)
            for a, part, side, b, g in zip(*(batch.column(k).to_pylist() for k in ("a", "part", "side", "b")), grams, strict=True):
                if (a, part) != key:
                    finish()
                    key, probe, trie, held = (a, part), None, GramTrie(), 0
                if side == 0:
                    probe = g
                elif len(g):
                    if held == TRIE_SETS:  # the probe came before its partners
                        finish()
                        trie, held = GramTrie(), 0
                    trie.add(g, b)
                    held += 1
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in range(3)], ["a", "b", "overlap"])
                found = []
        finish()
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in range(3)], ["a", "b", "overlap"])

    met = partners.unionByName(probes).repartition("a", "part").sortWithinPartitions("a", "part", "side")
    return met.mapInArrow(run, "a long, b long, overlap long")


def within(labels: DataFrame, docs: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """All links (a, b, overlap) of nodes with one label; or with ``sizes`` (node, size), parts of (node, n): the sizes of its partners."""
    blocks = labels.groupBy("label").agg(F.ceil(F.count("*") / BLOCK).alias("k"))
    nodes = splittable_join(labels, blocks, "label").withColumn("own", F.pmod(F.xxhash64("node"), "k"))
    nodes = splittable_join(nodes, sizes, "node") if sizes is not None else nodes.withColumn("size", F.lit(1).cast("long"))
    nodes = materialize(nodes.withColumnRenamed("node", "doc_id"), "label-blocks")
    texts = docs.select("doc_id", "text").join(small(nodes), "doc_id").dropDuplicates(["doc_id"])
    cell = lambda x, y, side: F.struct(x.alias("x"), y.alias("y"), F.lit(side).alias("side"))
    own = F.col("own")
    cells = F.concat(F.transform(F.sequence(F.lit(0).cast("long"), own), lambda i: cell(i, own, 0)), F.transform(F.sequence(own, F.col("k") - 1), lambda i: cell(own, i, 1)))
    met = texts.select("label", "doc_id", "size", "text", F.explode(cells).alias("cell")).select("label", "cell.*", "doc_id", "size", "text")
    counting = sizes is not None
    names = ["node", "n"] if counting else ["a", "b", "overlap"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, trie, found, counts = None, GramTrie(), [], {}

        def send() -> pa.RecordBatch:
            rows = list(counts.items()) if counting else found
            out = pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(len(names))], names)
            found.clear()
            counts.clear()
            return out

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("label", "x", "y", "side", "doc_id", "size")]
            for label, x, y, side, a, size, g in zip(*columns, gram_sets(batch.column("text"), WORDS), strict=True):
                if (label, x, y) != key:
                    key, trie = (label, x, y), GramTrie()
                if not len(g):
                    continue
                if side == 0:
                    trie.add(g, (a, size))
                    continue
                for (b, other), n in trie.search(g):
                    if x == y and b <= a:  # in the cell of a block with itself, both ways are found
                        continue
                    if counting:
                        counts[a] = counts.get(a, 0) + other
                        counts[b] = counts.get(b, 0) + size
                    else:
                        found.append((min(a, b), max(a, b), n))
                if len(found) + len(counts) > 1 << 18:
                    yield send()
        yield send()

    met = met.repartition("label", "x", "y").sortWithinPartitions("label", "x", "y", "side")
    return met.mapInArrow(run, ", ".join(f"{n} long" for n in names))


def classes_and_links(docs: DataFrame, sketched: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(doc_id, n_shingles, rep) for every row; all (a, b, overlap) links of representatives; (node, label) of their components."""
    docs, members, first, labels, more = _joined(docs, sketched)
    return members, materialize(within(labels, docs), "links").unionByName(more), connected_components(first.unionByName(more).select("a", "b"))


def _joined(docs: DataFrame, sketched: bool = True) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """Documents with one text for each node; (doc_id, n_shingles, rep) for every row; first links of representatives; (node, label) of their components; all links between different labels."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    level = levels(count_table(docs))
    sets = every = materialize(gram_rows(docs, level), "gram-sets")
    several = sets.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("k1").alias("x"), F.max("k1").alias("y"), F.min("k2").alias("u"), F.max("k2").alias("v")).where("x <> y OR u <> v")
    several = materialize(several.select("doc_id"), "repeated-ids")
    if not several.isEmpty():
        one = materialize(docs.join(several, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text")), "texts-of-repeated-ids")
        docs = docs.join(several, "doc_id", "left_anti").unionByName(one)
        sets = materialize(sets.join(several, "doc_id", "left_anti").unionByName(gram_rows(one, level)), "gram-sets")
    key = F.xxhash64("k1", "k2", "n_shingles")
    some = sets.where("n_shingles > 0 AND doc_id IS NOT NULL").select("doc_id", "n_shingles", "k1", "k2")
    reps = some.groupBy("k1", "k2", "n_shingles").agg(F.min("doc_id").alias("rep"))
    slim = sets.select("doc_id", "n_shingles", "k1", "k2").withColumn("key", key)
    members = slim.join(reps.withColumn("key", key), ["key", "k1", "k2", "n_shingles"], "left")
    members = materialize(members.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("rep", "doc_id")).alias("rep")), "members")
    ids = materialize(members.where("doc_id = rep AND n_shingles > 0").select("doc_id").distinct(), "ids")
    alone = sets.join(small(ids), "doc_id", "left_semi")
    if ids.count() > BROADCAST_IDS:
        alone = materialize(alone, "representatives")
    release(spark)
    first = materialize(linked(materialize(likely(neighbour_pairs(alone), alone, sketched), "pairs"), docs), "links")
    labels = connected_components(first.select("a", "b"))
    release(spark)
    marked = alone.join(small(labels.withColumnRenamed("node", "doc_id")), "doc_id", "left").withColumn("label", F.coalesce("label", "doc_id"))
    rest = materialize(likely(label_pairs(marked), alone, sketched), "pairs")
    release(spark)
    if sets is not every:  # every row has its own size, and the class of its node
        nodes = members.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("rep").alias("rep"))
        members = materialize(every.select("doc_id", "n_shingles").join(nodes, "doc_id", "left"), "members")
    return docs, members, first, labels, materialize(linked(rest, docs), "links")


def _with_components(members: DataFrame, first: DataFrame, more: DataFrame) -> DataFrame:
    labels = connected_components(first.unionByName(more).select("a", "b"))
    out = splittable_join(members, labels.select(F.col("node").alias("rep"), "label"), "rep", "left")
    return out.withColumn("component_id", F.coalesce("label", "rep"))


def components(docs: DataFrame, sketched: bool = True) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of ``docs`` (doc_id, text)."""
    _, members, first, _, more = _joined(docs, sketched)
    return _with_components(members, first, more).select("doc_id", "n_shingles", "component_id")


def components_and_links(docs: DataFrame, sketched: bool = True) -> DataFrame:
    """doc_id, n_shingles, component_id, and n_links: how many other documents each row's document links with."""
    docs, members, first, labels, more = _joined(docs, sketched)
    alike = members.where("n_shingles > 0 AND doc_id IS NOT NULL").select("rep", "doc_id").distinct()
    sizes = materialize(alike.groupBy(F.col("rep").alias("node")).agg(F.count("*").alias("size")), "class-sizes")
    ways = more.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("l")).select(F.col("l.a").alias("to"), F.col("l.b").alias("node"))
    across = splittable_join(ways, sizes, "node").select(F.col("to").alias("node"), F.col("size").alias("n"))
    parts = within(labels, docs, sizes).unionByName(across).unionByName(sizes.select("node", (F.col("size") - 1).alias("n")))
    counts = materialize(parts.groupBy("node").agg(F.sum("n").alias("n_links")), "link-counts")
    out = splittable_join(_with_components(members, first, more), counts.withColumnRenamed("node", "rep"), "rep", "left")
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components_and_links(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, '{"".join(map(chr, range(65, 91)))}', '{"".join(map(chr, range(97, 123)))}'), '[^\x20\x09-\x0D]+') a FROM documents),
d AS (SELECT doc_id, CASE WHEN a IS NULL OR len(a) = 0 THEN []::VARCHAR[] WHEN len(a) < {WORDS} THEN [array_to_string(a, ' ')]
      ELSE list_distinct([array_to_string(a[i:i + {WORDS - 1}], ' ') FOR i IN range(1, len(a) - {WORDS - 2})]) END g FROM w),
i AS (SELECT doc_id, len(g) n, unnest(g) s FROM d),
l AS (SELECT a.doc_id x, b.doc_id y FROM i a JOIN i b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING {HIGH_OF} * count(*) >= {LOW_OF} * (a.n + b.n - count(*))),
r(id, label) AS (SELECT doc_id, doc_id FROM d UNION SELECT l.y, r.label FROM r JOIN l ON l.x = r.id),
c AS (SELECT id, min(label) component_id FROM r GROUP BY id),
k AS (SELECT x, count(*) n_links FROM l GROUP BY x)
SELECT d.doc_id, len(g) n_shingles, component_id, coalesce(n_links, 0) n_links FROM d JOIN c ON c.id = d.doc_id LEFT JOIN k ON k.x = d.doc_id
"""


def brute_force(rows: list[tuple[int, str | None]]) -> dict[int, tuple[int, int]]:
    """doc_id to (n_shingles, component_id) by comparing all pairs; for tests."""
    import re

    sets, one = {}, {}
    for i, text in rows:
        if text is not None:
            one[i] = min(text, one.get(i, text))
    for i, _ in rows:
        text = one.get(i)
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        sets[i] = {tuple(w[j : j + WORDS]) for j in range(max(1, len(w) - WORDS + 1))} if w else set()
    label = {i: i for i in sets}

    def root(i: int) -> int:
        while label[i] != i:
            i = label[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            if sets[a] and sets[b] and HIGH_OF * len(sets[a] & sets[b]) >= LOW_OF * len(sets[a] | sets[b]):
                ra, rb = root(a), root(b)
                label[max(ra, rb)] = min(ra, rb)
    return {i: (len(sets[i]), root(i)) for i in ids}
