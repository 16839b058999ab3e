"""Byte-level BPE encoding and decoding by corpus-level merge replay.

The distinct pre-tokens of a block of texts form one symbol sequence with word boundaries. An inverted index maps
the rank of each adjacent pair to the positions where it stands. Merges are applied in rank order, leftmost position
first, to all words at once; only the two touched neighbours enter the index anew. Each pre-token's ids are kept for the blocks that follow,
so a frequent word is replayed once per Python worker.

Nulls and empty texts give no tokens. A null doc_id stays null. Repeated rows and ties give equal rows. Extra columns
of the input are not carried. An empty table gives an empty table.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

#: Characters of text whose matches are held at once.
BLOCK_CHARS = 1_000_000
#: Pre-tokens beyond which a Python worker begins a new table of ids (the one before is kept too), and the longest kept.
KEPT_WORDS, KEPT_LENGTH = 100_000, 64
#: Neighbouring ranks that share a list of positions; the rank of a pair that forms no token.
RANKS_A_SLOT, NONE = 64, 1 << 40

SCHEMA = "doc_id long, n_tokens long, ids binary, decoded_sha256 string"


class MergeReplay:
    """Encoder and decoder for one rank table (token bytes to rank)."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.pattern = regex.compile(pattern)
        self.token = {r: t for t, r in ranks.items()}
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.base = max(ranks.values()) + 2
        pairs = {ranks[t[:i]] * self.base + ranks[t[i:]]: r for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks}
        self.keys = np.array(sorted(pairs), np.int64)
        self.forms = np.array([pairs[k] for k in self.keys.tolist()], np.int64)
        self.kept: dict[str, bytes] = {}  # of the latest blocks
        self.older: dict[str, bytes] = {}  # of those before

    def pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of the tokens that pairs form; NONE where they form none."""
        key = a * self.base + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.forms[at], NONE)

    def replay(self, words: list[bytes]) -> list[bytes]:
        """Ids of every word, as little-endian unsigned 32-bit integers.

        The index maps a slot of RANKS_A_SLOT neighbouring ranks to positions of pairs. The lowest slot that has any
        is taken; there each word applies its lowest pair, the leftmost of equals, which is the lowest of the word.
        """
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        n = int(sizes.sum())
        if not n:
            return [b""] * len(words)
        # Position n stands for the outside of a word.
        ids = np.append(self.single[np.frombuffer(b"".join(words), np.uint8)], self.base - 1)
        word = np.repeat(np.arange(len(words)), sizes)
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        ends = np.cumsum(sizes)[sizes > 0]
        after[ends - 1] = before[np.append(0, ends[:-1])] = after[n] = before[n] = n
        rank = np.append(self.pair_rank(ids[:n], ids[after[:n]]), NONE)
        index: dict[int, list[np.ndarray]] = {}
        queue: list[int] = []

        def put(positions: np.ndarray) -> None:
            slot = rank[positions] // RANKS_A_SLOT
            order = np.argsort(slot, kind="stable")
            positions, slot = positions[order], slot[order]
            cuts = np.flatnonzero(np.diff(slot)) + 1
            for s, part in zip(slot[np.append(0, cuts)].tolist(), np.split(positions, cuts), strict=True) if len(slot) else ():
                if s in index:
                    index[s].append(part)
                else:
                    index[s] = [part]
                    heappush(queue, s)

        put(np.flatnonzero(rank < NONE))
        while queue:
            slot = queue[0]
            p = np.unique(np.concatenate(index[slot]))
            p = p[rank[p] // RANKS_A_SLOT == slot]  # others were touched meanwhile
            if not len(p):
                heappop(queue)
                del index[slot]
                continue
            r, w = rank[p], word[p]
            first = np.flatnonzero(np.append(True, w[1:] != w[:-1]))
            lowest = np.repeat(np.minimum.reduceat(r, first), np.diff(np.append(first, len(p))))
            at = np.flatnonzero(r == lowest)
            at = at[np.append(True, w[at][1:] != w[at][:-1])]
            index[slot] = [np.delete(p, at)]
            p, r = p[at], r[at]
            q, b = after[p], before[p]
            x = after[q]
            ids[p], ids[q], rank[q] = r, -1, NONE
            after[p], before[x] = x, p
            rank[p] = self.pair_rank(r, ids[x])
            rank[b] = self.pair_rank(ids[b], r)
            ids[n], rank[n] = self.base - 1, NONE
            touched = np.concatenate([p, b])
            put(touched[rank[touched] < NONE])
        left = ids[:n] >= 0
        counts = np.bincount(word[left], minlength=len(words)) * 4
        packed = ids[:n][left].astype("<u4").tobytes()
        stops = np.cumsum(counts)
        return [packed[a:b] for a, b in zip((stops - counts).tolist(), stops.tolist(), strict=True)]

    def encode_block(self, texts: list[str]) -> Iterator[bytes]:
        """For each text its ids as little-endian unsigned 32-bit integers."""
        found = [self.pattern.findall(t) for t in texts]
        new: set[str] = set()
        for words in found:
            new.update(words)
        kept, older = self.kept, self.older
        new -= kept.keys()
        kept.update((w, older[w]) for w in new & older.keys())
        order = list(new - older.keys())
        table = zip(order, self.replay([w.encode("utf-8", "surrogatepass") for w in order]), strict=True)
        long = {}
        for w, ids in table:
            (kept if len(w) <= KEPT_LENGTH else long)[w] = ids
        for words in found:
            yield b"".join([kept[w] if w in kept else long[w] for w in words]) if long else b"".join(map(kept.__getitem__, words))
        if len(kept) > KEPT_WORDS:
            self.kept, self.older = {}, kept

    def encode(self, texts: Iterable[str]) -> Iterator[bytes]:
        block: list[str] = []
        size = 0
        for t in texts:
            block.append(t)
            size += len(t)
            if size >= BLOCK_CHARS:
                yield from self.encode_block(block)
                block, size = [], 0
        yield from self.encode_block(block)

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.token.__getitem__, np.frombuffer(packed, "<u4").tolist()))


_loaded: dict[tuple[str, str], MergeReplay] = {}


def load(path: str | None = None, pattern: str | None = None) -> MergeReplay:
    """The encoder of a rank file; the defaults are the multilingual public vocabulary and its pattern."""
    import public_tokenizers

    path, pattern = path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), pattern or public_tokenizers.PATTERN
    if (path, pattern) not in _loaded:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _loaded[path, pattern] = MergeReplay(ranks, pattern)
    return _loaded[path, pattern]


def encode_documents(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit), decoded_sha256 (of the ids decoded again)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path, pattern)
        for batch in batches:
            texts = (t or "" for t in batch.column("text").to_pylist())
            packed = list(bpe.encode(texts))
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id").cast(pa.int64()),
                pa.array([len(p) // 4 for p in packed], pa.int64()),
                pa.array(packed, pa.binary()),
                pa.array([hashlib.sha256(bpe.decode(p)).hexdigest() for p in packed], pa.string()),
            ], ["doc_id", "n_tokens", "ids", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    out = encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), "decoded_sha256")
