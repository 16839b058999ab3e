"""Chat formatting by quotation linking.

A message's lines carry their quote level as leading ``>`` signs. Consecutive lines of one level form a passage; the
passages of level 0 are the message's own text, the deeper ones quote others. Passages are normalised (case folded,
white space single) and hashed: whole passages, and lines of MIN_LINE characters or more. Quotes join to the original
that holds the same passage as own text: within the conversation the latest earlier message, else the first message
of another conversation. The parent of a message is the original of its shallowest quote, of those the one with the most matched
text. Reply depth and thread come by pointer doubling over the parents within the conversation.

The join within a conversation is a running window over quotes and originals of one passage, so its work is linear;
the join across conversations meets one original for each passage. A passage that a third of all messages share thus
gives no pairs.

A quote sign stands at the beginning of its line. Own lines that begin with ``>``, after spaces or not, are written
with one more space in front, which reading takes off again (as in flowed mail), so own text comes back as it was.

Null and empty texts have no passages: such a message has no parent and an empty text. Rows with a null conv_id or
turn link with nothing and start a thread of their own. Rows that repeat conv_id and turn are one message whose
passages count together. Extra columns are kept, save those named like the added ones. An empty table gives an empty
table.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orbweave.plans.shared import materialize, splittable_join

#: Shortest line that is matched by itself.
MIN_LINE = 30
#: Rounds of pointer doubling: threads of up to 2 ** ROUNDS messages.
ROUNDS = 40

_QUOTE = re.compile(r"(?:>[ \t]?)+")
_SIGN = re.compile(r"^(?= *>)", re.MULTILINE)
_STUFFED = re.compile(r"^ (?= *>)", re.MULTILINE)
_ATTRIBUTION = re.compile(r"[ \t]*(?:On\b.{0,200}\bwrote:|[\w .@<>-]{1,80} wrote:)[ \t]*$")


def passages(text: str | None) -> list[tuple[int, str]]:
    """(quote level, text without its signs) of each run of lines of one level; a line that attributes the quote below it is left out."""
    out: list[tuple[int, list[str]]] = []
    if not text:
        return []
    for line in text.split("\n"):
        m = _QUOTE.match(line)
        level = m[0].count(">") if m else 0
        body = line[m.end() :] if m else line
        if level and out and out[-1][0] < level and out[-1][1] and _ATTRIBUTION.match(out[-1][1][-1]):
            out[-1][1].pop()
        if out and out[-1][0] == level:
            out[-1][1].append(body)
        else:
            out.append((level, [body]))
    return [(level, _STUFFED.sub("", "\n".join(lines))) for level, lines in out if lines]


def normalised(text: str) -> str:
    return " ".join(text.casefold().split())


def unquoted(text: str | None) -> str:
    """A message's own text."""
    return "\n".join(t for level, t in passages(text) if level == 0)


def keys(text: str | None) -> list[tuple[int, bytes, int]]:
    """(level, hash, length) of the normalised passages and of their long lines; all own passages count as one."""
    parts = passages(text)
    own = "\n".join(t for level, t in parts if level == 0)
    out = {}
    for level, part in [(0, own), *((level, t) for level, t in parts if level)]:
        for piece in (part, *(line for line in part.split("\n") if len(line) >= MIN_LINE)):
            if n := normalised(piece):
                out[level, hashlib.blake2b(n.encode("utf-8", "surrogatepass"), digest_size=16).digest()] = len(n)
    return [(level, key, n) for (level, key), n in out.items()]


def quote(own: str | None, quoted: str | None) -> str:
    """The mail text of ``own`` below the mail text ``quoted``, with one more quote level."""
    return ("\n".join(">" + (" " if not x.startswith(">") else "") + x for x in quoted.split("\n")) + "\n" if quoted else "") + _SIGN.sub(" ", own or "")


def _parsed(messages: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(c, t, *k) for c, t, x in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True) for k in keys(x)]
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["conv_id", "turn", "level", "key", "size"])

    some = messages.where("conv_id IS NOT NULL AND turn IS NOT NULL AND text IS NOT NULL").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "text")
    return materialize(some.mapInArrow(run, "conv_id long, turn long, level int, key binary, size int"), "passages")


def parents(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, parent_conv, parent_turn) of the messages whose quotes were found."""
    parsed = _parsed(messages)
    own, quotes = parsed.where("level = 0"), parsed.where("level > 0")
    # Only passages that somebody quotes; then, in order of turns, the last own passage before each quote.
    asked = parsed.groupBy("conv_id", "key").agg(F.max("level").alias("deepest"), F.min("level").alias("least"))
    asked = asked.where("deepest > 0 AND least = 0").select("conv_id", "key")
    met = parsed.join(asked.withColumn("k", F.xxhash64("key")), ["conv_id", "key"], "left_semi")
    earlier = Window.partitionBy("conv_id", "key").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    near = met.withColumn("found", F.last(F.when(F.col("level") == 0, F.col("turn")), ignorenulls=True).over(earlier))
    near = near.where("level > 0 AND found IS NOT NULL").select("conv_id", "turn", "level", "key", "size", F.col("conv_id").alias("parent_conv"), F.col("found").alias("parent_turn"))
    far = quotes.join(near.select("conv_id", "turn", "level", "key"), ["conv_id", "turn", "level", "key"], "left_anti")
    # The first original of each of the two first conversations: one of them isn't the quote's own.
    first = own.groupBy("key", "conv_id").agg(F.min("turn").alias("turn"))
    first = first.withColumn("place", F.row_number().over(Window.partitionBy("key").orderBy("conv_id"))).where("place <= 2")
    first = first.groupBy("key").agg(F.min(F.struct("conv_id", "turn")).alias("o"), F.max(F.struct("conv_id", "turn")).alias("other"))
    far = splittable_join(far, first, "key").withColumn("o", F.when(F.col("o.conv_id") == F.col("conv_id"), F.col("other")).otherwise(F.col("o"))).where("o.conv_id <> conv_id")
    far = far.select("conv_id", "turn", "level", "key", "size", F.col("o.conv_id").alias("parent_conv"), F.col("o.turn").alias("parent_turn"))
    votes = near.unionByName(far).groupBy("conv_id", "turn", "level", "parent_conv", "parent_turn").agg(F.sum("size").alias("size"))
    same = (F.col("parent_conv") == F.col("conv_id")).cast("int")
    best = votes.groupBy("conv_id", "turn").agg(F.min(F.struct("level", (-same).alias("away"), (-F.col("size")).alias("less"), (-F.col("parent_turn")).alias("before"), "parent_conv", "parent_turn")).alias("p"))
    return best.select("conv_id", "turn", "p.parent_conv", "p.parent_turn")


def threads(nodes: DataFrame) -> DataFrame:
    """(conv_id, turn, parent_turn) to (conv_id, turn, thread, depth): the first message above, and the steps to it.

    Each round only takes the messages whose pointer hasn't reached the top, so the work is that of their depths.
    """
    start = nodes.select("conv_id", "turn", F.coalesce("parent_turn", "turn").alias("top"), F.col("parent_turn").isNotNull().cast("int").alias("depth"), F.col("parent_turn").isNull().alias("done"))
    active, at_top = materialize(start, "threads"), []
    for _ in range(ROUNDS):
        at_top.append(active.where("done"))
        climbing = active.where("NOT done")
        if climbing.isEmpty():
            break
        above = climbing
        for part in at_top:
            above = above.unionByName(part)
        above = above.select("conv_id", F.col("turn").alias("top"), F.col("top").alias("next"), F.col("depth").alias("more"), F.col("done").alias("arrived"))
        met = climbing.join(above, ["conv_id", "top"])
        active = materialize(met.select("conv_id", "turn", F.col("next").alias("top"), (F.col("depth") + F.col("more")).alias("depth"), F.col("arrived").alias("done")), "threads")
    out = at_top[0]
    for part in at_top[1:]:
        out = out.unionByName(part)
    return out.select("conv_id", "turn", F.col("top").alias("thread"), "depth")


def link_quotes(messages: DataFrame) -> DataFrame:
    """``messages`` with own text in place of text, and parent_conv, parent_turn, thread (turn of its first message) and depth.

    Ordered by conv_id, thread, depth and turn the rows are reply-ordered conversations.
    """
    found = materialize(parents(messages), "parents")
    places = messages.where("conv_id IS NOT NULL AND turn IS NOT NULL").select(F.col("conv_id").cast("long"), F.col("turn").cast("long")).distinct()
    within = found.where("parent_conv = conv_id").select("conv_id", "turn", "parent_turn")
    order = threads(places.join(within, ["conv_id", "turn"], "left"))
    cast = [F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn")]
    rest = [c for c in messages.columns if c not in ("conv_id", "turn", "text", "parent_conv", "parent_turn", "thread", "depth")]

    own = F.pandas_udf(lambda s: s.map(unquoted), "string")
    out = messages.select(*cast, *rest, F.coalesce(own(F.coalesce("text", F.lit(""))), F.lit("")).alias("text"))
    out = out.join(found, ["conv_id", "turn"], "left").join(order, ["conv_id", "turn"], "left")
    return out.withColumns({"thread": F.coalesce("thread", "turn"), "depth": F.coalesce("depth", F.lit(0))})


def as_mail(messages: DataFrame) -> DataFrame:
    """Conversations as mail threads: each message quotes the one before, which quotes the one before that."""
    keyed = messages.where("conv_id IS NOT NULL AND turn IS NOT NULL").groupBy("conv_id", "turn").agg(F.min("text").alias("quoted"))
    one = keyed.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("quoted").alias("__q1"))
    two = keyed.select("conv_id", (F.col("turn") + 2).alias("turn"), F.col("quoted").alias("__q2"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t, q1, q2 = (batch.column(c).to_pylist() for c in ("text", "__q1", "__q2"))
            texts = [None if x is None and a is None else quote(x, quote(a, quote(b, None)) if a is not None else None) for x, a, b in zip(t, q1, q2, strict=True)]
            yield batch.drop_columns(["__q1", "__q2"]).set_column(batch.schema.names.index("text"), "text", pa.array(texts, pa.string()))

    met = messages.join(one, ["conv_id", "turn"], "left").join(two, ["conv_id", "turn"], "left")
    schema = met.drop("__q1", "__q2").schema
    return met.mapInArrow(run, schema)


def op9_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations as mail, linked again: own text, parent, thread and depth of each message."""
    mail = materialize(as_mail(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")), "mail")
    return link_quotes(mail).select("conv_id", "turn", "role", "text", "parent_conv", "parent_turn", "thread", "depth")


ORACLE = """
WITH RECURSIVE m AS (SELECT conv_id, turn, min(text) text FROM conversations GROUP BY conv_id, turn),
p AS (SELECT a.conv_id, a.turn, b.turn parent_turn FROM m a LEFT JOIN m b ON b.conv_id = a.conv_id AND b.turn = a.turn - 1 AND trim(b.text) <> ''),
t AS (SELECT conv_id, turn, turn thread, 0 depth FROM p WHERE parent_turn IS NULL
      UNION ALL SELECT p.conv_id, p.turn, t.thread, t.depth + 1 FROM t JOIN p ON p.conv_id = t.conv_id AND p.parent_turn = t.turn)
SELECT c.conv_id, c.turn, c.role, coalesce(c.text, '') AS text, CASE WHEN p.parent_turn IS NOT NULL THEN c.conv_id END parent_conv, p.parent_turn, coalesce(t.thread, c.turn) thread, coalesce(t.depth, 0) depth
FROM conversations c LEFT JOIN p ON p.conv_id = c.conv_id AND p.turn = c.turn LEFT JOIN t ON t.conv_id = c.conv_id AND t.turn = c.turn
"""
