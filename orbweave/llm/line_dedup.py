"""Line dedup with a log-template tree of fixed depth.

A line goes down the tree by its token count, then by its DEPTH leading tokens, to a leaf; tokens with a digit are
variable fields, ``<*>`` at every level. In a leaf, a token is fixed if it holds its position in LEAF_DOCS texts and
in LEAF_SHARE of the leaf's; where at least FIXED_SHARE of a line's positions below the lead are fixed, the others
become ``<*>``. Lines that then are equal share a template, so a name or a title that varies is generalised although
it has no digit. Other lines are templates of their own.

A template recurs if it stands in as many texts as TIERS asks for its length, or LEAF_DOCS if its leaf generalised it.
Its first line (lowest doc_id, then position) stays, all others are dropped. Equal texts are one text here: a line
recurs in different texts, and copies of a whole text are treated alike, unless ``copies`` is set: then each document
counts, and only the first copy keeps its lines. Lines of which VARIABLE_SHARE of the tokens or more are variable are
never dropped: by default those without any fixed token, which a table of numbers is made of. All of these are
parameters of :func:`drop_recurring_lines`.

Only DataFrame functions run. Lines are grouped by 64-bit hashes of their template within leaves (token count and a
64-bit hash of the lead), and texts are told apart by 96 bits of two hashes, so what is shuffled for a line doesn't depend on
its length. Texts are counted for each template after a first aggregation by template and text. Tokens are only
compared for leaves that have several templates and enough texts, over distinct templates. Joins back are ones that
adaptive execution can split, so a line that stands in a third of all documents does not meet in one task.

Null texts stay null; empty texts stay empty. A null doc_id comes first in order. A document may lose all its lines
and is empty then. Extra columns are kept, whatever their names; ``lines_dropped`` is replaced. An empty table gives
an empty table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orbweave.plans.shared import materialize, splittable_join

#: (least tokens, least texts): long lines recur from two texts on, very short ones from a hundred.
TIERS = ((20, 2), (5, 10), (1, 100))
#: Share of variable tokens from which on a line is never dropped.
VARIABLE_SHARE = 1.0
#: Leading tokens of which each is a level of the tree.
DEPTH = 3
#: Texts, and share of a leaf's texts, in which a fixed token holds its position; share of positions that are fixed.
LEAF_DOCS, LEAF_SHARE, FIXED_SHARE = 10, 0.2, 0.7

#: Most rows of a table of templates (up to 80 bytes each) that is broadcast; larger ones are joined by a shuffle.
BROADCAST_TEMPLATES = 100_000

#: From the start of a token that has a digit to its end.
VARIABLE = r"(?<![^ \t\r\f])[^ \t\r\f0-9]*+[0-9][^ \t\r\f]*"
MISSING = -(1 << 63)
LEAF = ["tokens", "lead"]
#: What tells texts (or, with ``copies``, documents) apart.
TEXT = ["h", "g"]


def generalised(line: Column) -> Column:
    """The line with single spaces and its variable fields as ``<*>``."""
    masked = F.when(line.rlike("[0-9]"), F.regexp_replace(line, VARIABLE, "<*>")).otherwise(line)
    plain = F.trim(F.translate(masked, "\t\r\f", "   "))
    return F.when(plain.contains("  "), F.regexp_replace(plain, " +", " ")).otherwise(plain)


def _tokens(text: Column) -> Column:
    """Token count of text with single spaces."""
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit(""))) + 1


def _text(copies: bool) -> list[Column]:
    of = ["text", "doc_id"] if copies else ["text"]
    return [F.xxhash64(*of).alias("h"), F.hash(*of).alias("g")]


def template_lines(docs: DataFrame, variable_share: float = VARIABLE_SHARE, copies: bool = False) -> DataFrame:
    """A row for each line that may recur: doc_id d, text h and g, position, and its way down the tree."""
    lines = docs.where(F.col("text").isNotNull()).select(F.coalesce(F.col("doc_id").cast("long"), F.lit(MISSING)).alias("d"), *_text(copies), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    lines = lines.withColumn("t", generalised(F.col("line"))).where("t <> ''").withColumn("tokens", _tokens(F.col("t")))
    fields = F.when(F.col("t").contains("<*>"), F.size(F.filter(F.split("t", " "), lambda x: x == "<*>"))).otherwise(0)
    lines = lines.where(fields < F.lit(float(variable_share)) * F.col("tokens"))
    return lines.select("d", *TEXT, "pos", "tokens", F.xxhash64(F.substring_index("t", " ", DEPTH)).alias("lead"), F.xxhash64("t").alias("template"), "t")


def _small(table: DataFrame, name: str) -> DataFrame:
    """``table``, written, to be broadcast if it has at most BROADCAST_TEMPLATES rows."""
    table = materialize(table, name)
    return F.broadcast(table) if table.count() <= BROADCAST_TEMPLATES else table


def _counted(lines: DataFrame, *keys: str) -> DataFrame:
    """For each group of lines the number of texts, and its first line."""
    by_text = lines.groupBy(*keys, *TEXT).agg(F.min("d").alias("d"), F.min("pos").alias("pos"))
    return by_text.groupBy(*keys).agg(F.count("*").alias("docs"), F.min(F.struct("d", *TEXT, "pos")).alias("first"))


def leaf_templates(lines: DataFrame, templates: DataFrame) -> DataFrame:
    """(tokens, lead, template, shape) of the lines that their leaf generalises; lines of one shape share a template."""
    leaves = templates.where(F.col("tokens") > DEPTH).groupBy(*LEAF).agg(F.sum("docs").alias("n"), F.count("*").alias("k")).where((F.col("k") > 1) & (F.col("n") >= LEAF_DOCS))
    some = _small(templates.join(leaves.select(*LEAF, "n"), LEAF).select(*LEAF, "template", "docs", "n", "first"), "leaf-lines")
    # The tokens of each distinct template, from its first line.
    text = lines.join(some, [*LEAF, "template"]).where("d = first.d AND h = first.h AND g = first.g AND pos = first.pos").dropDuplicates([*LEAF, "template"])
    token = text.select(*LEAF, "template", "docs", "n", F.posexplode(F.split("t", " ")).alias("p", "token")).where((F.col("p") >= DEPTH) & (F.col("token") != "<*>"))
    place = [*LEAF, "p", "token"]
    fixed = token.groupBy(*place, "n").agg(F.sum("docs").alias("held")).where((F.col("held") >= LEAF_DOCS) & (F.col("held") >= F.lit(LEAF_SHARE) * F.col("n")))
    kept = token.join(fixed.select(*place), place, "left_semi")
    shapes = kept.groupBy(*LEAF, "template").agg(F.count("*").alias("k"), F.array_sort(F.collect_list(F.struct("p", "token"))).alias("parts"))
    below = F.col("tokens") - DEPTH
    shapes = shapes.where((F.col("k") >= F.lit(FIXED_SHARE) * below) & (F.col("k") < below))
    return shapes.select(*LEAF, "template", F.xxhash64("parts").alias("shape"))


def recurring(lines: DataFrame, tiers: tuple[tuple[int, int], ...] = TIERS) -> DataFrame:
    """(tokens, lead, template, first): the templates that recur, with the first line of what they are generalised to."""
    templates = materialize(_counted(lines, *LEAF, "template"), "templates")
    shapes = _small(leaf_templates(lines, templates), "leaf-templates")
    wide = _counted(lines.join(shapes, [*LEAF, "template"]), *LEAF, "shape").where(F.col("docs") >= LEAF_DOCS)
    wide = shapes.join(wide, [*LEAF, "shape"]).select(*LEAF, "template", F.col("first").alias("wide"))
    often = reduce(lambda a, b: a | b, ((F.col("tokens") >= least) & (F.col("docs") >= docs) for least, docs in tiers))
    found = templates.join(wide, [*LEAF, "template"], "left").where(often | F.col("wide").isNotNull())
    return _small(found.select(*LEAF, "template", F.coalesce("wide", "first").alias("first")), "recurring")


def drop_recurring_lines(docs: DataFrame, tiers: tuple[tuple[int, int], ...] = TIERS, variable_share: float = VARIABLE_SHARE, copies: bool = False) -> DataFrame:
    """``docs`` with text without the dropped lines, and lines_dropped."""
    docs = docs.drop("lines_dropped")
    lines = materialize(template_lines(docs, variable_share, copies), "template-lines")
    key = F.xxhash64("template", *LEAF)
    found = recurring(lines, tiers)
    hits = lines.withColumn("k", key).join(found.withColumn("k", key), [*LEAF, "template", "k"])
    gone = hits.where("NOT (h = first.h AND g = first.g AND pos = first.pos)")
    drops = gone.groupBy(F.struct(*TEXT).alias("__text")).agg(F.collect_set("pos").alias("__drop"))
    joined = splittable_join(docs.withColumn("__text", F.struct(*_text(copies))), drops, "__text", "left")
    kept = F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains("__drop", i))
    out = joined.withColumn("lines_dropped", F.when(F.col("text").isNull() | F.col("__drop").isNull(), 0).otherwise(F.size("__drop")))
    return out.withColumn("text", F.when(F.col("lines_dropped") > 0, F.array_join(kept, "\n")).otherwise(F.col("text"))).select(*docs.columns, "lines_dropped")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return drop_recurring_lines(docs).withColumn("n_chars", F.length("text").cast("long"))


ORACLE = rf"""
WITH d AS (SELECT text, min(doc_id) d FROM documents WHERE text IS NOT NULL GROUP BY text),
s AS (SELECT d, string_split(text, chr(10)) a FROM d),
e AS (SELECT d, unnest(a) line, unnest(range(len(a))) pos FROM s),
t AS (SELECT d, pos, trim(regexp_replace(regexp_replace(line, '[^ \t\r\f0-9]*[0-9][^ \t\r\f]*', '<*>', 'g'), '[ \t\r\f]+', ' ', 'g'), ' ') t FROM e),
l AS (SELECT d, pos, t, string_split(t, ' ') a FROM t WHERE t <> ''),
c AS (SELECT d, pos, t, len(a) tokens, array_to_string(a[1:{DEPTH}], ' ') lead FROM l WHERE len([x FOR x IN a IF x = '<*>']) < {VARIABLE_SHARE}::DOUBLE * len(a)),
r AS (SELECT t, tokens, lead, count(DISTINCT d) docs, min((d, pos)) first FROM c GROUP BY t, tokens, lead),
f AS (SELECT tokens, lead, sum(docs) n FROM r WHERE tokens > {DEPTH} GROUP BY tokens, lead HAVING count(*) > 1 AND sum(docs) >= {LEAF_DOCS}),
k AS (SELECT r.t, tokens, lead, docs, n, unnest(string_split(r.t, ' ')) token, unnest(range(tokens)) p FROM r JOIN f USING (tokens, lead)),
b AS (SELECT * FROM k WHERE p >= {DEPTH} AND token <> '<*>'),
m AS (SELECT tokens, lead, p, token FROM b GROUP BY tokens, lead, p, token, n HAVING sum(docs) >= {LEAF_DOCS} AND sum(docs) >= {LEAF_SHARE}::DOUBLE * n),
g AS (SELECT t, tokens, lead, list((p, token) ORDER BY p) parts FROM b JOIN m USING (tokens, lead, p, token) GROUP BY t, tokens, lead HAVING count(*) >= {FIXED_SHARE}::DOUBLE * (tokens - {DEPTH}) AND count(*) < tokens - {DEPTH}),
w AS (SELECT g.tokens, g.lead, parts, min((d, pos)) first FROM c JOIN g ON c.t = g.t GROUP BY g.tokens, g.lead, parts HAVING count(DISTINCT d) >= {LEAF_DOCS}),
x AS (SELECT r.t, coalesce(w.first, r.first) first FROM r LEFT JOIN g ON g.t = r.t LEFT JOIN w ON w.tokens = g.tokens AND w.lead = g.lead AND w.parts = g.parts
      WHERE w.first IS NOT NULL OR {" OR ".join(f"r.tokens >= {n} AND r.docs >= {k}" for n, k in TIERS)}),
z AS (SELECT c.d, list(c.pos) drops FROM c JOIN x ON x.t = c.t WHERE (c.d, c.pos) <> x.first GROUP BY c.d),
u AS (SELECT d.text, len(drops)::INT lines_dropped, array_to_string([line FOR line, i IN string_split(d.text, chr(10)) IF NOT list_contains(drops, i - 1)], chr(10)) clean FROM d JOIN z ON z.d = d.d)
SELECT o.doc_id, coalesce(u.clean, o.text) AS text, coalesce(u.lines_dropped, 0)::INT lines_dropped, length(coalesce(u.clean, o.text)) n_chars
FROM documents o LEFT JOIN u ON o.text = u.text
"""
