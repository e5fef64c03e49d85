"""Mixing sources to target weights by Pareto order sampling, in DataFrame operations only.

Targets.  Sources in code-point order (null last) take the weights in turn and
share the words of all documents by weight; no source gets more than ``most``
times its own words, and what that frees is shared again by weight.

Copies.  Within a source, documents fall into length classes (powers of two).  A
class is wanted in proportion to its words times its length to the power of
``-damping``, again at most ``most`` times: long documents, of which a few could
fill a source's share, give way a little to short ones.  That gives every document
an expected number of copies; the whole copies are certain, and the fraction left
is its inclusion probability p, which differs between documents.

Sample.  Every document has a uniform number u from a hash and ranks by its
random odds over its inclusion odds, (u / (1 - u)) / (p / (1 - p)).  From the
lowest rank on, documents get one more copy until the next would pass the source's
target: the sample's size is fixed in words.  What is then left, less than one
document, is filled in rank order with documents of at most half of it, ``FILLS``
times; the last one comes in if that is nearer to the target.

The cut is found by counting words below rank boundaries, in two rounds of
``BINS`` bins a source, added up map-side; only the rows of one bin of a bin are
ever put in order, so a source with a third of all rows needs no large sort, and
its rows meet one row per source only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from costloom.llm.common import SPACE, staged, table
from costloom.llm.registry import query

WEIGHTS = (5.0, 2.0, 1.0)
MOST = 3
DAMPING = 0.25
BINS = 1024
FILLS = 2
SEED = "mix"


def word_count(text):
    """Words of a text (runs without white space), 0 for null, without listing them."""
    one_each = F.regexp_replace(text, f"[{SPACE}]*+[^{SPACE}]++[{SPACE}]*+", "x")
    return F.when(text.rlike(f"[^{SPACE}]"), F.length(one_each)).otherwise(0).cast("long")


def share_out(rows: DataFrame, group: Sequence[str], total: str, weight: str, have: str, most: float) -> DataFrame:
    """``rows`` with ``target``: ``total`` shared by ``weight``, at most ``most`` x ``have`` each.

    What a full row leaves goes to the others by weight until none is above: in
    order of have / weight, the rows up to some point are full, and all others
    have the same target per unit of weight, the highest level at which a row fits.
    """
    over = Window.partitionBy(*group)
    order = over.orderBy(F.col(have) / F.col(weight), *[c for c in ("source_no", "class") if c in rows.columns])
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = F.col(total) - F.coalesce(F.sum(most * F.col(have)).over(before), F.lit(0.0))
    open_weight = F.sum(weight).over(order.rowsBetween(0, Window.unboundedFollowing))
    level = rest / open_weight
    out = rows.withColumn("_level", level).withColumn("_fits", F.col("_level") * F.col(weight) <= most * F.col(have))
    common = F.max(F.when(F.col("_fits"), F.col("_level"))).over(over)
    full = F.col("_level").isNull() | (F.col(weight) * F.coalesce(common, F.lit(float("inf"))) > most * F.col(have))
    return out.withColumn("target", F.when(full, most * F.col(have)).otherwise(F.col(weight) * common)).drop("_level", "_fits")


def source_targets(sized: DataFrame, weights: Sequence[float] = WEIGHTS, most: float = MOST) -> DataFrame:
    """One row per source: ``source``, ``source_no``, ``source_size`` and ``target`` in words."""
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    # One row per source, so ordering them all is small work whatever the corpus holds.
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), (F.col("source_no") % len(weights) + 1).cast("int"))
    listed = sources.withColumn("source_no", place).withColumn("weight", weight)
    listed = listed.withColumn("total", F.sum("source_size").over(Window.partitionBy(F.lit(0))).cast("double"))
    return share_out(listed, [], "total", "weight", "source_size", most).select("source", "source_no", "source_size", "target")


def draw(doc_id: Column, text: Column) -> Column:
    """A uniform number in (0, 1) that a document's doc_id and text decide."""
    name = F.concat_ws("|", F.lit(SEED), F.coalesce(doc_id.cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit(""))))
    return (F.conv(F.substring(F.md5(name), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, most: float = MOST, damping: float = DAMPING) -> DataFrame:
    """Every row of ``docs`` with how often the mix takes it.

    Returns ``doc_id``, ``source``, ``draw`` (the document's random number), ``size``
    (words), ``source_size``, ``target`` (the source's words, and those wanted),
    ``copies`` (0 to ``most``) and ``taken`` (words).  A null text has size 0 and, like
    every text without a word, gets no copy.  A null source is a source of its own,
    the last.  Equal ranks go by doc_id, then size; rows equal in doc_id, source and
    text are taken alike.  Other columns aren't read.  No rows give no rows.
    """
    text = F.col("text").cast("string")
    sized = staged(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
                               word_count(text).alias("size"), draw(F.col("doc_id"), text).alias("draw")))
    by_source = staged(source_targets(sized, weights, most))
    length_class = F.floor(F.log2(F.col("size") + 0.5)).cast("int")

    classes = sized.filter("size > 0").withColumn("class", length_class).groupBy("source", "class").agg(F.sum("size").alias("have"))
    classes = classes.join(by_source.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    classes = classes.withColumn("pull", F.col("have") * F.pow(F.lit(2.0), -damping * F.col("class")))
    wanted = share_out(classes.withColumnRenamed("target", "goal"), ["source_no"], "goal", "pull", "have", most)
    wanted = wanted.select(F.col("source_no").alias("_no"), F.col("class").alias("_class"), (F.col("target") / F.col("have")).alias("expected"))

    wanted = staged(wanted)
    rows = sized.join(by_source.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    rows = rows.withColumn("class", length_class)
    rows = rows.join(wanted, (F.col("source_no") == F.col("_no")) & (F.col("class") == F.col("_class")), "left").drop("_no", "_class", "class")
    # Nearly whole numbers are whole, so that no odds grow without bound.
    whole = F.floor(F.coalesce("expected", F.lit(0.0)) + 1e-9)
    rows = rows.withColumn("whole", F.when(F.col("size") > 0, F.least(whole, F.lit(most))).otherwise(0).cast("long"))
    p = F.greatest(F.coalesce("expected", F.lit(0.0)) - F.col("whole"), F.lit(0.0))
    odds = (F.col("draw") / (1 - F.col("draw"))) / (F.col("p") / (1 - F.col("p")))
    # odds / (1 + odds) keeps the order and lies between 0 and 1.
    rows = rows.withColumn("p", p).withColumn("rank", F.when((F.col("size") > 0) & (F.col("p") > 1e-9), odds / (1 + odds)))
    rows = staged(rows.drop("p", "expected").withColumn("more", F.lit(0).cast("long")))
    for last, part in zip(range(FILLS, -1, -1), (1.0, *[0.5] * FILLS)):
        rows = staged(_take(rows, part, nearest=last == 0))
    copies = F.col("whole") + F.col("more")
    return rows.select("doc_id", "source", "draw", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def take(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """Rows of ``docs``, all columns, each as often as ``mixed`` (from ``mix``) says."""
    names = ["_costloom_doc", "_costloom_source", "_costloom_draw"]
    wanted = mixed.filter("copies > 0").select(*[F.col(c).alias(n) for c, n in zip(("doc_id", "source", "draw"), names)], F.col("copies").alias("_costloom_copies"))
    text = F.col("text").cast("string")
    same = (F.col("doc_id").cast("long").eqNullSafe(F.col(names[0])) & F.col("source").cast("string").eqNullSafe(F.col(names[1]))
            & (draw(F.col("doc_id"), text) == F.col(names[2])))
    taken = docs.join(wanted.distinct(), same)
    return taken.withColumn("_costloom_copy", F.explode(F.sequence(F.lit(1), F.col("_costloom_copies").cast("int")))).select(*docs.columns)


def _take(rows: DataFrame, part: float, nearest: bool) -> DataFrame:
    """``rows`` with ``more`` set for the lowest ranks not yet taken that fit what a source still needs.

    Only documents of at most ``part`` of that need are asked (at 1: all of them).  The one
    that would pass the need stays out, or with ``nearest`` comes in if that is nearer.
    """
    have = F.sum((F.col("whole") + F.col("more")) * F.col("size"))
    need = staged(rows.groupBy("source_no").agg((F.first("target") - have).alias("need")))
    asked = F.col("rank").isNotNull() & (F.col("more") == 0) & (F.lit(part == 1.0) | (F.col("size") <= part * F.col("need")))
    first_bin = F.least(F.floor(F.col("rank") * BINS), F.lit(BINS - 1)).cast("long")
    second_bin = F.least(F.floor((F.col("rank") * BINS - F.col("bin")) * BINS), F.lit(BINS - 1)).cast("long")
    marked = rows.join(need, "source_no").withColumn("bin", F.when(asked, first_bin)).withColumn("fine", second_bin).drop("need")
    ranked = marked.filter("bin IS NOT NULL")
    coarse = staged(_cut(ranked.groupBy("source_no", "bin").agg(F.sum("size").alias("words")), need, "bin"))
    inside = ranked.join(coarse.select("source_no", F.col("at").alias("bin")), ["source_no", "bin"])
    fine = _cut(inside.groupBy("source_no", "fine").agg(F.sum("size").alias("words")), coarse.select("source_no", "need"), "fine")
    cuts = staged(coarse.select("source_no", F.col("at").alias("cut_bin")).join(
        fine.select("source_no", F.col("at").alias("cut_fine"), F.col("need").alias("cut_need")), "source_no", "left"))

    marked = marked.join(cuts, "source_no", "left")
    in_bin = F.col("bin") == F.col("cut_bin")
    at_cut = F.coalesce(in_bin & (F.col("fine") == F.col("cut_fine")), F.lit(False))
    below = F.col("bin").isNotNull() & F.coalesce((F.col("bin") < F.col("cut_bin")) | (in_bin & (F.col("fine") < F.col("cut_fine"))), F.col("cut_bin").isNull())
    marked = marked.withColumn("at_cut", at_cut).withColumn("below", below)
    order = Window.partitionBy("source_no").orderBy("rank", "doc_id", "size")
    # The sum takes in all rows of the same rank, doc_id and size: repeated rows come in together.
    edge = marked.filter("at_cut").withColumn("through", F.sum("size").over(order))
    peers = F.sum("size").over(Window.partitionBy("source_no", "rank", "doc_id", "size"))
    counted = F.col("through") - (peers / 2.0 if nearest else 0.0)
    edge = edge.withColumn("more", (counted <= F.col("cut_need")).cast("long")).drop("through")
    rest = marked.filter("NOT at_cut").withColumn("more", F.when(F.col("below"), F.lit(1)).otherwise(F.col("more")).cast("long"))
    return edge.unionByName(rest).select(*rows.columns)


def _cut(bins: DataFrame, need: DataFrame, name: str) -> DataFrame:
    """Per source the bin (``at``) in which the words reach ``need``, and what is needed from it.

    At most ``BINS`` rows a source.  A source whose bins all stay below has no row.
    """
    order = Window.partitionBy("source_no").orderBy(name)
    bins = bins.join(need, "source_no").withColumn("through", F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    first = F.row_number().over(order)
    over = bins.filter(F.col("through") >= F.col("need")).withColumn("_first", first).filter("_first = 1")
    return over.select("source_no", F.col(name).alias("at"), (F.col("need") - (F.col("through") - F.col("words"))).alias("need"))


def _shared_sql(name: str, rows: str, group: str, total: str, weight: str, have: str, tie: str) -> str:
    """``share_out`` as SQL: a relation ``name`` of ``rows`` with ``target``."""
    over = f"PARTITION BY {group}" if group else ""
    order = f"{over} ORDER BY {have} / {weight}, {tie}"
    return f"""{name}_level AS (SELECT *, ({total} - coalesce(sum({MOST} * {have}) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum({weight}) OVER ({order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM {rows}),
{name}_common AS (SELECT *, max(CASE WHEN level * {weight} <= {MOST} * {have} THEN level END) OVER ({over}) AS common FROM {name}_level),
{name} AS (SELECT *, CASE WHEN common IS NULL OR {weight} * common > {MOST} * {have} THEN {MOST} * {have} ELSE {weight} * common END AS wanted FROM {name}_common)"""


def _taken_sql(name: str, rows: str, part: float, nearest: bool) -> str:
    """``_take`` as SQL, in one order per source."""
    asked = "rank IS NOT NULL AND more = 0" + ("" if part == 1.0 else f" AND size <= {part} * need")
    half = " - sum(size) OVER (PARTITION BY source_no, asked, rank, doc_id, size) / 2.0" if nearest else ""
    return f"""{name}_need AS (SELECT *, target - sum((whole + more) * size) OVER (PARTITION BY source_no) AS need FROM {rows}),
{name}_asked AS (SELECT *, {asked} AS asked FROM {name}_need),
{name}_through AS (SELECT *, sum(size) OVER (PARTITION BY source_no, asked ORDER BY rank, doc_id, size){half} AS through FROM {name}_asked),
{name} AS (SELECT doc_id, size, source_size, target, source_no, whole, rank, CASE WHEN asked AND through <= need THEN 1 ELSE more END AS more FROM {name}_through)"""


MIX_SQL = f"""WITH sized AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
  (CAST('0x' || substr(md5('{SEED}|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || md5(coalesce(text, ''))), 1, 13) AS BIGINT) + 0.5) / {1 << 52}.0 AS draw FROM documents),
listed AS (SELECT source, sum(size)::DOUBLE AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS source_no,
  sum(sum(size)::DOUBLE) OVER () AS total FROM sized GROUP BY source),
weighed AS (SELECT *, list_extract([{', '.join(map(str, WEIGHTS))}], source_no % {len(WEIGHTS)} + 1)::DOUBLE AS weight FROM listed),
{_shared_sql('by_source', 'weighed', '', 'total', 'weight', 'source_size', 'source_no')},
docs AS (SELECT s.*, b.source_no, b.source_size, b.wanted AS goal, CASE WHEN s.size > 0 THEN CAST(floor(log2(s.size + 0.5)) AS INT) END AS class
  FROM sized s JOIN by_source b ON s.source IS NOT DISTINCT FROM b.source),
classes AS (SELECT source_no, class, goal, sum(size)::DOUBLE AS have, sum(size)::DOUBLE * pow(2.0, {-DAMPING} * class) AS pull FROM docs WHERE size > 0 GROUP BY source_no, class, goal),
{_shared_sql('by_class', 'classes', 'source_no', 'goal', 'pull', 'have', 'class')},
expected AS (SELECT d.*, d.goal AS target, coalesce(c.wanted / c.have, 0) AS e FROM docs d LEFT JOIN by_class c ON c.source_no = d.source_no AND c.class = d.class),
parts AS (SELECT *, CASE WHEN size > 0 THEN least(floor(e + 1e-9), {MOST}) ELSE 0 END AS whole FROM expected),
odds AS (SELECT *, greatest(e - whole, 0) AS p FROM parts),
ranked AS (SELECT *, CASE WHEN size > 0 AND p > 1e-9 THEN (draw / (1 - draw)) / (p / (1 - p)) END AS o FROM odds),
mixed AS (SELECT doc_id, size, source_size, target, source_no, whole, o / (1 + o) AS rank, 0 AS more FROM ranked),
{_taken_sql('mixed1', 'mixed', 1.0, False)},
{_taken_sql('mixed2', 'mixed1', 0.5, False)},
{_taken_sql('mixed3', 'mixed2', 0.5, True)}
SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, target, CAST((whole + more) * size AS BIGINT) AS taken, CAST(whole + more AS BIGINT) AS copies FROM mixed3"""


@query("op4_mix_sources", MIX_SQL)
def op4_mix_sources(spark, sf_dir):
    """Words the mix takes of every document, with sources weighing 5, 2, 1 in turn."""
    mixed = mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies")
