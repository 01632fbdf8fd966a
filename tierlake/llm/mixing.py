"""Operator 8: mixing sources to target weights by weighted fair queueing.

The documents of a source are put in a shuffled order (by a hash of the id)
and queue up, pass after pass, at most ``max_epochs`` passes. A document's
virtual finish time is the cumulative size of its source up to and including
it, divided by the source's target. All documents of all sources are sorted
by virtual finish time, and the queue is cut where the total size reaches the
budget. Sources thereby fill up in step: when the queue is cut, each has got
about the same share of its target.

Targets share the budget by weight, but none exceeds ``max_epochs`` times its
source's size; what is over is shared again by weight among the others until
none is above (water filling, in closed form).

Neither a hot source nor the whole queue ever meets in one task. A source's
order is dealt into slices of about ``SLICE`` documents by the leading digits
of the hash; running sizes are summed within slices, and slices are offset by
the totals of those before them. Likewise the queue is dealt into bins of
virtual time; the totals of the bins locate the cut, and only documents of
the one bin that holds it are summed one by one.

Sizes and ids are gathered once into a stored table; texts aren't shuffled.

Defined results: size 0 (NULL or empty text) is never taken; a NULL source is
a source of its own; rows that repeat source, id and size (rows with a NULL id
too) are one entry, which queues row by row, or in 1000 parts where it has more
rows; the cut may fall inside a part: then as many of its rows as fit are taken.
``decide`` doesn't tell such rows
apart; ``mix`` takes the first ones as they are stored. Extra columns pass
through; an empty table gives no rows; texts of any length are only counted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tierlake.llm.frames import WORD, free_prefix
from tierlake.session import cut_lineage

#: Documents of a slice of a source and of a bin of the queue, about.
SLICE = 2000
#: Parts that an entry of many equal rows queues in, at most.
PARTS = 1000


def word_count(text: str = "text") -> Column:
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("long")


def cyclic_weights(sizes: DataFrame, cycle: tuple[int, ...], source: str) -> DataFrame:
    """Weights that repeat ``cycle`` over the sources by code point, NULL last
    (``sizes`` has a row a source)."""
    place = F.row_number().over(Window.orderBy(F.col(source).asc_nulls_last())) - 1
    return sizes.withColumn("weight", F.element_at(
        F.array(*[F.lit(float(w)) for w in cycle]), (place % len(cycle) + 1).cast("int")))


def water_filled(weighted: DataFrame, budget_ratio: float, max_epochs: int, source: str) -> DataFrame:
    """``weighted`` (source, source_size, weight; a row a source) with its
    target.

    Sources fill up in the order of cap / weight. With the first k of them at
    their caps, the rest share what is left at the level
    (budget - caps) / weights. The first k whose next source isn't filled at
    that level is the answer; later ones give lower levels."""
    cap = F.col("source_size") * max_epochs
    by_fill = Window.orderBy("fill", F.col(source).asc_nulls_last())
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everywhere = by_fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    budget = F.sum("source_size").over(everywhere) * F.lit(budget_ratio)
    level = (budget - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(onward)
    level = F.when(F.col("fill") >= level, level)
    return (weighted.withColumn("cap", cap).withColumn("fill", F.col("cap") / F.col("weight"))
            .withColumn("level", level)
            .withColumn("level", F.max("level").over(everywhere))
            .withColumn("target", F.least(F.col("cap").cast("double"),
                                          F.coalesce(F.col("level") * F.col("weight"), F.col("cap").cast("double"))))
            .drop("cap", "fill", "level"))


def queue_key(doc_id: str, seed: int) -> Column:
    """The shuffled order within a source: hex digits of a hash of the id."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))).cast("binary"))


def _same(a: DataFrame, b: DataFrame, *keys: str) -> Column:
    """Equal keys, NULL equal to NULL."""
    out = F.lit(True)
    for k in keys:
        out = out & a[k].eqNullSafe(b[k])
    return out


def _running(entries: DataFrame) -> DataFrame:
    """``entries`` with ``cum``: total size of its source up to each entry."""
    slices = entries.groupBy("source").agg(F.ceil(F.count("*") / SLICE).alias("slices"))
    digits = F.conv(F.substring("key", 1, 8), 16, 10).cast("double") / float(16**8)
    dealt = entries.join(slices.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))) \
        .withColumn("slice", F.floor(digits * F.col("slices"))).drop("s", "slices")
    inside = Window.partitionBy("source", "slice").orderBy("key", "doc_id", "size").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    totals = dealt.groupBy("source", "slice").agg(F.sum("total").alias("t"))
    earlier = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(F.col("source").alias("s"), F.col("slice").alias("n"),
                            F.coalesce(F.sum("t").over(earlier), F.lit(0)).alias("offset"))
    return dealt.withColumn("cum", F.sum("total").over(inside)).join(
        offsets, F.col("source").eqNullSafe(F.col("s")) & (F.col("slice") == F.col("n"))) \
        .withColumn("cum", F.col("cum") + F.col("offset")).drop("s", "n", "offset", "slice")


def _parts(running: DataFrame) -> DataFrame:
    """Entries split into parts of equally many rows (the last may have
    fewer), with their own rows, total and cum."""
    step, first = F.ceil(F.col("rows") / PARTS), F.col("part") * F.col("step")
    split = running.withColumn("step", step).withColumn(
        "part", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("rows") / step) - 1)))
    start = F.col("cum") - F.col("total")
    return (split.withColumn("own", F.least("step", F.col("rows") - first))
            .withColumn("cum", start + F.col("size") * (first + F.col("own")))
            .withColumn("total", F.col("size") * F.col("own")).withColumn("rows", F.col("own"))
            .drop("step", "part", "own"))


def plan(docs: DataFrame, cycle: tuple[int, ...] = (3, 1, 2), budget_ratio: float = 1.5,
         max_epochs: int = 2, seed: int = 42, doc_id: str = "doc_id", source: str = "source",
         size: str = "size") -> DataFrame:
    """What the mix takes: a row for each (source, doc_id, size) of ``docs``
    with its rows, source_size, target and copies (0 to ``max_epochs``);
    ``extra`` of its rows are taken once more. Runs jobs."""
    entries = cut_lineage(docs.groupBy(
        F.col(source).alias("source"), F.col(doc_id).alias("doc_id"), F.col(size).alias("size")).agg(
        F.count("*").alias("rows")).withColumn("total", F.col("size") * F.col("rows"))
        .withColumn("key", queue_key("doc_id", seed)))
    sizes = entries.groupBy("source").agg(F.sum("total").alias("source_size"))
    targets = cut_lineage(water_filled(cyclic_weights(sizes, cycle, "source"), budget_ratio, max_epochs, "source"))
    running = _running(entries.where("total > 0"))
    named = targets.select(F.col("source").alias("s"), "source_size", "target")
    queue = _parts(running).join(named, F.col("source").eqNullSafe(F.col("s"))).drop("s").where("target > 0")
    passes = F.explode(F.sequence(F.lit(0), F.lit(max_epochs - 1)))
    queue = cut_lineage(queue.withColumn("epoch", passes).withColumn(
        "finish", (F.col("cum") + F.col("epoch") * F.col("source_size")) / F.col("target"))
        .select("source", "doc_id", "size", "rows", "total", "key", "epoch", "finish"))
    taken = _truncated(queue, targets, budget_ratio).groupBy("source", "doc_id", "size").agg(
        F.sum("fit").alias("fit"))
    taken = taken.select(*[F.col(c).alias("_" + c) for c in taken.columns])
    match = (F.col("source").eqNullSafe(F.col("_source")) & F.col("doc_id").eqNullSafe(F.col("_doc_id"))
             & (F.col("size") == F.col("_size")))
    fit = F.coalesce("_fit", F.lit(0)).cast("long")
    all_entries = entries.join(taken, match, "left").select(
        "source", "doc_id", "size", "rows", F.floor(fit / F.col("rows")).alias("copies"),
        (fit % F.col("rows")).alias("extra"))
    return all_entries.join(named, F.col("source").eqNullSafe(F.col("s"))).drop("s")


def decide(docs: DataFrame, **options) -> DataFrame:
    """A row for each row of ``docs`` (doc_id, source, size): doc_id, source,
    size, source_size, target and copies."""
    planned = plan(docs, **options)
    each = planned.withColumn("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    copies = F.col("copies") + (F.col("row") <= F.col("extra")).cast("long")
    return each.select("source", "doc_id", "size", copies.alias("copies"), "source_size", "target")


def _truncated(queue: DataFrame, targets: DataFrame, budget_ratio: float) -> DataFrame:
    """The entries at the head of the queue, each with ``fit``: how many of
    its rows the budget holds."""
    budget = F.floor(F.sum("source_size") * F.lit(budget_ratio)).alias("budget")
    total = targets.agg(budget).first().budget or 0
    extent = queue.agg(F.count("*").alias("n"), F.max("finish").alias("last")).first()
    bins = max(1, -(-extent.n // SLICE))
    scale = (extent.last or 1.0) / bins
    binned = queue.withColumn("bin", F.floor(F.col("finish") / F.lit(scale)))
    earlier = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    offsets = binned.groupBy("bin").agg(F.sum("total").alias("t")).withColumn(
        "before", F.coalesce(F.sum("t").over(earlier), F.lit(0)))
    edge = offsets.where(F.col("before") + F.col("t") > total).orderBy("bin").limit(1).collect()
    whole = queue.withColumn("fit", F.col("rows"))
    if not edge:
        return whole
    edge = edge[0]
    order = Window.orderBy("finish", F.col("source").asc_nulls_last(), "key", "doc_id", "size")
    upto = F.sum("total").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    # Whole numbers throughout: what is left of the budget, in rows.
    left = F.lit(total - edge.before) - (upto - F.col("total"))
    fit = F.expr("least(rows, greatest(left, 0) div size)")
    last_bin = binned.where(F.col("bin") == edge.bin).withColumn("left", left).withColumn("fit", fit)
    head = binned.where(F.col("bin") < edge.bin).withColumn("fit", F.col("rows"))
    return head.drop("bin").unionByName(last_bin.drop("bin", "left")).where("fit > 0")


def _first_rows(rows: DataFrame, entry: str, extra: str, p: str) -> DataFrame:
    """Of each entry the first ``extra`` rows as they are stored. An entry's
    rows are numbered inside each stored partition and those of the partitions
    before are added, so its rows needn't meet in one task."""
    stored = cut_lineage(rows).withColumn(f"{p}at", F.monotonically_increasing_id()) \
        .withColumn(f"{p}part", F.shiftright(f"{p}at", 33))
    inside = Window.partitionBy(entry, f"{p}part").orderBy(f"{p}at")
    before = Window.partitionBy(f"{p}e").orderBy(f"{p}q").rowsBetween(Window.unboundedPreceding, -1)
    sizes = stored.groupBy(F.col(entry).alias(f"{p}e"), F.col(f"{p}part").alias(f"{p}q")).agg(
        F.count("*").alias(f"{p}n")).withColumn(f"{p}before", F.coalesce(F.sum(f"{p}n").over(before), F.lit(0)))
    return stored.withColumn(f"{p}row", F.row_number().over(inside)).join(
        sizes, (F.col(entry) == F.col(f"{p}e")) & (F.col(f"{p}part") == F.col(f"{p}q"))).where(
        F.col(f"{p}before") + F.col(f"{p}row") <= F.col(extra))


def mix(df: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source",
        **options) -> DataFrame:
    """``df`` as the mix takes it: a row for each time that a document is
    taken. Texts are joined to the plan by id, not carried through it."""
    p = free_prefix(df)
    sized = df.withColumn(f"{p}size", word_count(text))
    taken = cut_lineage(plan(sized.select(doc_id, source, F.col(f"{p}size").alias("size")), doc_id=doc_id,
                             source=source, **options).where("copies > 0 or extra > 0").select(
        F.col("source").alias(f"{p}source"), F.col("doc_id").alias(f"{p}id"),
        F.col("size").alias(f"{p}words"), F.col("copies").alias(f"{p}copies"), F.col("extra").alias(f"{p}extra")))
    match = (F.col(doc_id).eqNullSafe(F.col(f"{p}id")) & F.col(source).eqNullSafe(F.col(f"{p}source"))
             & (F.col(f"{p}size") == F.col(f"{p}words")))
    whole = taken.where(F.col(f"{p}copies") > 0)
    passes = F.explode(F.sequence(F.lit(1), F.col(f"{p}copies")))
    out = sized.join(whole, match).withColumn(f"{p}pass", passes).select(*[F.col(c) for c in df.columns])
    cut = taken.where(F.col(f"{p}extra") > 0).withColumn(f"{p}entry", F.monotonically_increasing_id())
    if cut.isEmpty():  # always, where no two rows share source, id and size
        return out
    first = _first_rows(sized.join(cut, match), f"{p}entry", f"{p}extra", p)
    return out.unionByName(first.select(*[F.col(c) for c in df.columns]))
