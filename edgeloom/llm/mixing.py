"""Mixing sources to target weights by weighted fair queueing (native).

Every document is a packet of its source's queue, in shuffled order; a queue
may be replayed up to ``max_epochs`` times. A packet's virtual finish time is
its queue's cumulative words divided by the source's weight. All packets are
ranked by finish time and the ranking is cut where the words taken reach the
budget. DataFrame functions only.

How it scales: no step holds one source in a task. Cumulative words are prefix
sums in two levels: over shuffle-key slots of a source (a small aggregate), then
over the documents of one slot. The global ranking is cut by a histogram of
finish times; only the bin that holds the cut is sorted. The per-source table has one row for each
distinct source and passes through streaming windows.

Defined cases: a null or blank text has size 0 and is never taken; a null
source is a source of its own, ranked last; repeated rows are queued one by
one, in the order (key, doc_id, size); texts of any length count whole; an empty table gives an empty
result; other columns of the input pass through untouched in ``mix_documents``
and are ignored by ``mixing_plan``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edgeloom.llm.common import WORD, save

#: Documents per slot or histogram bin aimed at.
ROWS_PER_SLOT = 50_000
SLOTS_MAX = 65_536


def word_count(text: Column) -> Column:
    """Number of runs of characters outside space and \\t \\n \\v \\f \\r; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), max_epochs: int = 3) -> DataFrame:
    """One row per source: weight, words, target.

    ``sizes`` has source, source_size. Targets share all words by weight; a
    target stops at ``max_epochs`` times its source's words and the excess is
    reshared by weight until none is above. Sorted by cap/weight, the capped
    sources are a prefix, found with running sums of exact decimals.
    """
    big = "decimal(38,0)"
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(int(w)).cast("long") for w in weights])
    ranked = sizes.withColumn("source_rank", F.row_number().over(by_name).cast("long")).withColumn(
        "weight", F.element_at(cycle, ((F.col("source_rank") - 1) % len(weights) + 1).cast("int"))
    )
    ranked = ranked.withColumn("cap", F.col("source_size") * max_epochs)
    total = Window.partitionBy()
    order = Window.orderBy(F.col("cap") / F.col("weight"), "source_rank")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    steps = (
        ranked.withColumn("words", F.sum(F.col("source_size").cast(big)).over(total))
        .withColumn("all_weight", F.sum(F.col("weight").cast(big)).over(total))
        .withColumn("left_words", F.col("words") - F.coalesce(F.sum(F.col("cap").cast(big)).over(before), F.lit(0)))
        .withColumn("left_weight", F.col("all_weight") - F.sum(F.col("weight").cast(big)).over(after) + F.col("weight"))
        .withColumn("free", F.col("cap").cast(big) * F.col("left_weight") > F.col("left_words") * F.col("weight"))
    )
    # All sources from the first free one on get the same level (words per weight).
    pinned = F.first(
        F.when(F.col("free"), F.struct(F.col("left_words").cast("double").alias("w"), F.col("left_weight").cast("double").alias("k"))),
        ignorenulls=True,
    )
    steps = steps.withColumn("level", pinned.over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    level = F.col("level.w") / F.col("level.k")
    target = F.when(F.col("level").isNull() | (F.col("cap") <= level * F.col("weight")), F.col("cap").cast("double")).otherwise(level * F.col("weight"))
    return steps.select("source", "source_rank", "weight", "source_size", "words", target.alias("target"))


def mixing_plan(
    docs: DataFrame,
    weights: tuple[int, ...] = (5, 2, 1),
    max_epochs: int = 3,
    rows_per_slot: int = ROWS_PER_SLOT,
) -> DataFrame:
    """(doc_id, source, size, source_size, target, epochs, taken) for each row of docs.

    ``epochs`` is how often the mix takes the document, ``taken`` its words times that.
    """
    slim = save(
        docs.select("doc_id", "source", word_count(F.col("text")).alias("size")).withColumn(
            "key", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
        ),
        "mix-sizes",
    )
    rows = slim.count()
    slots = int(min(SLOTS_MAX, max(16, 2 ** (rows // rows_per_slot).bit_length())))
    slim = slim.withColumn("slot", F.floor(F.conv(F.substring("key", 1, 4), 16, 10).cast("long") * slots / 65_536).cast("int"))

    per_slot = slim.groupBy("source", "slot").agg(F.sum("size").alias("slot_size"))
    per_slot = save(per_slot, "mix-slots")
    sources = source_targets(per_slot.groupBy("source").agg(F.sum("slot_size").alias("source_size")), weights, max_epochs)
    upto = Window.partitionBy("source").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    per_slot = per_slot.withColumn("start", F.coalesce(F.sum("slot_size").over(upto), F.lit(0)))
    # Names of sources are compared null-safely: a null source is a source too.
    heads = per_slot.alias("p").join(sources.alias("s"), F.col("p.source").eqNullSafe(F.col("s.source"))).select(
        F.col("p.source").alias("h_source"), F.col("p.slot").alias("h_slot"), "start", "source_rank", "weight", "source_size", "words", "target"
    )
    heads = save(heads, "mix-heads")

    queued = slim.join(heads, slim.source.eqNullSafe(heads.h_source) & (slim.slot == heads.h_slot), "inner").drop("h_source", "h_slot")
    inside = Window.partitionBy("source_rank", "slot").orderBy("key", F.col("doc_id").asc_nulls_last(), "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    queued = queued.withColumn("done", F.col("start") + F.sum("size").over(inside))
    queued = save(queued.select("doc_id", "source", "size", "source_rank", "weight", "source_size", "words", "target", "done"), "mix-queue")

    cut = _cut(queued, max_epochs, slots)
    finish = [_finish(epoch) for epoch in range(max_epochs)]
    packets = [F.when(F.struct(f, F.col("source_rank")) <= F.struct("cut_finish", "cut_rank"), 1).otherwise(0) for f in finish]
    epochs = packets[0]
    for more in packets[1:]:
        epochs = epochs + more
    return (
        queued.join(F.broadcast(cut), how="left")  # exactly one row or none
        .withColumn("epochs", F.when(F.col("size") > 0, F.coalesce(epochs, F.lit(0))).otherwise(0))
        .select("doc_id", "source", "size", "source_size", "target", "epochs", (F.col("size") * F.col("epochs")).alias("taken"))
    )


def _finish(epoch: int) -> Column:
    """Virtual finish time of a document's packet in a given replay of its queue."""
    return (F.col("done") + epoch * F.col("source_size")).cast("double") / F.col("weight")


def _cut(queued: DataFrame, max_epochs: int, bins: int) -> DataFrame:
    """The last packet (finish time, source rank) within the budget: at most one row."""
    packets = queued.where("size > 0").select(
        "source_rank", "size", "words", F.explode(F.array(*[_finish(e) for e in range(max_epochs)])).alias("finish")
    )
    # With every queue served at its weight, a bin of finish times holds at most
    # width x (sum of weights) words; the width is set from the largest finish time.
    top = packets.agg(F.max("finish").alias("top")).first()["top"] or 1.0
    packets = packets.withColumn("bin", F.floor(F.col("finish") / F.lit(float(top)) * (8 * bins)).cast("long"))
    table = packets.groupBy("bin").agg(F.sum("size").alias("bin_size"), F.max("words").alias("words"))
    upto = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    table = table.withColumn("reached", F.sum("bin_size").over(upto))
    # Bins wholly within the budget, and the first one that passes it.
    fits = table.where("reached <= words").agg(F.max("bin").alias("b"), F.max("reached").alias("r")).first()
    passes = table.where("reached > words").agg(F.min("bin").alias("b")).first()["b"]
    last, reached = fits["b"], fits["r"] or 0
    if passes is None:
        edge = packets.where(F.col("bin") == F.lit(last)) if last is not None else packets.limit(0)
        return edge.agg(F.max(F.struct("finish", "source_rank")).alias("c")).where("c IS NOT NULL").select(
            F.col("c.finish").alias("cut_finish"), F.col("c.source_rank").alias("cut_rank")
        )
    ordered = Window.orderBy("finish", "source_rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edge = packets.where(F.col("bin") == passes).withColumn("reached", F.lit(int(reached)) + F.sum("size").over(ordered))
    inside = edge.where("reached <= words").select("finish", "source_rank")
    if last is not None:
        inside = inside.unionByName(packets.where(F.col("bin") == F.lit(last)).select("finish", "source_rank"))
    return inside.agg(F.max(F.struct("finish", "source_rank")).alias("c")).where("c IS NOT NULL").select(
        F.col("c.finish").alias("cut_finish"), F.col("c.source_rank").alias("cut_rank")
    )


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: each row of docs as often as the mix takes it.

    Rows alike in doc_id, source and size (a row that repeats, as a rule) are taken as
    often as the plan takes them together: the first by text as often as the first of
    them in the queue, and so on.
    """
    alike = [F.coalesce("doc_id", F.lit(0)).alias("k_id"), F.col("doc_id").isNull().alias("k_no_id"), F.coalesce("source", F.lit("")).alias("k_source"), F.col("source").isNull().alias("k_no_source")]
    keys = ["k_id", "k_no_id", "k_source", "k_no_source", "k_size"]
    plan = mixing_plan(docs, **options).where("epochs > 0").select(*alike, F.col("size").alias("k_size"), "epochs")
    plan = plan.groupBy(*keys).agg(F.sort_array(F.collect_list("epochs"), asc=False).alias("often"))
    own = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), *alike, word_count(docs["text"]).alias("k_size"))
    joined = own.join(plan, keys)
    turn = F.row_number().over(Window.partitionBy(*keys).orderBy(F.xxhash64("row.text")))
    taken = joined.withColumn("turn", turn).where(F.col("turn") <= F.size("often")).withColumn("times", F.element_at("often", F.col("turn")))
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*")
