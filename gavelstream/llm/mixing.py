"""Mixing sources to target weights.

Rows get hash-random keys and are range-sorted by them within their source; distributed prefix
sums of the sizes are cut at the source's budget, after as many whole epochs as fit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gavelstream.llm.common import WORD, text_of, written

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_EPOCHS = 2
#: Rows that a key range of one source holds on average, at most.
RANGE_ROWS = 4_000


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
          seed: str = "mix") -> DataFrame:
    """``doc_id, source, size`` in words, and the row's hash-random ``key``."""
    text = text_of(text_col)
    return docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
        F.md5(F.concat_ws("|", F.lit(seed), F.col(id_col).cast("string"), F.md5(text))).alias("key"))


def budgets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE,
            most_epochs: int = MOST_EPOCHS) -> DataFrame:
    """``source, source_size, target`` from ``source, size``.

    Sources by code point, null last, have the weights in turn; a target above ``most_epochs``
    times the source's size stops there and the rest is shared anew.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    by_source = written(by_source, "mix-sources")
    # position in the order of all sources: rank within a range, after the ranges before it
    ranged = written(by_source.select("source").repartitionByRange(F.col("source").asc_nulls_last())
                     .withColumn("range", F.spark_partition_id()), "mix-order")
    before = (ranged.groupBy("range").agg(F.count("*").alias("n"))
              .withColumn("before", F.sum("n").over(Window.orderBy("range")) - F.col("n")).drop("n"))
    place = (ranged.join(before, "range")
             .withColumn("place", F.col("before") - 1 + F.row_number().over(
                 Window.partitionBy("range").orderBy(F.col("source").asc_nulls_last()))))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    weighed = written(by_source.alias("s").join(place.alias("p"), F.expr("s.source <=> p.source"))
                      .select("s.source", "source_size", weight.cast("long").alias("weight"),
                              (F.col("source_size") * most_epochs).alias("most")), "mix-weights")
    total = share * (weighed.agg(F.sum("source_size")).first()[0] or 0)
    # pour: whoever would run over is full; the rest share what is left. Two sums come back each time.
    level, full = 0.0, None
    while True:
        free = F.lit(True) if full is None else ~(F.col("weight") * level > F.col("most"))
        sums = weighed.agg(F.sum(F.when(free, F.col("weight"))), F.sum(F.when(~free, F.col("most"))),
                           F.sum((~free).cast("long"))).first()
        if not sums[0] or sums[2] == full:
            break
        full, level = sums[2], (total - (sums[1] or 0)) / sums[0]
    return weighed.select("source", "source_size",
                          F.least(F.col("weight") * F.lit(float(level)), F.col("most").cast("double")).alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most_epochs: int = MOST_EPOCHS,
        seed: str = "mix") -> DataFrame:
    """``doc_id, source, size, source_size, target, taken``, one row per row of ``docs``.

    ``taken`` counts the words that the mix takes of the row: its size for each whole epoch that fits
    the source's target, then, in order of the random keys, up to the target's whole part.
    A row that lies across the cut is taken in part. Null and empty texts have size 0 and
    nothing taken; a null source is a source. Rows alike in everything share keys: which of them is
    cut is left open, the taken counts are the same. Other columns of ``docs`` play no part.
    """
    rows = written(sized(docs, id_col, text_col, source_col, seed), "mix-sizes")
    target = budgets(rows, weights, share, most_epochs)
    most_rows = rows.groupBy("source").count().agg(F.max("count")).first()[0] or 0
    bits = max(0, min(28, (most_rows // RANGE_ROWS).bit_length()))
    rows = rows.withColumn("range", F.shiftright(F.conv(F.substring("key", 1, 7), 16, 10).cast("long"), 28 - bits))
    by_range = Window.partitionBy("source").orderBy("range")
    ranges = (rows.groupBy("source", "range").agg(F.sum("size").alias("n"))
              .withColumn("before", F.sum("n").over(by_range) - F.col("n")))
    ranges = ranges.alias("r").join(target.alias("t"), F.expr("r.source <=> t.source")).select(
        "r.source", "range", "before", "source_size", "target")
    within = Window.partitionBy("source", "range").orderBy("key", "size").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("upto", F.sum("size").over(within))
    whole = F.expr("floor(target) div greatest(source_size, 1)")
    rest = F.floor("target") - whole * F.col("source_size")
    first = F.col("before") + F.col("upto") - F.col("size")
    taken = whole * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - first))
    return (rows.alias("d").join(ranges.alias("r"), F.expr("d.source <=> r.source AND d.range = r.range"))
            .select("doc_id", "d.source", "size", "source_size", "target", taken.cast("long").alias("taken")))
