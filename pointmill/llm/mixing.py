"""Mixing sources to target weights by systematic sampling; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointmill.llm.common import WORD_PATTERN, staged


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: float = 3.0) -> DataFrame:
    """(source, docs, source_size, target) from rows (source, n, size).

    Sources in code point order, null last, weigh `weights` in turn and share the total size. A target
    above cap * source_size stops there; what it leaves over is shared by weight among the others until
    none is above. In closed form: with sources by cap * size / weight ascending, the first ones stop,
    and the rest share what is left at one common rate per weight.
    """
    s = sizes.groupBy("source").agg(F.sum("n").alias("docs"), F.sum("size").alias("source_size"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights) + 1)
    s = s.withColumn("w", w).withColumn("full", F.col("source_size") * F.lit(float(cap)))
    before = Window.orderBy(F.col("full") / F.col("w"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    every = before.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumns({
        "rate": (F.sum("source_size").over(every) - F.coalesce(F.sum("full").over(before), F.lit(0.0))) / (F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0))),
    })
    # the first source that its share leaves below its cap fixes the rate of all that follow
    fixed = F.first(F.when(F.col("rate") * F.col("w") <= F.col("full"), F.col("rate")), ignorenulls=True).over(every)
    return s.select("source", "docs", "source_size", F.least(F.col("full"), F.coalesce(fixed, F.lit(0.0)) * F.col("w")).alias("target"))


def systematic_mix(
    docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id",
    weights: tuple[int, ...] = (1, 2, 3), cap: float = 3.0, seed: str = "mix", blocks: int = 1024, size: str | None = None,
) -> DataFrame:
    """docs as struct `r`, with size, source_size, target and copies (how often the mix takes the row).

    Every document of a source expects target / source_size copies. Documents stand in a fixed order
    within their source (size class, block of a hash of the key, size, key), so that any stretch of the
    prefix sum holds all sizes alike; one offset per source, drawn from `seed`, is added, and a document
    is taken once per integer boundary that its stretch crosses. The prefix sum has two levels, counts
    of (source, class, block) and row numbers within one, so no task holds a whole source.

    size: a column that holds the sizes, so that they aren't counted from texts.

    Null texts and texts without words have size 0 and can be taken; texts of any length are counted whole; a null source is a source; null
    keys share a block; equal rows are taken apart. An empty table gives no rows. Extra columns of any
    name stay inside `r`.
    """
    group = ["g_src", "g_class", "g_block"]
    hexa = lambda c, n: F.conv(F.substring(F.md5(c), 1, n), 16, 10).cast("long")
    r = F.col("r")
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("r"))
    d = d.select("r", r[source].alias("source"), r[key].alias("key"), (r[size].cast("long") if size else word_count(r[text])).alias("size"))
    d = d.withColumns({
        "g_src": F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")),
        "g_class": F.floor(F.log2(F.col("size") + F.lit(1.0)) * 4).cast("int"),
        "g_block": F.coalesce(hexa(F.col("key").cast("string"), 4) % blocks, F.lit(0)).cast("int"),
    })
    groups = d.groupBy("source", *group).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))
    groups = staged(groups)  # three readers; counting words again costs more than this small table
    targets = source_targets(groups, weights, cap).select(F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")).alias("t_src"), "source_size", "target")
    # prefix sums of counts: over the classes of a source, then over the blocks of a class
    classes = groups.groupBy("g_src", "g_class").agg(F.sum("n").alias("n"))
    classes = classes.select(F.col("g_src").alias("c_src"), F.col("g_class").alias("c_class"), (F.sum("n").over(Window.partitionBy("g_src").orderBy("g_class")) - F.col("n")).alias("c_start"))
    starts = groups.withColumn("b_start", F.sum("n").over(Window.partitionBy("g_src", "g_class").orderBy("g_block")) - F.col("n"))
    starts = starts.join(classes, (F.col("g_src") == F.col("c_src")) & (F.col("g_class") == F.col("c_class")))
    starts = starts.join(targets, F.col("g_src") == F.col("t_src"))
    starts = starts.select(*[F.col(c).alias(f"k_{c}") for c in group], (F.col("c_start") + F.col("b_start")).alias("start"), "source_size", "target")
    d = d.withColumn("at", F.row_number().over(Window.partitionBy(*group).orderBy("size", "key")))
    d = d.join(starts, [F.col(c) == F.col(f"k_{c}") for c in group])
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.when(F.col("source_size") > 0, F.col("source_size"))).otherwise(F.lit(0.0))
    offset = hexa(F.concat(F.lit(f"{seed}:"), F.col("g_src")), 4) / F.lit(65536.0)
    k = F.col("start") + F.col("at")
    copies = F.floor(k * rate + offset) - F.floor((k - 1) * rate + offset)
    return d.select("r", "size", "source_size", "target", copies.cast("int").alias("copies"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: rows of docs, each as often as systematic_mix takes it."""
    m = systematic_mix(docs, **options).where("copies > 0")
    return m.select("r", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select("r.*")
