"""Mixing sources to target weights by capped water-filling.

The word budget is shared over the sources by weight. A source whose share
exceeds ``max_epochs`` times its size is clamped there and the excess goes to
the others in proportion to their weights, until no source is above its cap.
With cap ``c_i`` and weight ``w_i`` the result is ``min(c_i, level * w_i)``;
the level rises from round to round and only scalars pass through the driver.

A source's target is then met by whole repetitions of all its documents plus
one fractional repetition: the documents in the order of a seeded hash up to
the point where the target is reached. That point is found from a histogram
of the hash and a sort of the one bucket that holds it, so a source with a
third of all rows is spread over many tasks. Texts are never shuffled.

Defined cases: NULL sources form a group of their own that ranks last; NULL
and empty texts have size 0 and nothing is taken; rows with equal hashes at
the cut (repeated rows) share what is left in proportion to their size; a
total of 0 gives targets of 0; an empty table gives an empty result. Other
columns are passed through untouched by ``mixed_documents``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.llm.common import SPACE_PATTERN, bucket_of, register, stored, table, unit_hash, word_count

SEED = 20240613
MAX_EPOCHS = 3
BUCKET_ROWS = 2048


def ranked(df: DataFrame, *order: Column) -> DataFrame:
    """Add ``rank`` (from 0) in the given total order, without a one-task window:
    a range sort, and the row counts of its partitions as offsets."""
    spark = df.sparkSession
    s = stored(df.orderBy(*order).withColumn("__m", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("__m", 33)
    counts = sorted((r[0], r[1]) for r in s.groupBy(part.alias("p")).count().collect())  # one row per partition
    total, rows = 0, []
    for p, n in counts:
        rows.append((p, total))
        total += n
    offsets = spark.createDataFrame(rows or [(0, 0)], "p long, o long")
    return (s.join(F.broadcast(offsets), part == F.col("p"))
            .withColumn("rank", F.col("o") + F.col("__m").bitwiseAND(F.lit(2 ** 33 - 1)))
            .drop("__m", "p", "o"))


def water_level(sources: DataFrame, budget: float) -> float:
    """Level L with sum(min(cap, L * weight)) = budget (or all capped).

    ``sources`` has double columns ``cap`` and ``weight``. The clamped set only
    grows, so the loop ends after at most as many rounds as there are sources;
    usually two to five.
    """
    level, clamped = 0.0, -1
    while True:
        full = F.col("cap") <= F.lit(level) * F.col("weight")
        row = sources.agg(F.sum(F.when(full, F.col("cap"))), F.sum(F.when(~full, F.col("weight"))),
                          F.count(F.when(full, 1))).head()
        if not row[1] or row[2] == clamped:
            return level
        clamped, level = row[2], (budget - (row[0] or 0.0)) / row[1]


def source_plan(sized: DataFrame, max_epochs: int = MAX_EPOCHS, weights: tuple = (1, 2, 3),
                seed: int = SEED, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """One row per source: ``source_size, target, whole`` repetitions and the cut
    of the fractional one (``cut`` hash, ``cut_words`` left for the rows at the
    cut, ``cut_size`` their total size).

    ``sized`` holds ``source, u, size`` (see :func:`sized_rows`).
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    src = ranked(per, F.col("source").asc_nulls_last())
    src = stored(src.withColumn("weight", F.element_at(cycle, (F.col("rank") % len(weights) + 1).cast("int")))
                 .withColumn("cap", F.col("source_size") * F.lit(float(max_epochs))), "sources")
    total = src.agg(F.sum("source_size")).head()[0] or 0
    level = water_level(src, float(total)) if total else 0.0
    src = (src.withColumn("target", F.least("cap", F.lit(level) * F.col("weight")))
           .withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size")))
                       .otherwise(0).cast("long"))
           .withColumn("extra", F.round(F.col("target") - F.col("whole") * F.col("source_size")).cast("long"))
           .withColumn("n_buckets", F.ceil(F.col("n_docs") / bucket_rows).cast("long")))
    b = (sized.alias("r").join(src.select(F.col("source").alias("s"), "n_buckets", "extra"),
                               F.col("r.source").eqNullSafe(F.col("s")))
         .withColumn("b", bucket_of(F.col("u"), F.col("n_buckets"))))
    sums = b.groupBy("s", "b", "extra").agg(F.sum("size").alias("w"))
    before = F.coalesce(F.sum("w").over(Window.partitionBy("s").orderBy("b")
                                        .rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    hit = (sums.withColumn("before", before)
           .filter((F.col("before") <= F.col("extra")) & (F.col("extra") < F.col("before") + F.col("w")))
           .select(F.col("s").alias("hs"), F.col("b").alias("hb"), "before"))
    inside = (b.join(hit, F.col("s").eqNullSafe(F.col("hs")) & (F.col("b") == F.col("hb")))
              .groupBy("s", "u", "extra", "before").agg(F.sum("size").alias("w")))
    run = F.col("before") + F.coalesce(F.sum("w").over(
        Window.partitionBy("s").orderBy("u").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = (inside.withColumn("run", run)
           .filter((F.col("run") <= F.col("extra")) & (F.col("extra") < F.col("run") + F.col("w")))
           .select(F.col("s").alias("cs"), F.col("u").alias("cut"),
                   (F.col("extra") - F.col("run")).alias("cut_words"), F.col("w").alias("cut_size")))
    return (src.join(cut, F.col("source").eqNullSafe(F.col("cs")), "left")
            .select(F.col("source").alias("plan_source"), "source_size", "target", "whole", "extra",
                    "cut", F.coalesce("cut_words", F.lit(0)).alias("cut_words"),
                    F.coalesce("cut_size", F.lit(1)).alias("cut_size")))


def sized_rows(docs: DataFrame, id_col: str, text: str, source: str, seed: int) -> DataFrame:
    """``id, source, size`` in words and the seeded hash ``u`` of each row."""
    return docs.select(F.col(id_col).alias("id"), F.col(source).alias("source"),
                       word_count(F.col(text)).alias("size"),
                       unit_hash(F.lit(seed), F.col(id_col)).alias("u"))


def extra_words(size: Column, u: Column) -> Column:
    """Words that the fractional repetition takes of a row."""
    partial = F.floor(size * F.col("cut_words") / F.col("cut_size")).cast("long")
    return (F.when(F.col("extra") <= 0, F.lit(0)).when(F.col("cut").isNull() | (u < F.col("cut")), size)
            .when(u == F.col("cut"), partial).otherwise(F.lit(0))).cast("long")


def mix(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source",
        max_epochs: int = MAX_EPOCHS, weights: tuple = (1, 2, 3), seed: int = SEED) -> DataFrame:
    """Per document: ``size, source_size, target`` and the words ``taken``."""
    sized = stored(sized_rows(docs, id_col, text, source, seed), "mix-sizes")
    plan = stored(source_plan(sized, max_epochs, weights, seed), "mix-plan")
    j = sized.join(plan, F.col("source").eqNullSafe(F.col("plan_source")))
    return j.select(F.col("id").alias(id_col), F.col("source").alias(source), "size", "source_size", "target",
                    (F.col("whole") * F.col("size") + extra_words(F.col("size"), F.col("u"))).alias("taken"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source",
                    max_epochs: int = MAX_EPOCHS, weights: tuple = (1, 2, 3), seed: int = SEED) -> DataFrame:
    """The mixed corpus itself: every column of ``docs``, each row as often as
    the mix takes it. The row at a source's cut appears once with the words
    that complete the target exactly; rows of which nothing is taken go, and
    so do those without a word."""
    sized = stored(sized_rows(docs, id_col, text, source, seed), "mix-sizes")
    plan = stored(source_plan(sized, max_epochs, weights, seed), "mix-plan")
    packed = docs.select(F.struct(*docs.columns).alias("row"), F.col(source).alias("__s"),
                         word_count(F.col(text)).alias("size"), unit_hash(F.lit(seed), F.col(id_col)).alias("u"))
    j = packed.join(plan, F.col("__s").eqNullSafe(F.col("plan_source")))
    j = j.withColumn("extra_words", extra_words(F.col("size"), F.col("u")))
    copies = F.concat(
        F.when((F.col("whole") > 0) & (F.col("size") > 0),
               F.transform(F.sequence(F.lit(1), F.greatest(F.col("whole"), F.lit(1))), lambda x: F.col("size")))
        .otherwise(F.array().cast("array<bigint>")),
        F.when(F.col("extra_words") > 0, F.array(F.col("extra_words"))).otherwise(F.array().cast("array<bigint>")))
    out = j.select("row", "size", F.explode(copies).alias("words"))
    cut_text = F.when(F.col("words") < F.col("size"), F.array_join(F.slice(
        F.filter(F.split(F.col("row").getField(text), SPACE_PATTERN), lambda w: w != ""),
        F.lit(1), F.col("words").cast("int")), " ")).otherwise(F.col("row").getField(text))
    return out.select(*[(cut_text if c == text else F.col("row").getField(c)).alias(c) for c in docs.columns])


@register("op2_mixing")
def op2_mixing(spark, sf_dir):
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
