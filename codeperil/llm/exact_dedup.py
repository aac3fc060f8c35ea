"""Exact de-duplication by a tree-merge of sorted digest runs (DataFrame functions only).

Every row gets a digest of its normalised text and belongs to one of ``fan_in ** levels`` runs by a hash of its row; there
are at least as many runs as shuffle partitions. Level 0 sorts each run by digest and reduces it to one entry per digest.
Then the runs are exchanged in binomial rounds: in round r each run whose number has a digit other than 0 at place r (to
the base `fan_in`) goes to the run with a 0 there, so `fan_in` sorted runs meet and are merged in order of their digests,
and of equal digests the best identifier and the number of rows survive. A run is cut into slices by the first bits of the
digest, so one of any size is merged by many tasks. A group of copies with a third of all rows is first reduced inside
every run, so at most `fan_in` entries of it ever meet. The verdict then travels back down the same tree, run by run, so
the last join deals a hot digest over all runs as well.

An entry's key is the SHA-256 digest together with the byte length and an independent 64-bit hash of the same text:
entries merge only if all three agree, at every level.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, written

KEY = ["digest", "n_bytes", "check"]
#: What an entry belongs to: its run, and the slice of it.
PLACE = ["run", "slice"]


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest", fan_in: int = 8, levels: int | None = None, normalise=lower_ascii) -> DataFrame:
    """One row per input row: id_col, keep_id, group_size, kept, text_sha256.

    keep: "largest" or "smallest" identifier stays. A null text counts as empty. Of repeated rows (same identifier, same
    text) one is kept. Null identifiers lose against others; in a group of nulls only, one row is kept, with a null
    keep_id. An empty table gives an empty result. Other columns are not looked at. levels: the rounds; by default as many
    as give a run for each shuffle partition.
    """
    spark = docs.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if keep not in ("largest", "smallest"):
        raise ValueError("keep must be 'largest' or 'smallest'")
    if fan_in < 2 or (levels is not None and levels < 1):
        raise ValueError("fan_in must be 2 or more and levels 1 or more")
    if levels is None:
        levels = next(n for n in range(1, 64) if fan_in**n >= tasks)
    text = normalise(F.coalesce(F.col(text_col), F.lit("")))
    runs = fan_in**levels
    rows = docs.select(F.col(id_col).alias("id"), text.alias("norm"), F.monotonically_increasing_id().alias("uid"))
    rows = rows.select(
        "id",
        "uid",
        F.unhex(F.sha2(F.col("norm").cast("binary"), 256)).alias("digest"),
        F.octet_length("norm").alias("n_bytes"),
        F.xxhash64("norm").alias("check"),
        F.pmod(F.xxhash64("id", "uid"), F.lit(runs)).cast("int").alias("run"),
    )
    rows = rows.withColumn("slice", F.conv(F.hex(F.substring("digest", 1, 2)), 16, 10).cast("int"))
    rows = written(rows, "digests")
    best = _best(keep)
    level = [rows.groupBy(*PLACE, *KEY).agg(best(F.struct(_rankable("id", keep), "id", "uid")).alias("best"), F.count(F.lit(1)).alias("n"))]
    for r in range(levels):
        sent = level[-1].withColumn("run", _receiver(fan_in, r))
        merged = sent.repartition(tasks, *PLACE).sortWithinPartitions(*PLACE, *KEY)  # sorted runs, read in order by the aggregation
        level.append(merged.groupBy(*PLACE, *KEY).agg(best("best").alias("best"), F.sum("n").alias("n")))
    down = level[-1].where("n > 1").select(*PLACE, *KEY, F.col("best").alias("top"), F.col("n").alias("all_n"))
    for r, entries in reversed(list(enumerate(level[:-1]))):
        parent = down.withColumnRenamed("run", "parent")
        down = entries.select(*PLACE, *KEY, _receiver(fan_in, r).alias("parent")).join(parent, ["parent", "slice", *KEY]).select(*PLACE, *KEY, "top", "all_n")
    out = rows.join(down, [*PLACE, *KEY], "left")
    single = F.col("all_n").isNull()
    return out.select(
        F.col("id").alias(id_col),
        F.when(single, F.col("id")).otherwise(F.col("top.id")).alias("keep_id"),
        F.coalesce("all_n", F.lit(1)).cast("long").alias("group_size"),
        (single | (F.col("uid") == F.col("top.uid"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """`docs` without the rows that exact_groups drops, all columns as they were, whatever their names.

    Nulls, empty texts, repeated rows and empty tables are treated as by exact_groups.
    """
    normal = options.get("normalise", lower_ascii)(F.coalesce(F.col(text_col), F.lit("")))
    groups = exact_groups(docs, id_col, text_col, **options).select(F.col(id_col).alias("id"), F.col("text_sha256").alias("sha"), "kept")
    groups = written(groups, "groups")
    dropped = written(groups.where(~F.col("kept")).select("id", "sha").distinct(), "dropped")
    same = F.col("id").eqNullSafe(F.col("gone_id")) & (F.col("sha") == F.col("gone_sha"))
    gone = dropped.select(F.col("id").alias("gone_id"), F.col("sha").alias("gone_sha"))
    # by shuffle at every size: the dropped rows grow with the input
    repeated = written(groups.where("kept").join(gone.hint("merge"), same, "left_semi").select(F.col("id").alias("gone_id"), F.col("sha").alias("gone_sha")), "repeated")
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.sha2(normal.cast("binary"), 256).alias("sha"))
    out = rows.join(gone.hint("merge"), same, "left_anti")
    if not repeated.isEmpty():  # the same identifier and text more than once: one row of each comes back
        again = rows.join(repeated.hint("merge"), same, "left_semi").groupBy("id", "sha").agg(F.first("row").alias("row"))
        out = out.unionByName(again.select("row", "id", "sha"))
    return out.select("row.*")


def _receiver(fan_in: int, r: int) -> Column:
    """The run to which a run goes in round r: its number with 0 for the digit at place r."""
    return (F.col("run") - F.floor(F.col("run") / fan_in**r).cast("int") % fan_in * fan_in**r).cast("int")


def _rankable(column: str, keep: str) -> Column:
    """False sorts before true: a null identifier never wins."""
    return (F.col(column).isNotNull() if keep == "largest" else F.col(column).isNull()).alias("known")


def _best(keep: str):
    return F.max if keep == "largest" else F.min
