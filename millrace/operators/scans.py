"""Ordered scans in blocks, so that one key's rows are spread over many tasks.

A key's order is cut at approximate quantiles into blocks of similar size. Each block is
summed up on its own, the few sums of a key are scanned, and what the earlier blocks give is
joined back to the rows of each block, whose windows then start from it. Rows that share the
order's first column are in one block. Null keys are keys, nulls of the order come first.
"""

from __future__ import annotations

from collections.abc import Sequence
from tempfile import mkdtemp

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Names = Sequence[str]
BLOCKS = 64
BLOCK = "__block"


def number(df: DataFrame, name: str) -> Column:
    """A column of numbers or times as a number in the same order."""
    kind = dict(df.dtypes)[name]
    if kind.startswith("timestamp") or kind == "date":
        return F.unix_micros(F.col(name).cast("timestamp"))
    return F.col(name).cast("double")


def kept(df: DataFrame) -> DataFrame:
    """df as a written checkpoint, for what several branches of a plan read; it outlives lost executors.

    It lies in ``spark.checkpoint.dir``, a folder that all executors share; a temporary one is set only in a local session without it.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        root = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if root is None and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(root or mkdtemp(prefix="millrace-"))
    return df.checkpoint()


def meet(left: DataFrame, right: DataFrame, on: Names) -> DataFrame:
    """Left join on columns of equal names; nulls meet."""
    right = right.withColumnsRenamed({c: f"__r_{c}" for c in on})
    condition = [F.col(c).eqNullSafe(F.col(f"__r_{c}")) for c in on]
    both = left.join(right, condition, "left") if on else left.join(right, how="left")
    return both.drop(*[f"__r_{c}" for c in on])


def in_blocks(df: DataFrame, key: Names, at: str, blocks: int = BLOCKS, by: DataFrame | None = None) -> DataFrame:
    """df with __block, the place of each row's block in its key. ``by`` may hold the rows that set the quantiles."""
    by = df if by is None else by
    x = number(by, at)
    bounds = by.groupBy(*key).agg(F.array_distinct(F.percentile_approx(x, [i / blocks for i in range(1, blocks)], 1000)).alias("__bounds"))
    out = meet(df, bounds, key)
    place = F.size(F.filter("__bounds", lambda b: b < number(df, at)))
    return out.withColumn(BLOCK, F.coalesce(F.greatest(place, F.lit(0)), F.lit(0))).drop("__bounds")


def carried(df: DataFrame, key: Names, sums: dict[str, Column], carry: dict[str, Column], downwards: bool = False) -> DataFrame:
    """df (with __block) with what the earlier blocks of its key give (the later ones, if downwards).

    ``sums`` are aggregates of a block. ``carry`` are aggregates over the sums of the earlier
    blocks, or, where the name starts with ``all_``, over those of all blocks.
    """
    per = df.groupBy(*key, BLOCK).agg(*[c.alias(n) for n, c in sums.items()])
    one = [F.lit(0)] if not key else [F.col(c) for c in key]
    order = Window.partitionBy(*one).orderBy(F.desc(BLOCK) if downwards else F.asc(BLOCK))
    before, whole = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    given = per.select(*key, BLOCK, *[c.over(whole if n.startswith("all_") else before).alias(n) for n, c in carry.items()])
    return meet(df, given, [*key, BLOCK])


def within(key: Names, order: Sequence[str | Column]):
    """The rows of a block up to the current one."""
    return Window.partitionBy(*key, BLOCK).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)


def running_counts(per: DataFrame, key: Names, at: str, counts: Names, blocks: int = BLOCKS) -> DataFrame:
    """Counts from the largest value of ``at`` down to each row's, as <name>_upto, and of all rows, as <name>_all.

    ``per`` has one row a key and value.
    """
    df = in_blocks(per, key, at, blocks)
    df = carried(df, key, {f"__s_{c}": F.sum(c) for c in counts}, {f"__b_{c}": F.sum(f"__s_{c}") for c in counts} | {f"all_{c}": F.sum(f"__s_{c}") for c in counts}, downwards=True)
    run = within(key, [F.desc(at)])
    df = df.withColumns({f"{c}_upto": F.coalesce(f"__b_{c}", F.lit(0)) + F.sum(c).over(run) for c in counts} | {f"{c}_all": F.col(f"all_{c}") for c in counts})
    return df.drop(BLOCK, *[f"{p}{c}" for c in counts for p in ("__b_", "all_")])


def last_value(df: DataFrame, key: Names, order: Names, value: str, out: str, blocks: int = BLOCKS) -> DataFrame:
    """The latest value that isn't null, at or before each row of the order; null before the first."""
    df = in_blocks(df, key, order[0], blocks)
    at = F.struct(*order) if len(order) > 1 else F.col(order[0])
    seen = F.max(F.when(F.col(value).isNotNull(), F.struct(at.alias("at"), F.col(value).alias("value"))))
    df = carried(df, key, {"__seen": seen}, {"__before": F.last("__seen", True)})
    return df.withColumn(out, F.coalesce(F.last(value, True).over(within(key, order)), F.col("__before.value"))).drop(BLOCK, "__before")


class Scan:
    """Running aggregates of a key's rows in order, by windows over the key, or in blocks where ``blocks`` says how many.

    Windows need one exchange for many aggregates and suit many keys; blocks spread one key's
    rows over many tasks and cost a small aggregate and a join for each. Results are the same.
    """

    def __init__(self, key: Names, order: Names, blocks: int = 0):
        self.key, self.order, self.blocks = list(key), list(order), blocks

    def begin(self, df: DataFrame) -> DataFrame:
        return in_blocks(df, self.key, self.order[0], self.blocks) if self.blocks else df

    def end(self, df: DataFrame, *names: str) -> DataFrame:
        return df.drop(BLOCK, *names)

    def fold(self, df: DataFrame, out: str, kind: str, x: Column, before: bool = False) -> DataFrame:
        """The sum, min, max or last value that isn't null of x up to each row, or up to the row before."""
        over = {"sum": F.sum, "min": F.min, "max": F.max, "last": lambda c: F.last(c, True)}[kind]
        df = df.withColumn("__x", x)
        key = [*self.key, BLOCK] if self.blocks else self.key
        frame = Window.partitionBy(*key).orderBy(*self.order).rowsBetween(Window.unboundedPreceding, -1 if before else 0)
        if not self.blocks:
            return df.withColumn(out, over("__x").over(frame)).drop("__x")
        if kind == "last":
            latest = F.max(F.when(F.col("__x").isNotNull(), F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(self.order)], F.col("__x").alias("x"))))
            df = carried(df, self.key, {"__s": latest}, {"__c": F.last("__s", True)})
            df = df.withColumn(out, F.coalesce(F.last("__x", True).over(frame), F.col("__c.x")))
        else:
            df = carried(df, self.key, {"__s": over("__x")}, {"__c": over("__s")})
            own = over("__x").over(frame)
            both = {"sum": F.when(own.isNotNull() | F.col("__c").isNotNull(), F.coalesce(own, F.lit(0)) + F.coalesce("__c", F.lit(0))), "min": F.least(own, "__c"), "max": F.greatest(own, "__c")}[kind]
            df = df.withColumn(out, both)
        return df.drop("__x", "__c")
