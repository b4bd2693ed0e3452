"""Splits, normalisation and audits (L0-L15), all by row keys and a portable hash.

Assignments come from an arithmetic hash that any engine computes, so a split is the same on
every run and cluster. Splits are columns or (fold, row) tables, never lists of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Knuth's multiplicative hash and a second multiplier for the seed.
MULTIPLIER, SEED_STEP, MODULUS = 2654435761, 40503, 1 << 32
BROADCAST_GROUPS = 200_000


def portable_hash(x: Column, seed: int = 0) -> Column:
    """A number below 2^32; the product of two numbers below 2^31 stays in a long."""
    return F.pmod(F.pmod(x.cast("long") + seed * SEED_STEP, F.lit(1 << 31)) * MULTIPLIER, F.lit(MODULUS))


def random_split(df: DataFrame, row: str, share: float = 0.3, seed: int = 0) -> DataFrame:
    """train and test by hash rank (L0); max(1, floor(share n)) rows are test. A split of windows is not valid.

    The rank at which the test rows end is found from counts by hash bucket, so no window
    runs over all rows; only the bucket in which it falls is ranked.
    """
    h = portable_hash(F.col(row), seed)
    rows = df.withColumn("__h", h).withColumn("__b", F.shiftright("__h", 20))
    counts = rows.groupBy("__b").agg(F.count(F.lit(1)).alias("c"))
    run = Window.orderBy("__b")
    edge = counts.withColumns({"upto": F.sum("c").over(run), "n": F.sum("c").over(Window.partitionBy())})
    need = F.greatest(F.lit(1), F.floor(F.col("n") * share)).cast("long")
    edge = edge.select("__b", (need - F.col("upto") + F.col("c")).alias("room"), "c")
    ranked = rows.join(edge, "__b")
    inside = ranked.where("room >= c").withColumn("role", F.lit("test"))
    outside = ranked.where("room <= 0").withColumn("role", F.lit("train"))
    border = ranked.where("room > 0 and room < c").withColumn("__r", F.row_number().over(Window.partitionBy("__b").orderBy("__h", row)))
    border = border.withColumn("role", F.when(F.col("__r") <= F.col("room"), "test").otherwise("train")).drop("__r")
    return inside.unionByName(outside).unionByName(border).drop("__h", "__b", "room", "c")


def group_folds(df: DataFrame, group: str, seed: int = 0, most: int = 10) -> DataFrame:
    """(group, fold): one fold a group, or hash order modulo ``most`` where there are more groups (L1-L3).

    most=0 never bins, as leaving one machine out demands. Fewer than two groups raise.
    """
    groups = df.select(F.col(group).alias("group")).where("group is not null").distinct()
    order = Window.orderBy("h", "group")
    key = F.col("group") if dict(groups.dtypes)["group"] != "string" else F.crc32(F.col("group").cast("binary"))
    ranked = groups.withColumn("h", portable_hash(key, seed)).withColumns({"rank": F.row_number().over(order) - 1, "n": F.count(F.lit(1)).over(Window.partitionBy())})
    fold = F.col("rank") if not most else F.when(F.col("n") > most, F.col("rank") % most).otherwise(F.col("rank"))
    enough = F.when(F.col("n") < 2, F.raise_error(F.lit("a split needs two groups"))).otherwise(fold)
    return ranked.select("group", enough.cast("int").alias("fold"))


def fold_roles(df: DataFrame, folds: DataFrame, group: str) -> DataFrame:
    """A row for each fold and row of df, with its role; one join and no loop over folds.

    That is rows times folds. What only needs counts or moments of training rows takes
    ``fold_counts``, ``fold_coverage`` and ``normalised_folds``, which subtract a fold's own from the whole.
    Folds of up to ``BROADCAST_GROUPS`` groups go to the rows, as few groups would crowd all rows into few tasks.
    """
    few = F.broadcast(folds) if folds.count() <= BROADCAST_GROUPS else folds
    own = with_fold(df, few, group)
    every = folds.select("fold").distinct()
    return own.crossJoin(every).withColumn("role", F.when(F.col("__own") == F.col("fold"), "test").otherwise("train")).drop("__own")


def with_fold(df: DataFrame, folds: DataFrame, group: str) -> DataFrame:
    """df with __own, the fold that tests each row."""
    return df.join(folds.select(F.col("group").alias("__group"), F.col("fold").alias("__own")), F.col(group) == F.col("__group")).drop("__group")


def fold_counts(df: DataFrame, folds: DataFrame, group: str, label: str) -> DataFrame:
    """(fold, label, test, train): rows of the labels that a fold tests, and how many of them are left to train on.

    Training rows are all rows less the fold's own, so no row is repeated by fold.
    """
    own = with_fold(df, folds, group).groupBy(F.col("__own").alias("fold"), label).agg(F.count(F.lit(1)).alias("test"))
    return own.withColumn("train", F.sum("test").over(Window.partitionBy(label)) - F.col("test"))


def fold_coverage(df: DataFrame, folds: DataFrame, group: str, label: str, least: float = 0.10) -> DataFrame:
    """``label_coverage`` of leave-groups-out folds (L5), from counts by fold and label."""
    per, lost = fold_counts(df, folds, group, label), F.col("train") == 0
    out = per.groupBy("fold").agg(F.sum("test").alias("n_test"), F.sum(F.when(lost, F.col("test")).otherwise(0)).alias("n_lost"), F.sort_array(F.collect_set(F.when(lost, F.col(label)))).alias("missing"))
    return out.withColumn("share_lost", F.col("n_lost") / F.col("n_test")).withColumn("interpretable", F.col("share_lost") < least)


def describe_group_folds(df: DataFrame, folds: DataFrame, group: str, label: str) -> DataFrame:
    """``describe_folds`` of leave-groups-out folds (L6): rows, groups and classes of each fold's test and training rows, by subtraction."""
    per = fold_counts(df, folds, group, label)
    own = with_fold(df, folds, group).groupBy(F.col("__own").alias("fold")).agg(F.countDistinct(group).alias("n_machines"), F.count(F.lit(1)).alias("n"))
    every = own.agg(F.sum("n_machines").alias("__m"), F.sum("n").alias("__n"))
    labels = per.groupBy(label).agg(F.sum("test").alias("__all")).agg(F.sort_array(F.collect_list(label)).alias("__labels"))
    classes = per.groupBy("fold").agg(F.sort_array(F.collect_list(label)).alias("classes"), F.collect_list(F.when(F.col("train") == 0, F.col(label))).alias("__gone"))
    out = own.join(classes, "fold").crossJoin(F.broadcast(every)).crossJoin(F.broadcast(labels))  # one row each
    test = F.struct(F.lit("test").alias("role"), F.col("n").alias("n"), F.col("n_machines").alias("n_machines"), F.col("classes").alias("classes"))
    train = F.struct(F.lit("train").alias("role"), (F.col("__n") - F.col("n")).alias("n"), (F.col("__m") - F.col("n_machines")).alias("n_machines"), F.array_except("__labels", "__gone").alias("classes"))
    return out.select("fold", F.inline(F.array(test, train))).where("n > 0")


def moments(df: DataFrame, key: list[str], features: list[str]) -> DataFrame:
    """Count, mean and sum of squared deviations of each feature (n, m and s), which can be added and subtracted."""
    return df.groupBy(*key).agg(*[x for c in features for x in (F.count(c).cast("double").alias(f"n_{c}"), F.avg(c).alias(f"m_{c}"), (F.var_pop(c) * F.count(c)).alias(f"s_{c}"))])


def less(n: Column, m: Column, s: Column, k: Column, a: Column, b: Column) -> tuple[Column, Column]:
    """Mean and population deviation of what is left of n values (mean m, squares s) without k of them (mean a, squares b); null if nothing is."""
    k, a, b = F.coalesce(k, F.lit(0.0)), F.coalesce(a, F.lit(0.0)), F.coalesce(b, F.lit(0.0))
    rest = n - k
    mean = F.when(rest > 0, m + (m - a) * k / rest)
    squares = s - b - (a - mean) * (a - mean) * k * rest / n
    return mean, F.when(rest > 0, F.sqrt(F.greatest(squares, F.lit(0.0)) / rest))


def normalised_folds(df: DataFrame, folds: DataFrame, group: str, features: list[str], strategy: str, machine: str = "machine") -> DataFrame:
    """``normalised`` of leave-groups-out folds (L7): each row in each fold, with its role and its z-scores.

    A fold's training moments are those of all rows less its own. Of ``train_pooled`` there is a
    row of moments a fold; of ``unsupervised_per_machine`` one a fold and machine that the fold
    tests some of, while in all other folds a machine's training rows are all it has.
    """
    own = with_fold(df, folds, group)
    if strategy == "train_pooled":
        key: list[str] = []
    elif strategy == "unsupervised_per_machine":
        key = [machine]
    else:
        raise ValueError(f"unknown strategy {strategy}")
    mine = moments(own, [*key, "__own"], features)
    whole = moments(own, key, features).withColumnsRenamed({f"{x}_{c}": f"{x}0_{c}" for c in features for x in "nms"})
    # one row without a key, else a join on the machine
    both = mine.join(whole, key) if key else mine.crossJoin(F.broadcast(whole))
    stats = {}
    for c in features:
        mu, sd = less(*[F.col(f"{x}0_{c}") for x in "nms"], *[F.col(f"{x}_{c}") for x in "nms"])
        every = F.sqrt(F.col(f"s0_{c}") / F.col(f"n0_{c}"))
        stats |= {f"__m_{c}": F.coalesce(mu, f"m0_{c}") if key else mu, f"__s_{c}": F.coalesce(sd, every) if key else sd}
    rest = both.select(*key, F.col("__own").alias("fold"), *[v.alias(n) for n, v in stats.items()])
    rows = own.crossJoin(folds.select("fold").distinct()).withColumn("role", F.when(F.col("__own") == F.col("fold"), "test").otherwise("train")).drop("__own")
    if key:
        plain = whole.select(*key, *[x for c in features for x in (F.col(f"m0_{c}").alias(f"__pm_{c}"), F.sqrt(F.col(f"s0_{c}") / F.col(f"n0_{c}")).alias(f"__ps_{c}"))])
        rows = rows.join(rest, [*key, "fold"], "left").join(plain, key)
        rows = rows.withColumns({f"__{x}_{c}": F.coalesce(f"__{x}_{c}", f"__p{x}_{c}") for c in features for x in "ms"}).drop(*[f"__p{x}_{c}" for c in features for x in "ms"])
    else:
        rows = rows.join(rest, "fold")
    scale = lambda c: F.when(F.col(f"__s_{c}") < 1e-9, 1.0).otherwise(F.col(f"__s_{c}"))
    return rows.withColumns({c: (F.col(c) - F.col(f"__m_{c}")) / scale(c) for c in features}).drop(*[f"__{x}_{c}" for c in features for x in "ms"])


def nth_of_class(df: DataFrame, unit: str, label: str) -> DataFrame:
    """(unit, label, fold): fold k tests the k-th unit of every class, as many folds as the smallest class has."""
    units = df.select(unit, label).distinct()
    units = units.withColumn("fold", F.row_number().over(Window.partitionBy(label).orderBy(unit)) - 1)
    folds = units.groupBy(label).agg(F.count(F.lit(1)).alias("c")).agg(F.min("c").alias("folds"))
    return units.crossJoin(F.broadcast(folds)).where("fold < folds").drop("folds")  # one row


def label_coverage(roles: DataFrame, label: str, least: float = 0.10) -> DataFrame:
    """Of each fold: test rows, those whose class training lacks, missing classes, interpretable."""
    per = roles.groupBy("fold", label).agg(F.count(F.when(F.col("role") == "test", 1)).alias("test"), F.count(F.when(F.col("role") == "train", 1)).alias("train"))
    lost = (F.col("test") > 0) & (F.col("train") == 0)
    out = per.groupBy("fold").agg(F.sum("test").alias("n_test"), F.sum(F.when(lost, F.col("test")).otherwise(0)).alias("n_lost"), F.sort_array(F.collect_set(F.when(lost, F.col(label)))).alias("missing"))
    return out.withColumn("share_lost", F.when(F.col("n_test") > 0, F.col("n_lost") / F.col("n_test")).otherwise(F.lit(0.0))).withColumn("interpretable", F.col("share_lost") < least)


def describe_folds(roles: DataFrame, machine: str, label: str) -> DataFrame:
    """Rows, machines and classes of each fold and role."""
    return roles.groupBy("fold", "role").agg(F.count(F.lit(1)).alias("n"), F.countDistinct(machine).alias("n_machines"), F.sort_array(F.collect_set(label)).alias("classes"))


def normalised(roles: DataFrame, features: list[str], strategy: str, machine: str = "machine") -> DataFrame:
    """Features as z-scores of each fold (L7): of its training rows, or of each machine's own.

    A machine without training rows uses all its own; deviations below 1e-9 count as 1.
    Statistics are aggregated and joined back, a row a fold or a fold and machine.
    """
    train = lambda c: F.when(F.col("role") == "train", F.col(c))
    if strategy == "train_pooled":
        key, mu, sd = ["fold"], lambda c: F.avg(train(c)), lambda c: F.stddev_pop(train(c))
    elif strategy == "unsupervised_per_machine":
        key, mu, sd = ["fold", machine], lambda c: F.coalesce(F.avg(train(c)), F.avg(c)), lambda c: F.coalesce(F.stddev_pop(train(c)), F.stddev_pop(c))
    else:
        raise ValueError(f"unknown strategy {strategy}")
    stats = roles.groupBy(*key).agg(*[x for c in features for x in (mu(c).alias(f"__m_{c}"), sd(c).alias(f"__s_{c}"))])
    out = roles.join(F.broadcast(stats) if key == ["fold"] else stats, key)  # a row a fold
    scale = lambda c: F.when(F.col(f"__s_{c}") < 1e-9, 1.0).otherwise(F.col(f"__s_{c}"))
    return out.withColumns({c: (F.col(c) - F.col(f"__m_{c}")) / scale(c) for c in features}).drop(*[f"__{x}_{c}" for c in features for x in "ms"])


def balanced(df: DataFrame, machine: str, label: str, row: str, least: int = 8, seed: int = 0) -> DataFrame:
    """As many rows of each class on each machine (L9): classes with ``least`` rows, machines with two of them."""
    n = df.groupBy(machine, label).agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= least)
    per = Window.partitionBy(machine)
    n = n.withColumns({"k": F.count(F.lit(1)).over(per), "m": F.min("c").over(per)}).where("k >= 2").select(machine, label, "m")
    ranked = df.join(n, [machine, label]).withColumn("__r", F.row_number().over(Window.partitionBy(machine, label).orderBy(portable_hash(F.col(row), seed), row)))
    return ranked.where("__r <= m").drop("__r", "m")


def dominant_share(df: DataFrame, machine: str, label: str) -> DataFrame:
    """Mean over machines of the share of their most frequent class."""
    n = df.groupBy(machine, label).agg(F.count(F.lit(1)).alias("c")).groupBy(machine).agg((F.max("c") / F.sum("c")).alias("share"))
    return n.agg(F.avg("share").alias("dominant_share"))


def stratified_context(df: DataFrame, label: str, row: str, cap: int, seed: int = 0) -> DataFrame:
    """At most ``cap`` rows, evenly by class, what small classes leave going to the largest.

    No class has a quota above ``cap``, so each partition sends its first ``cap`` rows of a class at most.
    """
    n = df.groupBy(label).agg(F.count(F.lit(1)).alias("c"))
    n = n.withColumn("k", F.count(F.lit(1)).over(Window.partitionBy()))
    n = n.withColumn("base", F.least(F.floor(F.lit(cap) / F.col("k")), F.col("c")))
    order = Window.orderBy(F.desc("c"), label).rowsBetween(Window.unboundedPreceding, -1)
    n = n.withColumns({"room": F.col("c") - F.col("base"), "spare": cap - F.sum("base").over(Window.partitionBy())})
    n = n.withColumn("earlier", F.coalesce(F.sum("room").over(order), F.lit(0)))
    quota = F.col("base") + F.greatest(F.lit(0), F.least(F.col("room"), F.col("spare") - F.col("earlier")))
    ranked = df.withColumn("__r", F.row_number().over(Window.partitionBy(label).orderBy(portable_hash(F.col(row), seed), row))).where(F.col("__r") <= cap)
    return ranked.join(n.select(label, quota.alias("__q")), label).where("__r <= __q").drop("__r", "__q")


def inner_folds(roles: DataFrame, machine: str, k: int = 3, seed: int = 0) -> DataFrame:
    """(fold, machine, inner): folds of the training machines of each fold (L12); none where there is one machine."""
    train = roles.where("role = 'train'").select("fold", machine).distinct()
    per = Window.partitionBy("fold")
    out = train.withColumns({"__r": F.row_number().over(per.orderBy(portable_hash(F.col(machine), seed), machine)) - 1, "__n": F.count(F.lit(1)).over(per)})
    return out.where("__n >= 2").select("fold", machine, (F.col("__r") % F.least(F.lit(k), F.col("__n"))).cast("int").alias("inner"))


def contingency(df: DataFrame, label: str, group: str) -> DataFrame:
    """Rows by class and group."""
    return df.groupBy(label, group).agg(F.count(F.lit(1)).alias("n"))


def mutual_information(table: DataFrame, label: str, group: str) -> DataFrame:
    """Normalised mutual information of a contingency table, by the mean of both entropies."""
    p = table.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy()))
    p = p.withColumns({"a": F.sum("p").over(Window.partitionBy(label)), "b": F.sum("p").over(Window.partitionBy(group))})
    mi = p.agg(F.sum(F.col("p") * F.ln(F.col("p") / (F.col("a") * F.col("b")))).alias("mi"))
    entropy = lambda c, out: p.groupBy(c).agg(F.sum("p").alias("q")).agg(F.sum(-F.col("q") * F.ln("q")).alias(out))
    one = mi.crossJoin(entropy(label, "h1")).crossJoin(entropy(group, "h2"))  # one row each
    return one.select(F.when(F.col("h1") + F.col("h2") > 0, 2 * F.col("mi") / (F.col("h1") + F.col("h2"))).otherwise(F.lit(1.0)).alias("nmi"))


def single_group_classes(table: DataFrame, label: str, group: str) -> DataFrame:
    """Classes that only one group has."""
    return table.groupBy(label).agg(F.count(F.lit(1)).alias("groups"), F.min(group).alias("only")).where("groups = 1").select(label, "only")


def lomo_feasible(df: DataFrame, machine: str, label: str, healthy: str = "healthy") -> DataFrame:
    """Classes and faults that all machines share, and whether leaving one out makes sense."""
    pairs = df.select(machine, label).distinct()
    machines = pairs.agg(F.countDistinct(machine).alias("machines"))
    shared = pairs.groupBy(label).agg(F.countDistinct(machine).alias("m")).crossJoin(F.broadcast(machines)).where("m = machines")  # one row
    found = shared.agg(F.sort_array(F.collect_list(label)).alias("shared"), F.count(F.when(F.col(label) != healthy, 1)).alias("shared_faults"))
    return machines.crossJoin(found).withColumn("feasible", (F.col("machines") >= 2) & (F.col("shared_faults") >= 1))
