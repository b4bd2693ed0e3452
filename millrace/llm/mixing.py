"""Mixing sources to target weights by hash-threshold histograms.

Every document has a hash cell, 30 bits of the MD5 of its id and 30 of the MD5 of its text, so
rows of null or repeated ids are told apart by their texts. A source that is to give B of
its S words takes every document ``B div S`` times, and once more those below a threshold.
The threshold is found without a sort: sizes are summed by source and the first 10 bits of
the cell, the bucket in which the running sum passes the budget is refined by the next 10
bits, and so on. What the last cell holds beyond the budget is mostly one document, which is
cut. Where it is rows of equal id and text, they share the rest, the first of them a word
more, so that each source gives its budget to the word. All is DataFrame code; what is
collected nowhere grows with the rows.

Null texts and texts of white space have size 0 and are taken 0 times; texts may be of any
length. Null ids hash as the empty string. Null sources are a source of their own, the last in
order. Sources whose budgets tie are ranked by name. An empty table gives an empty result.
Further columns may have any name.
"""

from __future__ import annotations

from math import lcm

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, fresh, lookup, n_words, words

DIGIT = 10  # bits of the cell that one histogram resolves
LEVELS = 6
SHARES = 1024  # tasks at most over which equal rows of a source's last cell are numbered


def measured(docs: DataFrame) -> DataFrame:
    """docs with a struct column ``m``: size, source key and hash cell of id and text."""
    half = DIGIT * LEVELS // 2
    bits = lambda x: F.shiftright(F.conv(F.substring(F.md5(F.coalesce(x, F.lit(""))), 1, 8), 16, 10).cast("long"), 32 - half)
    cell = F.shiftleft(bits(F.col("doc_id").cast("string")), half).bitwiseOR(bits(F.col("text")))
    key = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("-"))
    return docs.withColumn(fresh(docs, "m"), F.struct(n_words(F.col("text")).alias("size"), key.alias("skey"), cell.alias("cell")))


def targets(sizes: DataFrame, weights: tuple[int, ...], share: tuple[int, int], most: int) -> DataFrame:
    """Of each source: its size, target and whole budget.

    Sizes are by source key. The sources share ``share`` (a fraction) of all sizes by weight; one stops at ``most``
    times its size and the rest goes to the others. Sorted by size over weight, the sources
    that stop are a prefix: the first place at which the level of the rest does not pass
    the next source's stop is the solution. The windows run over one row a source.
    """
    up, down = share
    scale = lcm(*weights)
    by_name, ranked = Window.orderBy(F.col("named"), F.col("skey")), Window.orderBy("u", "pos")
    before = ranked.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    per = sizes.groupBy("skey").agg(F.sum("size").alias("s")).withColumn("named", (F.col("skey") == "-").cast("int"))
    per = per.withColumn("pos", F.row_number().over(by_name))
    per = per.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.col("pos") - 1) % len(weights) + 1).cast("long"))
    per = per.withColumn("u", F.col("s") * scale / F.col("w"))
    held = F.coalesce(F.sum("s").over(before), F.lit(0)) * most
    per = per.withColumns({
        "num": F.sum("s").over(whole) * up - held * down,
        "den": (F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0))) * down,
        "rank": F.row_number().over(ranked),
    })
    fits = F.col("num").cast("double") * F.col("w") <= F.col("s").cast("double") * most * F.col("den")
    at = F.min(F.when(fits, F.struct("rank", "num", "den"))).over(whole)
    per = per.withColumn("at", at)
    target = F.when(F.col("rank") < F.col("at.rank"), (F.col("s") * most).cast("double")).otherwise((F.col("w") * F.col("at.num")).cast("double") / F.col("at.den").cast("double"))
    per = per.withColumn("target", target).withColumn("budget", F.least(F.floor(F.col("target") + 0.5).cast("long"), F.col("s") * most))
    times = F.when(F.col("s") > 0, F.expr("budget div s")).otherwise(F.lit(0))
    return per.select("skey", F.col("s").alias("source_size"), "target", times.alias("times"), (F.col("budget") - times * F.col("s")).alias("left"))


def thresholds(sizes: DataFrame, scratch: Scratch, weights=(3, 1, 2), share=(3, 2), most=2, levels=LEVELS) -> DataFrame:
    """Of each source: source_size, target, times, and the cell up to which a document is taken once more.

    ``left`` of the words of that cell itself, which has ``held``, are to be taken.
    """
    at = scratch.put(targets(sizes, weights, share, most).withColumns({"cell": F.lit(0).cast("long"), "held": F.lit(0).cast("long")}), "mix_targets")
    for level in range(1, levels + 1):
        low = DIGIT * (levels - level)
        own = sizes if level == 1 else lookup(sizes, at.select("skey", F.col("cell").alias("within")), "skey").where(F.shiftright("cell", low + DIGIT) == F.col("within"))
        part = own.groupBy("skey", F.shiftright("cell", low).alias("bucket")).agg(F.sum("size").alias("held"))
        running = F.sum("held").over(Window.partitionBy("skey").orderBy("bucket"))
        part = lookup(part.withColumn("upto", running), at.select("skey", "left"), "skey")
        edge = part.where((F.col("upto") > F.col("left")) & (F.col("upto") - F.col("held") <= F.col("left")))
        edge = edge.select("skey", F.col("bucket").alias("cell"), "held", (F.col("left") - F.col("upto") + F.col("held")).alias("left"))
        at = scratch.put(at.drop("cell", "held", "left").join(edge, "skey", "left").fillna(0, ["cell", "held", "left"]), f"mix_level{level}")
    return at


def mix(docs: DataFrame, at: DataFrame, scratch: Scratch) -> DataFrame:
    """The measured documents with the columns of ``thresholds`` and ``taken``, in a struct ``mix``.

    Equal rows of a last cell are written apart and numbered in shares of their places, so
    that a third of a source may be copies of one row.
    """
    m, name = docs.columns[-1], fresh(docs, "mix")
    pick = F.struct("source_size", "target", "times", F.col("cell").alias("edge"), "held", "left")
    out = lookup(docs, at.select(F.col("skey").alias(key := fresh(docs, "skey_")), pick.alias(t := fresh(docs, "t_"))), F.col(f"{m}.skey") == F.col(key)).drop(key)
    size, cell = F.col(f"{m}.size"), F.col(f"{m}.cell")
    # equal rows share a cell, so left and its product with size may be large
    wide = lambda c: f"cast({c} as decimal(19, 0))"
    edge = F.expr(f"if({t}.held > 0, {wide(f'{m}.size')} * {wide(f'{t}.left')} div {wide(f'{t}.held')}, 0L)")
    taken = F.col(f"{t}.times") * size + F.when(cell < F.col(f"{t}.edge"), size).when(cell == F.col(f"{t}.edge"), edge).otherwise(F.lit(0))
    result = lambda extra: F.struct(size.alias("size"), F.col(f"{t}.source_size").alias("source_size"), F.col(f"{t}.target").alias("target"), (taken + extra).cast("long").alias("taken"))
    shared = F.coalesce((cell == F.col(f"{t}.edge")) & (F.col(f"{t}.held") > size) & (size > 0) & (F.col(f"{t}.left") > 0), F.lit(False))
    rest = out.where(~shared).withColumn(name, result(F.lit(0))).drop(m, t)
    row, part = fresh(out, "row_"), fresh(out, "part_")
    equal = scratch.put(out.where(shared).withColumn(row, F.monotonically_increasing_id()), "mix_equal").withColumn(part, F.pmod(F.xxhash64(row), F.lit(SHARES)))
    counts = equal.groupBy(F.col(f"{m}.skey").alias("skey"), F.col(part).alias("part")).agg(F.count(F.lit(1)).alias("k"))
    before = Window.partitionBy("skey").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(F.struct("skey", "part").alias(c := fresh(out, "c_")), F.coalesce(F.sum("k").over(before), F.lit(0)).alias(b := fresh(out, "b_")))
    place = F.col(b) + F.row_number().over(Window.partitionBy(F.col(f"{m}.skey"), part).orderBy(row))
    numbered = equal.join(counts, F.struct(F.col(f"{m}.skey").alias("skey"), F.col(part).alias("part")) == F.col(c)).withColumn(b, place)
    spare = F.expr(f"{t}.left - {t}.held div {m}.size * ({wide(f'{m}.size')} * {wide(f'{t}.left')} div {wide(f'{t}.held')})")
    return rest.unionByName(numbered.withColumn(name, result((F.col(b) <= spare).cast("long"))).drop(m, t, row, part, c, b))


def mixed_documents(docs: DataFrame, scratch: Scratch, **rules) -> DataFrame:
    """The mix itself, with the columns of docs: a document taken twice is there twice.

    The extra piece of a document in the last cell is its first words, joined by spaces.
    """
    base = measured(docs)
    m = base.columns[-1]
    sizes = scratch.put(base.select(f"{m}.*"), "mix_sizes")
    out = mix(base, thresholds(sizes, scratch, **rules), scratch)
    name = out.columns[-1]
    size, taken = F.col(f"{name}.size"), F.col(f"{name}.taken")
    rest = taken % F.greatest(size, F.lit(1))
    copies = F.expr(f"{name}.taken div greatest({name}.size, 1L)")
    parts = F.concat(F.array_repeat(size, copies.cast("int")), F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<bigint>")))
    part = fresh(out, "part")
    cut = F.array_join(F.slice(words(F.col("text")), 1, F.col(part).cast("int")), " ")
    out = out.where(taken > 0).withColumn(part, F.explode(parts))
    text = F.when(F.col(part) == size, F.col("text")).otherwise(cut)
    out = out.withColumn("text", text)
    if "n_chars" in out.columns:
        out = out.withColumn("n_chars", F.when(F.col(part) == size, F.col("n_chars")).otherwise(F.char_length("text").cast("long")))
    return out.select(*docs.columns)


def op1_mixing(spark, sf_dir: str) -> DataFrame:
    """All documents at weights 3, 1, 2 and 150 % of all words, at most twice each source."""
    scratch = Scratch(spark)
    base = measured(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source"))
    light = scratch.put(base.select("doc_id", "m"), "mix_docs")
    out = mix(light, thresholds(light.select("m.*"), scratch), scratch)
    return out.select("doc_id", "mix.*")


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> ''))::BIGINT AS size,
         ((('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT >> 2) << 30) | (('0x' || substr(md5(coalesce(text, '')), 1, 8))::BIGINT >> 2) AS cell
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS s, row_number() OVER (ORDER BY source NULLS LAST) AS pos FROM d GROUP BY source
), w AS (
  SELECT *, CASE (pos - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w FROM s
), r AS (
  SELECT *, row_number() OVER o AS rank,
         (sum(s) OVER () * 3 - coalesce(sum(s) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 4)::BIGINT AS num,
         ((sum(w) OVER () - coalesce(sum(w) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) * 2)::BIGINT AS den
  FROM w WINDOW o AS (ORDER BY (s * 6)::DOUBLE / w, pos)
), k AS (
  SELECT rank AS k_rank, num AS k_num, den AS k_den FROM r WHERE num::DOUBLE * w <= s::DOUBLE * 2 * den ORDER BY rank LIMIT 1
), t AS (
  SELECT source, s, CASE WHEN rank < k_rank THEN (s * 2)::DOUBLE ELSE (w * k_num)::DOUBLE / k_den::DOUBLE END AS target FROM r, k
), b AS (
  SELECT *, CASE WHEN s > 0 THEN least(floor(target + 0.5)::BIGINT, s * 2) // s ELSE 0 END AS times,
         CASE WHEN s > 0 THEN least(floor(target + 0.5)::BIGINT, s * 2) % s ELSE 0 END AS lft
  FROM t
), c AS (
  SELECT source, cell, sum(size)::BIGINT AS held, (sum(sum(size)) OVER (PARTITION BY source ORDER BY cell))::BIGINT AS upto, count(*) AS n FROM d GROUP BY source, cell
), e AS (
  SELECT *, row_number() OVER (PARTITION BY source, cell ORDER BY doc_id) AS place FROM d
)
SELECT d.doc_id, d.size, b.s AS source_size, b.target,
       (b.times * d.size + CASE WHEN c.upto <= b.lft THEN d.size WHEN c.upto - c.held <= b.lft AND c.held > 0
                                THEN d.size * (b.lft - c.upto + c.held) // c.held
                                     + CASE WHEN d.place <= (b.lft - c.upto + c.held) - c.n * (d.size * (b.lft - c.upto + c.held) // c.held) THEN 1 ELSE 0 END ELSE 0 END)::BIGINT AS taken
FROM e d JOIN b ON d.source IS NOT DISTINCT FROM b.source
       JOIN c ON d.source IS NOT DISTINCT FROM c.source AND d.cell = c.cell
"""
