"""Quality rules: fixed base rules, then thresholds adapted to each language and source.

The base counts follow a fixed rule. The method measures ratios of every whole text in
thousandths and keeps, for each language, source and ratio, a sketch: the count of each of
the 1001 values. Sketches merge by adding counts, so the sketches of a language and of the
corpus are merged from those of its sources, and a quantile is exact to a thousandth.
A language's sketch gets the corpus's, scaled to PARENT documents, and a group's that of its
language likewise: few documents say little against their parents, many say all, and no
verdict jumps with the size of a group. A document of the base's is rejected where a ratio is
above its group's limit, ``low + times (high - low)`` of two quantiles. Those of symbols, which
running text hardly has, are the quartiles. Of the other ratios, which good documents have now
and then and most have not, they are the median and the tail: q99, or the upper quartile of the
values above 0 where that is more, so that a rare ratio is held against those who have it.
Symbols also have a fixed resolution, which is their limit where most documents have none.

Null and empty texts have no words and fail; very long texts are measured whole. Null
languages and sources are groups of their own. Repeated rows count as often as they are
there, values that tie with a limit pass, and an empty table gives an empty result. Further
columns may have any name.
All is DataFrame code; a sketch has at most 1001 rows, whatever the number of documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, fresh, let, lookup, whole, words

MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
PACKED_WORDS = 1 << 16
PARENT = 100  # documents that a group's parent counts for
RATIOS = ("symbols", "dup_lines", "repeats", "capitals", "marks", "long_words")
#: Quantiles of a spread and how many times it a value may be above the lower one.
QUARTILES, TAIL = (0.25, 0.75, 4), (0.5, 0.99, 3)
ABOVE_ZERO = 0.75  # the least quantile, of values above 0, at which a tail begins
RESOLUTION = 20  # thousandths of characters that symbols are told apart by


def repeated_words(w: Column) -> Column:
    """Words in 3-word windows that the text has twice or more, the first included.

    Windows are sorted as one long each, the upper bits a hash and the lower bits the place;
    neighbours of equal hash are then compared by their words. Linear but for that sort. Beyond
    2^16 words so few bits would be left to the hash that different windows could lie between
    equal ones; these texts sort pairs of a whole hash and a place.
    """
    n = F.size(w)
    same = lambda i, j: (F.get(w, i) == F.get(w, j)) & (F.get(w, i + 1) == F.get(w, j + 1)) & (F.get(w, i + 2) == F.get(w, j + 2))

    def covered(at: Column) -> Column:
        return F.aggregate(at, F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).cast("long").alias("end")),
                           lambda s, i: F.struct((s["n"] + i + 3 - F.greatest(i, s["end"])).alias("n"), (i + 3).alias("end")), lambda s: s["n"])

    def paired() -> Column:
        pair = lambda x, i: F.struct(F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i"))
        twins = lambda a, b: F.coalesce((a["h"] == b["h"]) & same(a["i"], b["i"]), F.lit(False))

        def found(keys: Column) -> Column:
            both = F.filter(keys, lambda x, k: twins(x, F.get(keys, k + 1)) | twins(F.get(keys, k - 1), x))
            return F.sort_array(F.transform(both, lambda x: x["i"].cast("long")))

        return let(let(F.sort_array(F.transform(F.slice(w, 1, n - 2), pair)), found), covered)

    bits = F.ceil(F.log2(n.cast("double") + 1)).cast("int")
    low = F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1

    def marked(low: Column) -> Column:
        place = lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)).bitwiseAND(F.bitwise_not(low)).bitwiseOR(i.cast("long"))
        keys = F.sort_array(F.transform(F.slice(w, 1, n - 2), place))

        def twins(a: Column, b: Column) -> Column:
            i, j = a.bitwiseAND(low).cast("int"), b.bitwiseAND(low).cast("int")
            alike = a.bitwiseXOR(b).bitwiseAND(F.bitwise_not(low)) == 0
            return F.coalesce(alike & same(i, j), F.lit(False))

        def found(keys: Column) -> Column:
            both = F.filter(keys, lambda x, k: twins(x, F.get(keys, k + 1)) | twins(F.get(keys, k - 1), x))
            return F.sort_array(F.transform(both, lambda x: x.bitwiseAND(low)))

        return let(let(keys, found), covered)

    return F.when(n < 4, F.lit(0).cast("long")).when(n <= PACKED_WORDS, let(low, marked)).otherwise(paired())


def measured(docs: DataFrame) -> DataFrame:
    """docs with a last column, the struct of counts and ratios.

    The struct passes a generator of one row, through which the optimizer moves nothing:
    filters and ratios would otherwise each carry their own copy of the whole measurement.
    """
    text, w, name = whole(F.col("text")), fresh(docs, "w"), fresh(docs, "quality_")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    other = lambda kept: F.char_length(F.regexp_replace(text, f"[^{kept}]+", "")).cast("long")
    counts = F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"),
        other("#*$%&|<>").alias("n_symbols"),
        let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("twice"))).alias("lines"),
        repeated_words(F.col(w)).alias("n_repeat_words"),
        other(r"\p{Lu}").alias("capitals"),
        other("!?").alias("marks"),
        F.size(F.filter(w, lambda x: F.char_length(x) > 25)).cast("long").alias("long_words"),
    )
    return docs.withColumn(w, words(F.col("text"))).withColumn(name, F.explode(F.array(counts))).drop(w)


def ratios(q: str) -> dict[str, Column]:
    per = lambda a, b: F.least(F.expr(f"{q}.{a} * 1000 div greatest({q}.{b}, 1L)"), F.lit(1000).cast("long"))
    return {"symbols": per("n_symbols", "word_chars"), "dup_lines": per("lines.twice", "lines.n"), "repeats": per("n_repeat_words", "n_words"),
            "capitals": per("capitals", "word_chars"), "marks": per("marks", "n_words"), "long_words": per("long_words", "n_words")}


def base_failed(q: str) -> Column:
    return (F.col(f"{q}.n_words") < MIN_WORDS) | (F.col(f"{q}.n_repeat_words") * 100 > F.col(f"{q}.n_words") * MAX_REPEAT_PERCENT)


def group_keys(lang: str = "lang", source: str = "source") -> list[Column]:
    return [F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("-")) for c in (lang, source)]


def thresholds(m: DataFrame, q: str, scratch: Scratch) -> DataFrame:
    """Of each language and source: the highest value of each ratio that passes."""
    lang, source = group_keys()
    rows = m.where(~base_failed(q)).select(lang.alias("g_lang"), source.alias("g_source"), F.explode(F.array(*[F.struct(F.lit(k).alias("ratio"), v.alias("value")) for k, v in ratios(q).items()])).alias("x"))
    sketch = scratch.put(rows.groupBy("g_lang", "g_source", "x.ratio", "x.value").agg(F.count(F.lit(1)).alias("n")), "quality_sketch")
    share = None
    for keys in ([], ["g_lang"], ["g_lang", "g_source"]):
        part = Window.partitionBy(*keys, "ratio")
        own = sketch.groupBy(*keys, "ratio", "value").agg(F.sum("n").alias("n"))
        if share is None:
            count, weight, before = F.col("n"), 0.0, F.lit(0.0)
        else:  # every value of the parent's sketch, counted or not
            groups = own.select(*keys).distinct()
            grid = groups.join(share, keys[:-1]) if keys[1:] else groups.crossJoin(F.broadcast(share))  # of the corpus: 1001 rows a ratio at most
            own = grid.join(own, [*keys, "ratio", "value"], "left")
            count, weight, before = F.coalesce("n", F.lit(0)), float(PARENT), F.col("share")
        upto, total = F.sum(count).over(part.orderBy("value")), F.sum(count).over(part)
        own = own.withColumn("share", (upto.cast("double") + before * weight) / (total.cast("double") + weight))
        share = scratch.put(own.select(*keys, "ratio", "value", "share"), f"quality_share{len(keys)}")
    zero = F.coalesce(F.max(F.when(F.col("value") == 0, F.col("share"))).over(Window.partitionBy("g_lang", "g_source", "ratio")), F.lit(0.0))
    share = share.withColumn("some", zero + (1.0 - zero) * ABOVE_ZERO)
    at = lambda p: F.min(F.when(F.col("share") >= p, F.col("value")))
    symbols = at(QUARTILES[0]) + (at(QUARTILES[1]) - at(QUARTILES[0])) * QUARTILES[2] + RESOLUTION
    others = at(TAIL[0]) + (F.greatest(at(TAIL[1]), at(F.col("some"))) - at(TAIL[0])) * TAIL[2]
    limit = share.groupBy("g_lang", "g_source", "ratio").agg(F.when(F.col("ratio") == "symbols", symbols).otherwise(others).alias("limit"))
    limits = limit.groupBy("g_lang", "g_source").agg(F.struct(*[F.max(F.when(F.col("ratio") == k, F.col("limit"))).alias(k) for k in RATIOS]).alias("limits"))
    return scratch.put(limits, "quality_limits")


def judged(m: DataFrame, limits: DataFrame) -> DataFrame:
    """Measured documents with a last column, the struct of base_failed and kept."""
    q, lang, source = m.columns[-1], fresh(m, "g_lang"), fresh(m, "g_source")
    verdict, at = fresh(m, "verdict_"), fresh(m, "limits_")
    keys = limits.select(F.col("g_lang").alias(lang), F.col("g_source").alias(source), F.col("limits").alias(at))
    a, b = group_keys()
    out = lookup(m, keys, (a == F.col(lang)) & (b == F.col(source)))
    within = F.lit(True)
    for k, v in ratios(q).items():
        within &= F.coalesce(v <= F.col(f"{at}.{k}"), F.lit(True))
    failed = base_failed(q)
    return out.withColumn(verdict, F.struct(failed.alias("base_failed"), (~failed & within).alias("kept"))).drop(lang, source, at)


def good_documents(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """The documents that pass, with the columns of docs.

    Texts are measured once for the thresholds and once for the verdict: a table of measured
    texts would take the disk of another copy of the corpus.
    """
    m = measured(docs)
    out = judged(m, thresholds(m, m.columns[-1], scratch))
    return out.where(F.col(f"{out.columns[-1]}.kept")).select(*docs.columns)


def op6_quality(spark, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document."""
    scratch = Scratch(spark)
    base = measured(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "source", "text")).drop("text")
    m = scratch.put(base, "quality_docs")
    out = judged(m, thresholds(m, "quality_", scratch))
    q = lambda c: F.col(f"quality_.{c}")
    return out.select("doc_id", q("n_words"), q("word_chars"), q("n_symbols"), q("lines.twice").alias("n_dup_lines"), q("n_repeat_words"), "verdict_.base_failed", "verdict_.kept")


OP6_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d
), g AS (
  SELECT r, unnest(generate_series(1, len(w) - 2)) AS i, w FROM w WHERE len(w) >= 3
), h AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, w[i], w[i+1], w[i+2]) AS n FROM g
), p AS (
  SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM h, (SELECT unnest([0, 1, 2]) AS k) WHERE n > 1 GROUP BY r
), m AS (
  SELECT w.r, doc_id, lang, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, len(l) AS n_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
         length(regexp_replace(t, '[^\p{Lu}]+', '', 'g')) AS capitals, length(regexp_replace(t, '[^!?]+', '', 'g')) AS marks,
         len(list_filter(w, lambda x: length(x) > 25)) AS long_words
  FROM w LEFT JOIN p USING (r)
), f AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m
), x AS (
  SELECT r, lang, source, base_failed, unnest(['symbols', 'dup_lines', 'repeats', 'capitals', 'marks', 'long_words']) AS ratio,
         unnest([least(n_symbols * 1000 // greatest(word_chars, 1), 1000), least(n_dup_lines * 1000 // greatest(n_lines, 1), 1000),
                 least(n_repeat_words * 1000 // greatest(n_words, 1), 1000), least(capitals * 1000 // greatest(word_chars, 1), 1000),
                 least(marks * 1000 // greatest(n_words, 1), 1000), least(long_words * 1000 // greatest(n_words, 1), 1000)]) AS value
  FROM f
), n AS (
  SELECT lang, source, ratio, value, count(*) AS n FROM x WHERE NOT base_failed GROUP BY ALL
), a AS (
  SELECT ratio, value, (sum(sum(n)) OVER (PARTITION BY ratio ORDER BY value))::DOUBLE / (sum(sum(n)) OVER (PARTITION BY ratio))::DOUBLE AS share FROM n GROUP BY ratio, value
), l AS (
  SELECT g.lang, a.ratio, a.value, ((sum(coalesce(c.n, 0)) OVER o)::DOUBLE + a.share * 100.0::DOUBLE) / ((sum(coalesce(c.n, 0)) OVER p)::DOUBLE + 100.0::DOUBLE) AS share
  FROM (SELECT DISTINCT lang FROM n) g CROSS JOIN a LEFT JOIN (SELECT lang, ratio, value, sum(n) AS n FROM n GROUP BY ALL) c ON c.lang IS NOT DISTINCT FROM g.lang AND c.ratio = a.ratio AND c.value = a.value
  WINDOW o AS (PARTITION BY g.lang, a.ratio ORDER BY a.value), p AS (PARTITION BY g.lang, a.ratio)
), q AS (
  SELECT g.lang, g.source, l.ratio, l.value, ((sum(coalesce(n.n, 0)) OVER o)::DOUBLE + l.share * 100.0::DOUBLE) / ((sum(coalesce(n.n, 0)) OVER p)::DOUBLE + 100.0::DOUBLE) AS share
  FROM (SELECT DISTINCT lang, source FROM n) g JOIN l ON l.lang IS NOT DISTINCT FROM g.lang LEFT JOIN n ON n.lang IS NOT DISTINCT FROM g.lang AND n.source IS NOT DISTINCT FROM g.source AND n.ratio = l.ratio AND n.value = l.value
  WINDOW o AS (PARTITION BY g.lang, g.source, l.ratio ORDER BY l.value), p AS (PARTITION BY g.lang, g.source, l.ratio)
), k AS (
  SELECT lang, source, ratio, CASE WHEN ratio = 'symbols' THEN 20 + 4 * q75 - 3 * q25 ELSE 3 * greatest(q99, q_some) - 2 * q50 END AS top FROM (
    SELECT lang, source, ratio, min(value) FILTER (share >= 0.25) AS q25, min(value) FILTER (share >= 0.5) AS q50, min(value) FILTER (share >= 0.75) AS q75,
           min(value) FILTER (share >= 0.99) AS q99, min(value) FILTER (share >= zero + (1.0::DOUBLE - zero) * 0.75::DOUBLE) AS q_some
    FROM (SELECT *, coalesce(max(share) FILTER (value = 0) OVER (PARTITION BY lang, source, ratio), 0.0::DOUBLE) AS zero FROM q) GROUP BY lang, source, ratio)
), v AS (
  SELECT x.r, bool_and(coalesce(value <= top, true)) AS within FROM x LEFT JOIN k
    ON x.lang IS NOT DISTINCT FROM k.lang AND x.source IS NOT DISTINCT FROM k.source AND x.ratio = k.ratio GROUP BY x.r
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND within AS kept FROM f JOIN v USING (r)
"""
