"""Filter interaction audit: what five filters remove, in every order in which they may stand.

A document's failures are a mask of five bits, and every figure of every order follows from
the counts of masks of its part, so documents are read once and 32 counts a part remain.

Failures A to D are told from the text alone. E, the same text under a smaller id, needs equal
texts to meet: an RDD of texts is dealt out by their xxhash, and each task keeps a chain of
full texts a fingerprint with the rows of the least id seen so far, so that texts of one
fingerprint are told apart by their characters. Rows of other ids fail. Before texts are dealt
out, each block of a task's texts keeps one record a text; rows that a smaller id of their
block settles, and rows without an id, which no id is smaller than, go to tasks of their own
block instead, so copies of one text never gather as rows.
Then ``combineByKey`` adds up vectors of counts by mask.

Null texts are empty, and all empty texts are equal; null sources are the part of the empty
string. Rows of a null id neither fail E nor make others fail. Rows of one id and text don't
fail by each other. Very long texts are held one block at a time. A document counts as good
or toxic where any of its label rows says so. An empty table gives no parts. Further columns
may have any name, as only doc_id, text and source are read, and doc_id, quality and toxic of
the labels.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import permutations

import numpy as np
import xxhash
from pyspark import RDD
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, lookup, whole

LETTERS = "ABCDE"
SAME = 16  # the bit of E
BLOCK = 32 << 20  # bytes of texts of which one record a text is kept
ROWS = 2000  # of a record without a text
SYMBOL = re.compile(r"[#$%&*|]")
UPPER = bytes(range(65, 91))
COLUMNS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
SCHEMA = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COLUMNS)


def own_failures(text: str, raw: bytes) -> int:
    """The bits of A to D; bytes are split at the same six characters as words are."""
    found = raw.split()
    upper = len(raw) - len(raw.translate(None, UPPER))
    return (len(found) < 50) | (100 * len(set(found)) < 65 * len(found)) << 1 | (100 * upper > 5 * len(text)) << 2 | (SYMBOL.search(text) is not None) << 3


class Chains:
    """Texts by fingerprint, each with its least id and the rows that have it, as counts by part."""

    def __init__(self):
        self.at: dict[int, list[list]] = {}

    def add(self, key: int, text: str, mask: int, doc_id: int, rows: dict[str, int]) -> tuple | None:
        """Takes rows of one id; returns the (id, mask, rows) that have now failed, if any."""
        chain = self.at.setdefault(key, [])
        for link in chain:
            if link[0] == text:
                break
        else:
            chain.append([text, mask, doc_id, dict(rows)])
            return None
        if doc_id == link[2]:
            for part, n in rows.items():
                link[3][part] = link[3].get(part, 0) + n
            return None
        if doc_id > link[2]:
            return doc_id, mask | SAME, rows
        gone = link[2], mask | SAME, link[3]
        link[2:] = doc_id, dict(rows)
        return gone

    def links(self) -> Iterator[tuple[int, list]]:
        return ((key, link) for key, chain in self.at.items() for link in chain)


def dealt(rows: Iterable, task: int) -> Iterator[tuple[int, tuple]]:
    """Records of a task's (doc_id, text, source): (fingerprint, text with its least id) and settled rows."""
    chains, settled, size, block = Chains(), [], 0, 0

    def other() -> tuple[int, tuple]:
        return xxhash.xxh64_intdigest(f"{task} {block} {len(settled)}"), (None, 0, None, settled)

    for doc_id, text, part in rows:
        raw = text.encode("utf-8", "surrogatepass")
        mask = own_failures(text, raw)
        if doc_id is None:
            settled.append((None, part, mask, 1))
        elif gone := chains.add(xxhash.xxh64_intdigest(raw), text, mask, doc_id, {part: 1}):
            settled += [(gone[0], p, gone[1], n) for p, n in gone[2].items()]
        size += len(raw) + 100
        if len(settled) >= ROWS:
            yield other()
            settled, block = [], block + 1
        if size >= BLOCK:
            yield from ((key, tuple(link)) for key, link in chains.links())
            chains, size = Chains(), 0
    yield from ((key, tuple(link)) for key, link in chains.links())
    if settled:
        yield other()


def told(records: Iterable[tuple[int, tuple]]) -> Iterator[tuple]:
    """(doc_id, part, mask, count) of a task's fingerprints."""
    chains = Chains()
    for key, (text, mask, doc_id, rows) in records:
        if text is None:
            yield from rows
        elif gone := chains.add(key, text, mask, doc_id, rows):
            yield from ((gone[0], p, gone[1], n) for p, n in gone[2].items())
    for _, (_, mask, doc_id, rows) in chains.links():
        yield from ((doc_id, p, mask, n) for p, n in rows.items())


def failures(docs: DataFrame) -> DataFrame:
    """doc_id, part, mask and n: the masks of all documents, n rows of one id, part and mask at a time."""
    rows: RDD = docs.select(F.col("doc_id").cast("long"), whole(F.col("text")), F.coalesce("source", F.lit(""))).rdd
    tasks = max(rows.getNumPartitions(), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    routed = rows.mapPartitionsWithIndex(lambda i, part: dealt(part, i)).partitionBy(tasks, lambda key: key)
    return docs.sparkSession.createDataFrame(routed.mapPartitions(told), "doc_id long, part string, mask int, n long")


def duplicates(docs: DataFrame) -> DataFrame:
    """The doc_id of rows whose text stands under a smaller id too, a row an id and part."""
    return failures(docs).where(F.col("mask") >= SAME).select("doc_id", "part", "n")


def labelled(found: DataFrame, labels: DataFrame) -> DataFrame:
    """found with good and toxic; rows without an id take no part in the join."""
    flags = labels.where("doc_id is not null").groupBy("doc_id").agg(*[F.max((F.col(c) == 1).cast("int")).alias(o) for c, o in (("quality", "good"), ("toxic", "toxic"))])
    flags = Scratch(found.sparkSession).put(flags.where("good = 1 or toxic = 1"), "labels")
    return lookup(found, flags, "doc_id").fillna(0, ["good", "toxic"])


def add(counts: np.ndarray, row: tuple) -> np.ndarray:
    mask, n, good, toxic = row
    counts[:, mask] += (n, n * good, n * toxic)
    return counts


def interactions(part: str, counts: np.ndarray) -> Iterator[tuple]:
    """The rows of a part: all orders of the filters, a row a step, from counts by mask (all, good, toxic)."""
    masks = np.arange(32)
    steps = []
    for order in permutations(range(5)):
        before = 0
        for step, f in enumerate(order, 1):
            bit = 1 << f
            fails, passed = (masks & bit) > 0, (masks & before) == 0
            removed, good, toxic = counts[:, fails & passed].sum(1)
            kept = counts[0, (masks & (before | bit)) == 0].sum()
            steps.append((f, order, step, kept, removed, counts[0, fails & ~passed].sum(), counts[0, bit], good, toxic))
            before |= bit
    shapley = np.bincount([s[0] for s in steps], [s[4] for s in steps], 5)
    for f, order, step, *figures in steps:
        yield part, "".join(LETTERS[k] for k in order), step, *map(int, figures), int(shapley[f])


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for every part of docs (doc_id, text, source), order of filters and step."""
    rows = labelled(failures(docs), labels).select("part", "mask", "n", "good", "toxic").rdd.map(lambda r: (r[0], tuple(r[1:])))
    parts = rows.combineByKey(lambda r: add(np.zeros((3, 32), np.int64), r), add, np.add)
    return docs.sparkSession.createDataFrame(parts.flatMap(lambda kv: interactions(*kv)), SCHEMA)


def op11_filter_audit(spark, sf_dir: str) -> DataFrame:
    """The audit of all documents."""
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


OP11_SQL = r"""
WITH docs AS (
  SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '') AS part, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), flags AS (
  SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), masks AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    CAST(len(w) < 50 AS INT) + 2 * CAST(100 * list_unique(w) < 65 * len(w) AS INT)
    + 4 * CAST(100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 5 * length(text) AS INT)
    + 8 * CAST(regexp_matches(text, '[#$%&*|]') AS INT)
    + 16 * CAST(coalesce(min(docs.doc_id) OVER (PARTITION BY text) < docs.doc_id, false) AS INT) AS mask
  FROM docs LEFT JOIN flags ON docs.doc_id = flags.doc_id
), counts AS (
  SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM masks GROUP BY part, mask
), f AS (
  SELECT unnest([0, 1, 2, 3, 4]) AS f
), orders AS (
  SELECT [a.f, b.f, c.f, d.f, e.f] AS o, chr(CAST(65 + a.f AS INT)) || chr(CAST(65 + b.f AS INT)) || chr(CAST(65 + c.f AS INT)) || chr(CAST(65 + d.f AS INT)) || chr(CAST(65 + e.f AS INT)) AS filter_order
  FROM f a, f b, f c, f d, f e WHERE list_unique([a.f, b.f, c.f, d.f, e.f]) = 5
), steps AS (
  SELECT filter_order, s.step, CAST(2 ** o[s.step] AS INT) AS bit, CAST(coalesce(list_sum([2 ** x FOR x IN o[1:s.step - 1]]), 0) AS INT) AS before
  FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step) s
), figures AS (
  SELECT part, filter_order, step, bit,
    sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN mask & bit > 0 AND mask & before = 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN mask & bit > 0 AND mask & before > 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN mask & bit > 0 AND mask & before = 0 THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN mask & bit > 0 AND mask & before = 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM counts, steps GROUP BY part, filter_order, step, bit
)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM figures
"""
