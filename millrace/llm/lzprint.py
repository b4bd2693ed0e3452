"""Document fingerprints from Lempel-Ziv phrases.

A text is parsed into dictionary phrases (each the shortest that is not in the dictionary
yet), a phrase is a 61-bit polynomial hash of its characters, and the fingerprint is the
BOTTOM smallest mixed hashes of the phrase set. The likeness of two fingerprints is the
share of the smallest hashes of their union that both have: an unbiased estimate of the
Jaccard similarity of the phrase sets, as compression distances compare dictionaries.

Null texts are empty, and an empty text has an empty fingerprint; two of those are alike (1),
an empty and another one are not (0). Equal texts have equal fingerprints. Very long texts are
parsed whole. Documents are ordered by descending doc_id, null last; rows that tie in it, and
so repeated rows, follow each other by the digest of their texts. An only row is followed by
itself, and an empty table gives an empty result. Further columns may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BOTTOM = 64
RANGE_BYTES = 1 << 25  # of the texts of a task
BASE, PRIME = 1_000_003, (1 << 61) - 1
SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
FIELDS = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def parse(text: str, phrases: set[int], state: int = 0) -> int:
    """Add the phrases of text to the dictionary; returns the hash of the open phrase (0: none)."""
    add, h, base, prime = phrases.add, state, BASE, PRIME
    for c in map(ord, text):
        h = (h * base + c + 1) % prime
        if h not in phrases:
            add(h)
            h = 0
    return h


def signature(phrases: set[int]) -> np.ndarray:
    """The smallest mixed hashes, sorted; an unfinished phrase is in the dictionary already."""
    x = np.fromiter(phrases, np.uint64, len(phrases))
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    if len(x) > BOTTOM:
        x = np.partition(x, BOTTOM - 1)[:BOTTOM]
    return np.sort(x)


def fingerprint(text: str) -> np.ndarray:
    phrases: set[int] = set()
    parse(text, phrases)
    return signature(phrases)


def encoded(sig: np.ndarray) -> str:
    return sig.astype(">u8").tobytes().hex()


def decoded(fp: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(fp), ">u8").astype(np.uint64)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of the smallest hashes of the union that are in both."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    least = np.union1d(a, b)
    # beyond a full signature's largest hash that set is unknown
    for s in (a, b):
        if len(s) == BOTTOM:
            least = least[least <= s[-1]]
    least = least[:BOTTOM]
    return float(np.isin(least, np.intersect1d(a, b)).mean())


def neighbours(docs: DataFrame, buckets: int) -> DataFrame:
    """The documents in ranges of descending doc_id, each range with the first row of the next.

    Columns: part, ahead (the row is only looked at), doc_id, key, text. Bounds come from a
    mergeable quantile sketch over the ids alone, and the first id of each range from one
    row a range; the last range is followed by the first. Null ids come last in the order.
    """
    least = -(1 << 63)
    key = F.coalesce("doc_id", F.lit(least).cast("long"))
    ids = docs.select(key.alias("key"))
    found = ids.agg(F.percentile_approx("key", [i / buckets for i in range(1, buckets)], max(10_000, 4 * buckets))).first()[0]
    cuts = np.unique(np.array(found or [], np.int64))

    @F.pandas_udf("int")
    def part(x: pd.Series) -> pd.Series:
        return pd.Series(len(cuts) - np.searchsorted(cuts, x.to_numpy(), side="left")).astype("int32")

    tops = sorted((r["part"], r["top"]) for r in ids.groupBy(part("key").alias("part")).agg(F.max("key").alias("top")).collect())
    firsts = np.array([t for _, t in tops][::-1], np.int64)
    before = np.array([p for p, _ in [tops[-1], *tops[:-1]]][::-1], np.int32) if tops else np.zeros(0, np.int32)

    @F.pandas_udf("int")
    def seen_from(x: pd.Series) -> pd.Series:
        """The range that looks ahead at this id; -1: none does."""
        ids = x.to_numpy()
        at = np.minimum(np.searchsorted(firsts, ids), max(len(firsts) - 1, 0))
        return pd.Series(np.where(firsts[at] == ids, before[at], -1)).astype("int32")

    own = docs.select("doc_id", key.alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    own = own.withColumns({"own": part("key"), "other": seen_from("key")})
    mine = F.struct(F.col("own").alias("part"), F.lit(0).alias("ahead"))
    both = F.array(mine, F.struct(F.col("other").alias("part"), F.lit(1).alias("ahead")))
    own = own.withColumn("to", F.explode(F.when(F.col("other") < 0, F.array(mine)).otherwise(both)))
    return own.select("to.part", "to.ahead", "doc_id", "key", "text")


def fingerprinted(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """Fingerprints of all texts and of their edited forms, in tasks of some RANGE_BYTES."""
    if not buckets:
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        buckets = max(2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), ceil(size / RANGE_BYTES))
    rows = neighbours(docs, buckets)
    sha = F.sha1("text")
    rows = rows.repartitionById(buckets, "part").withColumn("tie", sha).sortWithinPartitions("part", "ahead", F.desc("key"), "tie")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # part, doc_id, text, phrases of its head, state, signature
        done = None  # part for which a row ahead was read
        out: list[tuple] = []

        def begin(part, doc_id, text):
            keep, phrases = len(text) - len(text) // 3, set()
            state = parse(text[:keep], phrases)
            full = phrases.copy()
            parse(text[keep:], full, state)
            return part, doc_id, text, keep, phrases, state, signature(full)

        def finish(now, text, sig):
            _, doc_id, own, keep, phrases, state, mine = now
            tail = text[: len(own) - keep]
            parse(tail, phrases, state)
            theirs = signature(phrases)
            out.append((doc_id, len(own), hashlib.sha256((own[:keep] + tail).encode()).hexdigest(), encoded(mine), encoded(theirs), likeness(mine, theirs), likeness(mine, sig)))

        for batch in batches:
            for part, ahead, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("part", "ahead", "doc_id", "text")), strict=True):
                if ahead:
                    if done != part and held and held[0] == part:
                        finish(held, text, fingerprint(text))
                        done, held = part, None
                    continue
                now = begin(part, doc_id, text)
                if held and held[0] == part:
                    finish(held, text, now[-1])
                held = now
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), FIELDS, strict=True)], schema=FIELDS)
                out = []
        if held:
            raise RuntimeError(f"range {held[0]} has no row ahead")

    return rows.mapInArrow(run, SCHEMA)


def op9_fingerprints(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and their edited texts."""
    return fingerprinted(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
