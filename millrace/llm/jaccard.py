"""N-gram Jaccard join by universe partition and the pigeonhole principle.

Sets of word shingles with similarity ``num / den`` or more, of sizes r and s, differ in
``(r + s) (den - num) / (den + num)`` shingles at most. Sizes fall in bands whose ratio is
such that partners are in the same or the next band; a scheme belongs to a band and serves
pairs whose larger set lies there. With H the most that such a pair may differ in, the
scheme hashes the universe of shingles into H + 1 segments, so that a pair agrees in one.

Segments that hold nothing say nothing, so a scheme allocates by cost: ``slack`` segments
are indexed with their one-deletion neighbourhoods too, which raises what the pigeonhole
can bear by one each, and in exchange a set may leave out that many keys without content:
for the first segments in order, as long as their losses stay within the slack. The losses
of the set that leaves out more cover those of its partner, so no pair is lost. The slack
covers what sets mostly lose, and more the more documents there are, so that keys without
content stay rare. Low thresholds need many keys; their schemes are indexed in turns, so
that only a share of the keys is in a shuffle at once.

Which keys a set is looked up by is allocated by measured cost. A pair is looked for by its
larger set alone, whose size, not the band's, bounds how far the two can be apart: what the
scheme has beyond that is the set's spare, and as many keys may be left out of its lookups.
They are those that most sets share, by count. All keys of all sets stay in the index; a key
by which nobody looks is dropped.

Equal sets are one node from the start. A key's nodes are linked in rounds: each node tries
one partner a round, and only keys whose nodes are still in several components stay open;
a large group of near copies thus costs a few pairs a node. Groups that stay open after
ROUNDS, or after a round that closed hardly any key, hold sets that are alike but mostly don't link, and share the keys of what they have
in common. There each set is taken as its differences from the group's consensus, the
shingles that more than half of its sets have: that keeps all distances, and leaves what a
set has of its own. Sets at distances d and e from the consensus that link share (d + e - H) / 2
differences or more, so that, from the rarest on, one of the first H / 2 + 1 of the nearer set
is among the first H + 1 of the other; where d + e is H or less, both link with the set
nearest to the consensus, which joins them before any pair is made. Candidates are sifted by sizes and parity bitmaps (which can't
differ in more bits than the sets in shingles) and every link is verified on the whole sets;
components are found by contraction in written tables. The results are exact but for
collisions of 64-bit shingle hashes within a pair; colliding set digests are detected, and
the join starts over with another seed.

Null texts, empty texts and texts without words have no shingles and no links. Texts with
fewer words than a shingle have one, the whole sequence; very long texts are whole sets like
any other, of which a task holds one. Rows that share an id are rows of their own, repeated
rows and ties (equal sets) are one node with several rows; rows of null id can link others,
and give their component's id only where it has no other. An empty table gives an empty
result. Only doc_id and text are read, so further columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, exp, log, sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, Scratch, fresh

BAND = 13, 10  # a band's upper end over its lower one
ROUNDS = 4
PAYS = 0.9  # a round that leaves a larger share of the open keys is the last
CACHE_WORDS = 50_000  # about 10 MB
FLUSH_KEYS = 100_000
SEEDS = 3
SET_SCHEMA = "doc_id long, digest long, n long, node long, check long, b0 long, b1 long, b2 long, b3 long, spare long, own array<long>, over array<long>"
SET_FIELDS = pa.schema([*((x, pa.int64()) for x in ("doc_id", "digest", "n", "node", "check", "b0", "b1", "b2", "b3", "spare")), *((x, pa.list_(pa.int64())) for x in ("own", "over"))])


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingles:
    """Sorted distinct shingle hashes of texts."""

    def __init__(self, k: int, seed: int = 0):
        self.k, self.seed, self.known = k, seed, {}

    def hashed(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word, self.seed)
        if len(word) <= 64:
            if len(self.known) >= CACHE_WORDS:
                self.known.clear()
            self.known[word] = h
        return h

    def __call__(self, text: bytes | None) -> np.ndarray:
        """Of UTF-8; bytes are lower-cased and split as ASCII, other letters stay as they are."""
        words = (text or b"").lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        known = self.known
        w = np.fromiter((known.get(x) or self.hashed(x) for x in words), np.uint64, len(words))
        k = min(self.k, len(w))
        h = np.full(len(w) - k + 1, k, np.uint64)
        for j in range(k):
            h = h * np.uint64(0x9E3779B97F4A7C15) + w[j : len(w) - k + 1 + j]
            h ^= h >> np.uint64(29)
        return np.unique(mixed(h))


class Schemes:
    """Bands, schemes and keys for a threshold num / den."""

    def __init__(self, num: int, den: int, spread: float = 2.0, part: int = 0, parts: int = 1):
        self.num, self.den, self.spread = num, den, spread
        self.part, self.parts = part, parts  # keys are made of every parts-th scheme
        self.low = [1]  # of each band
        self.made: dict[int, tuple[int, int]] = {}

    def _more(self) -> None:
        up, down = BAND
        self.low.append(max(self.low[-1] * up // down, self.low[-1] * self.den // self.num) + 1)

    def _band(self, n: int) -> int:
        while self.low[-1] <= n:
            self._more()
        return int(np.searchsorted(self.low, n, side="right")) - 1

    def of(self, n: int) -> list[int]:
        """The schemes in which a set of n takes part."""
        k = self._band(n)
        upper = n * self.den // self.num
        while len(self.low) <= k + 1:
            self._more()
        return [k, k + 1] if upper >= self.low[k + 1] else [k]

    def layout(self, k: int) -> tuple[int, int]:
        """Segments and slack of scheme k."""
        if k not in self.made:
            while len(self.low) <= k + 1:
                self._more()
            most = self.low[k + 1] - 1
            m = 2 * most * (self.den - self.num) // (self.den + self.num) + 1
            per = max(1, self.low[k] * self.num // self.den) / m  # of the smallest sets
            none, one = exp(-per), per * exp(-per)
            slack = 0
            # each unit of slack costs the keys of a neighbourhood; it must cover what sets mostly lose
            while slack < m:
                lost = (m - slack) * none + slack * (2 * none + one)
                if slack >= ceil(lost + self.spread * sqrt(lost)) or m == 1:
                    break
                slack += 1
            self.made[k] = m, slack
        return self.made[k]

    def keys(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """The keys of a set of sorted hashes in its own band's scheme and in the next one's; segments are ranges of hashes.

        Last, how many of its own keys it may leave out when it looks for sets of its size or smaller.
        """
        out, spare = [np.zeros(0, np.uint64)] * 2, 0
        content = mixed(h + np.uint64(0x632BE59BD9B4E019))
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(content, dtype=np.uint64)])
        for over, k in enumerate(self.of(len(h))):
            if k % self.parts != self.part:
                continue
            m, slack = self.layout(k)
            segment = ((h >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
            ends = np.searchsorted(segment, np.arange(m + 1, dtype=np.uint64))
            size = np.diff(ends)
            place = np.arange(m)
            salt = mixed(place.astype(np.uint64) + np.uint64((k + 1) << 40))
            sums = total[ends[1:]] - total[ends[:-1]]
            loss = np.where(place < slack, np.maximum(2 - size, 0), size == 0)
            may_omit = np.cumsum(loss) <= slack
            found = [mixed(sums + salt)[(size > 0) | ~may_omit]]
            if slack:
                at = np.repeat(place[:slack], size[:slack])
                less = sums[at] - content[: len(at)]
                found.append(mixed(less + salt[at])[(size[at] > 1) | ~may_omit[at]])
            out[over] = np.unique(np.concatenate(found))
            if not over:  # the key of an empty segment bears for its neighbourhood too
                both = int(((size == 0) & (place < slack) & ~may_omit).sum())
                spare = max(0, m - 1 - 2 * len(h) * (self.den - self.num) // (self.den + self.num) - both)
        return *out, spare


def lists(arrays: list[np.ndarray | None]) -> pa.ListArray:
    """A column of int64 lists; None is null."""
    sizes = np.cumsum([0, *(0 if x is None else len(x) for x in arrays)])
    flat = np.concatenate([np.zeros(0, np.int64), *(x.view(np.int64) for x in arrays if x is not None)])
    return pa.ListArray.from_arrays(pa.array(sizes, pa.int32(), mask=np.array([*(x is None for x in arrays), False])), pa.array(flat))


def set_rows(docs: DataFrame, k: int, seed: int, schemes: tuple) -> DataFrame:
    """Of each document: digest of its text, size, digest of its set (node), second digest, parity bitmap, spare and keys.

    Keys are null in rows whose set the task has lately seen.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, made, seen = Shingles(k, seed), Schemes(*schemes), set()
        head, keys, held = [], [], 0
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            for i, (doc_id, digest) in enumerate(zip(batch.column("doc_id").cast(pa.int64()).to_pylist(), batch.column("digest").to_pylist(), strict=True)):
                h = shingles(texts[i].as_py())
                if not len(h):
                    head.append((doc_id, digest, 0, *[None] * 7))
                    keys.append((None, None))
                    continue
                node, check = np.array([mixed(h).sum(dtype=np.uint64), mixed(h ^ np.uint64(0xD1B54A32D192ED03)).sum(dtype=np.uint64) + np.uint64(len(h))]).view(np.int64).tolist()
                odd = np.packbits((np.bincount((h & np.uint64(255)).astype(np.int64), minlength=256) & 1).astype(np.uint8)).view(np.int64).tolist()
                own, over, spare = (None, None, None) if node in seen else made.keys(h)
                head.append((doc_id, digest, len(h), node, check, *odd, spare))
                keys.append((own, over))
                held += 0 if own is None else len(own) + len(over)
                if len(seen) >= CACHE_WORDS:
                    seen.clear()
                seen.add(node)
                if held >= FLUSH_KEYS or len(keys) >= 2000:
                    yield rows(head, keys)
                    head, keys, held = [], [], 0
        if keys:
            yield rows(head, keys)

    def rows(head: list, keys: list) -> pa.RecordBatch:
        cols = [pa.array(c, pa.int64()) for c in zip(*head, strict=True)]
        return pa.RecordBatch.from_arrays([*cols, *map(lists, zip(*keys, strict=True))], schema=SET_FIELDS)

    return docs.select("doc_id", "text", F.xxhash64("text").alias("digest")).mapInArrow(run, SET_SCHEMA)


def whole_sets(docs: DataFrame, nodes: DataFrame, k: int, seed: int, scratch: Scratch) -> DataFrame:
    """(node, shingles) of the nodes, from the texts of their first rows. nodes is a written table."""
    wanted = nodes.select(F.col("first.doc_id").alias("rep"), F.col("first.digest").alias("of"), "node")
    few = wanted.count() <= BROADCAST_ROWS
    same = F.col("doc_id").eqNullSafe(F.col("rep")) & (F.col("digest") == F.col("of"))
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("digest")).join(F.broadcast(wanted) if few else wanted, same).select("node", "text")
    fields = pa.schema([("node", pa.int64()), ("shingles", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(k, seed)
        found, sets, held = [], [], 0
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            for i, node in enumerate(batch.column("node").to_pylist()):
                h = shingles(texts[i].as_py())
                if len(h) and int(mixed(h).sum(dtype=np.uint64).view(np.int64)) == node:  # digests of texts may collide
                    found.append(node)
                    sets.append(h)
                    held += len(h)
                if held >= FLUSH_KEYS:
                    yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), lists(sets)], schema=fields)
                    found, sets, held = [], [], 0
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), lists(sets)], schema=fields)

    whole = scratch.put(texts.mapInArrow(run, "node long, shingles array<long>"), "whole")
    if whole.count() > nodes.count():  # rows that are equal in id and text
        whole = scratch.put(whole.dropDuplicates(["node"]), "whole_once")
    return whole


def components(edges: DataFrame, scratch: Scratch, tag: str) -> DataFrame:
    """(x, root) of every vertex in edges (a, b), root the smallest reachable; edges is a written table.

    Each vertex hooks to its smallest neighbour if that is smaller, pointers are doubled
    until they end at roots, and the edges between roots are what the next turn sees.
    """
    left, total, turn = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), None, 0
    while True:
        left = scratch.put(left, f"{tag}_left{turn}")
        if left.isEmpty():
            return total
        hook = left.groupBy(F.col("b").alias("x")).agg(F.min("a").alias("root"))
        tops = left.select(F.col("a").alias("x"), F.col("a").alias("root"))
        link = scratch.put(hook.unionByName(tops).groupBy("x").agg(F.min("root").alias("root")), f"{tag}_hook{turn}_0")
        for step in range(1, 64):
            up = link.select(F.col("x").alias("y"), F.col("root").alias("further"))
            link = scratch.put(link.join(up, F.col("root") == F.col("y"), "left").select("x", F.coalesce("further", "root").alias("root"), (F.col("further") != F.col("root")).alias("moved")), f"{tag}_hook{turn}_{step}")
            moved = not link.where("moved").isEmpty()
            link = link.select("x", "root")
            if not moved:
                break
        to = link.select(F.col("x").alias("y"), F.col("root").alias("to"))
        total = link if total is None else scratch.put(total.join(to, F.col("root") == F.col("y"), "left").select("x", F.coalesce("to", "root").alias("root")), f"{tag}_total{turn}")
        ends = left.join(to, F.col("a") == F.col("y")).select(F.col("to").alias("a"), "b").join(to, F.col("b") == F.col("y")).select("a", F.col("to").alias("b"))
        left, turn = ends.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), turn + 1


class Join:
    """The state of one join: nodes, open keys, tested pairs and labels in written tables."""

    def __init__(self, docs: DataFrame, scratch: Scratch, k: int, num: int, den: int):
        self.docs, self.scratch, self.k, self.num, self.den = docs, scratch, k, num, den
        self.parts = max(1, 20 * (den - num) // den - 1)
        self.spread = sqrt(2 * log(max(docs.count(), 1000) / 500))
        for self.seed in range(SEEDS):
            self.sets = scratch.put(self.keyed(0), "sets")
            first = lambda c: F.min(c).alias(c)
            row = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "digest")).alias("first")
            nodes = self.sets.where("node is not null").groupBy("node").agg(row, *map(first, ("n", "b0", "b1", "b2", "b3")), F.min("check").alias("c0"), F.max("check").alias("c1"))
            self.nodes = scratch.put(nodes, "nodes")
            if self.nodes.where("c0 <> c1").isEmpty():
                break
        else:
            raise RuntimeError("set digests collide under every seed")

    def keyed(self, part: int) -> DataFrame:
        return set_rows(self.docs, self.k, self.seed, (self.num, self.den, self.spread, part, self.parts))

    def shared_keys(self, sets: DataFrame, tag: str) -> DataFrame:
        """(key, node, looks, lo) of keys that several nodes have and one looks by; lo is the first of them.

        Of its own keys a node leaves out, from its lookups, as many as it can spare: those that most nodes share.
        """
        per = Window.partitionBy("key")
        side = lambda c, spare: F.transform(c, lambda k: F.struct(k.alias("key"), spare.alias("spare")))
        none = F.lit(None).cast("long")  # the spare of keys that are not the node's own; what windows can find again isn't exchanged
        keys = sets.where("own is not null").select("node", F.explode(F.concat(side("own", F.coalesce("spare", F.lit(0))), side("over", none))).alias("k")).select("k.*", "node")
        keys = keys.withColumns({"lo": F.min("node").over(per), "hi": F.max("node").over(per), "nodes": F.count(F.lit(1)).over(per), "looked": F.max("spare").over(per)}).where("lo < hi and looked is not null")
        keys = self.scratch.put(keys.select("key", "node", "spare", "nodes"), f"{tag}_all")
        once = keys.repartition("node").groupBy("node", "key").agg(F.max("spare").alias("spare"), F.max("nodes").alias("nodes"))  # tasks may each have seen a set
        own = F.col("spare").isNotNull()
        rank = F.row_number().over(Window.partitionBy("node", own).orderBy(F.desc("nodes"), "key"))
        once = once.select("key", "node", F.coalesce(own & (rank > F.col("spare")), F.lit(False)).alias("looks"))
        once = once.withColumns({"looked": F.max("looks").over(per), "lo": F.min("node").over(per)})
        out = self.scratch.put(once.where("looked").select("key", "node", "looks", "lo"), tag)
        self.scratch.drop(f"{tag}_all")
        self.scratch.release()
        return out

    def most_apart(self):
        return F.expr(f"(nu + nv) * {self.den - self.num} div {self.den + self.num}")

    def sifted(self, pairs: DataFrame) -> DataFrame:
        """Pairs (u, v) that sizes and bitmaps allow."""
        side = lambda s: self.nodes.select(F.col("node").alias(s), F.col("n").alias(f"n{s}"), *[F.col(f"b{i}").alias(f"{s}{i}") for i in range(4)])
        return pairs.join(side("u"), "u").join(side("v"), "v").where(self.may_link()).select("u", "v", "nu", "nv")

    def may_link(self):
        apart = sum((F.bit_count(F.col(f"u{i}").bitwiseXOR(F.col(f"v{i}"))) for i in range(1, 4)), F.bit_count(F.col("u0").bitwiseXOR(F.col("v0"))))
        return (F.least("nu", "nv") * self.den >= F.greatest("nu", "nv") * self.num) & (apart <= self.most_apart())

    def verified(self, pairs: DataFrame, tag: str) -> DataFrame:
        """The pairs (u, v, nu, nv) that link.

        The pairs are counted and go to the sets of their first nodes if they are few, which
        saves an exchange of all sets.
        """
        pairs = self.scratch.put(pairs, f"{tag}_pairs")
        pairs = F.broadcast(pairs) if pairs.count() <= BROADCAST_ROWS else pairs
        a = self.whole.select(F.col("node").alias("u"), F.col("shingles").alias("x"))
        b = self.whole.select(F.col("node").alias("v"), F.col("shingles").alias("y"))
        both = a.join(pairs, "u").join(b, "v").select("u", "v", "nu", "nv", F.size(F.array_intersect("x", "y")).cast("long").alias("i"))
        links = self.scratch.put(both.where(F.col("i") * self.den >= (F.col("nu") + F.col("nv") - F.col("i")) * self.num).select(F.col("u").alias("a"), F.col("v").alias("b")), tag)
        self.scratch.release()  # the sets of a round's pairs were in its shuffle
        return links

    def relabelled(self, links: DataFrame, tag: str) -> None:
        """Merge the components that the links join."""
        if links.isEmpty():
            return
        lab = lambda s, c: self.labels.select(F.col("node").alias(s), F.col("comp").alias(c))
        edges = links.join(lab("a", "ca"), "a").join(lab("b", "cb"), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
        roots = components(self.scratch.put(edges.where("a <> b").distinct(), f"{tag}_edges"), self.scratch, tag)
        if roots is not None:
            self.labels = self.scratch.put(self.labels.join(roots, F.col("comp") == F.col("x"), "left").select("node", F.coalesce("root", "comp").alias("comp")), f"{tag}_labels")

    def still_open(self, keys: DataFrame, tag: str) -> DataFrame:
        """(key, node, looks, comp, lo, hi) of keys with several components; lo and hi are nodes of the first and last."""
        per = Window.partitionBy("key")
        rows = keys.select("key", "node", "looks").join(self.labels, "node")
        at = F.struct("comp", "node")
        rows = rows.withColumns({"lo": F.min(at).over(per), "hi": F.max(at).over(per)}).where("lo.comp < hi.comp")
        return self.scratch.put(rows.select("key", "node", "looks", "comp", "lo", "hi"), tag)

    def candidates(self, rows: DataFrame) -> DataFrame:
        """(u, v, nu, nv) of pairs in several components of an open group that may link, by their differences from its consensus.

        Sets near the consensus are linked first, without a pair each, so that their pairs aren't made.
        """
        s, den, num = self.scratch, self.den, self.num
        edges = s.put(rows.select(F.col("lo.node").alias("a"), F.col("node").alias("b")).where("a <> b").distinct(), "group_edges")
        groups = components(edges, s, "group").select(F.col("x").alias("node"), F.col("root").alias("g"))
        member = rows.select("node", "comp").distinct().join(groups, "node").join(self.nodes.select("node", "n", "b0", "b1", "b2", "b3"), "node")
        member = s.put(member, "member")
        sets = member.join(self.whole, "node")
        often = sets.select("g", F.explode("shingles").alias("e")).groupBy("g", "e").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
        often = often.join(member.groupBy("g").agg(F.count(F.lit(1)).alias("many")), "g").where("2 * c > many")
        common = s.put(often.groupBy("g").agg(F.collect_list("e").alias("common")), "common")  # no more than twice a mean set
        none = F.coalesce("common", F.array().cast("array<long>"))
        differ = sets.join(common, "g", "left").withColumn("differ", F.concat(F.array_except("shingles", none), F.array_except(none, "shingles")))
        differ = s.put(differ.drop("shingles", "common").withColumn("d", F.size("differ")), "differ")

        # sets whose distances from the consensus add up to H or less link with the nearest, whatever they hold
        out = F.expr(f"d * {den + num} - n * {den - num}").alias("out")
        least = differ.select("g", "node", "comp", out)
        head = least.groupBy("g").agg(F.min(F.struct("out", "node", "comp")).alias("z"))
        star = least.join(head, "g").where("comp <> z.comp and out + z.out <= 0").select(F.col("node").alias("a"), F.col("z.node").alias("b"))
        self.relabelled(s.put(star, "star"), "star")
        differ = differ.drop("comp").join(self.labels, "node")

        each = differ.select("g", "node", F.explode("differ").alias("e"))
        shared = each.groupBy("g", "e").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
        ranked = each.join(shared, ["g", "e"]).groupBy("node").agg(F.sort_array(F.collect_list(F.struct("c", "e"))).alias("rare"))
        most = F.expr(f"n * {den - num} div {num}")  # the H of a set with its largest partner
        alone = F.col("d") - F.size("rare")  # these come first
        first = differ.drop("differ").join(ranked, "node").withColumns({"most": most, "alone": alone}).withColumn("rare", F.slice("rare", 1, F.greatest(F.lit(0), F.col("most") + 1 - F.col("alone")).cast("int")))
        first = first.select("g", "node", "comp", "n", "d", "b0", "b1", "b2", "b3", "most", "alone", F.posexplode("rare").alias("at", "rare"))
        first = s.put(first.withColumn("near", F.col("alone") + F.col("at") <= F.expr("most div 2")).withColumn("e", F.col("rare.e")).drop("rare", "most", "alone", "at"), "first")
        side = lambda x, rows: rows.select("g", "e", F.col("node").alias(x), F.col("comp").alias(f"c{x}"), F.col("n").alias(f"n{x}"), F.col("d").alias(f"d{x}"), *[F.col(f"b{i}").alias(f"{x}{i}") for i in range(4)])
        nearer = (F.col("dv") < F.col("du")) | ((F.col("dv") == F.col("du")) & (F.col("v") < F.col("u")))
        pairs = side("u", first).join(side("v", first.where("near")), ["g", "e"]).where(nearer & (F.col("cu") != F.col("cv")) & self.may_link()).select("u", "v", "nu", "nv")

        return pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "nu", "nv").dropDuplicates(["u", "v"])

    def run(self) -> DataFrame:
        """(node, comp, component_id) of all nodes: a node that stands for the component, and the smallest id of its documents."""
        s = self.scratch
        shared = self.shared_keys(self.sets, "shared0")
        light = s.put(self.sets.drop("spare", "own", "over"), "light")
        s.drop("sets")
        self.sets = light
        for part in range(1, self.parts):
            shared = shared.unionByName(self.shared_keys(self.keyed(part), f"shared{part}"))
        met = s.put(shared.select("node").distinct(), "met")
        self.whole = whole_sets(self.docs, s.put(self.nodes.join(met, "node").select("node", "first"), "wanted"), self.k, self.seed, s)
        self.labels = s.put(met.select("node", F.col("node").alias("comp")), "labels")
        tries = shared.where("node <> lo").groupBy("node", F.col("lo").alias("other")).agg(F.count(F.lit(1)).alias("c"))
        tested, rows, r, left = None, shared, 0, shared.count()
        while left:
            if r:
                other = F.when(F.col("comp") != F.col("lo.comp"), F.col("lo.node")).otherwise(F.when(F.col("comp") != F.col("hi.comp"), F.col("hi.node")))
                tries = rows.withColumn("other", other).where("other is not null").groupBy("node", "other").agg(F.count(F.lit(1)).alias("c"))
            tries = tries.select(F.least("node", "other").alias("u"), F.greatest("node", "other").alias("v"), "node", "c")
            if tested is not None:
                tries = tries.join(tested, ["u", "v"], "left_anti")
            best = tries.groupBy("node").agg(F.max(F.struct("c", "u", "v")).alias("t")).select("t.u", "t.v").distinct()
            best = s.put(best, f"try{r}")
            tested = best if tested is None else tested.unionByName(best)
            self.relabelled(self.verified(self.sifted(best), f"links{r}"), f"round{r}")
            r, before = r + 1, left
            rows = self.still_open(rows, f"open{r}")
            left = rows.count()
            if left and (r == ROUNDS or left > PAYS * before):
                pairs = self.candidates(rows).join(tested, ["u", "v"], "left_anti")
                self.relabelled(self.verified(pairs, "links_last"), "last")
                break
        named = self.nodes.select("node", F.col("first.doc_id").alias("doc_id")).join(self.labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        named = s.put(named, "named")
        smallest = named.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
        smallest = s.put(smallest, "smallest")
        out = s.put(named.join(smallest, "comp").select("node", "comp", "component_id"), "components")
        s.keep("light", "components")
        return out


def linked_rows(docs: DataFrame, scratch: Scratch, k: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """doc_id, digest of the text, n, comp and component_id of every row of docs; both are null without shingles."""
    join = Join(docs, scratch, k, num, den)
    found = join.run().withColumnRenamed("node", "of")
    rows = join.sets.select("doc_id", "digest", "n", "node")
    return rows.join(found, F.col("node") == F.col("of"), "left").drop("of")


def linked(docs: DataFrame, scratch: Scratch, k: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of docs (doc_id, text)."""
    out = linked_rows(docs, scratch, k, num, den)
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def first_of_each(docs: DataFrame, scratch: Scratch, **rules) -> DataFrame:
    """One row of each component, with the columns of docs: the smallest id, null last, and of one id the smallest digest.

    Rows that share an id and differ in text are told apart by the digest of their text. Rows
    without shingles are linked to nothing and stay; of those equal in id and text, one does.
    Nulls, very long texts and empty tables are as for the join; further columns may be of any
    type and have any name.
    """
    own = Scratch(docs.sparkSession)
    light = linked_rows(docs, own, **rules).select("doc_id", "digest", "comp")
    ids = scratch.put(light, "linked").where("comp is not null or doc_id is not null")
    own.drop()
    own.release()
    hint = lambda t: F.broadcast(t) if t.count() <= BROADCAST_ROWS else t
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "digest")).alias("first")
    several = ids.where("comp is not null").groupBy("comp").agg(first, F.count(F.lit(1)).alias("n")).where("n > 1")
    several = scratch.put(several.select(F.col("comp").alias("of"), F.col("first.doc_id").alias("first_id"), F.col("first.digest").alias("first_digest")), "several")
    member = ids.join(hint(several), F.col("comp") == F.col("of"))
    stays = F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("digest") == F.col("first_digest"))
    key = [F.col("doc_id").alias("other_id"), F.col("digest").alias("other_digest")]
    gone = scratch.put(member.where(~stays).select(*key).distinct(), "gone")
    copies = member.where(stays).select(*key).unionByName(ids.where("comp is null").select(*key))
    twice = scratch.put(copies.groupBy("other_id", "other_digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "twice")
    name = fresh(docs, "digest")
    same = F.col("doc_id").eqNullSafe(F.col("other_id")) & (F.col(name) == F.col("other_digest"))
    kept = docs.withColumn(name, F.xxhash64("text")).join(hint(gone), same, "left_anti")
    if twice.isEmpty():
        return kept.drop(name)
    single = kept.join(hint(twice), same, "left_anti").drop(name)
    again = kept.join(hint(twice), same, "left_semi")
    whole_row = F.struct("text", *[c for c in docs.columns if c not in ("doc_id", "text")])
    best = again.groupBy("doc_id", name).agg(F.min_by(whole_row, F.to_json(whole_row)).alias(row := fresh(again, "row")))  # maps have no order
    return single.unionByName(best.select(*[F.col("doc_id") if c == "doc_id" else F.col(f"{row}.{c}").alias(c) for c in docs.columns]))


def op10_jaccard(spark, sf_dir: str) -> DataFrame:
    """All documents: 3-word shingles, similarity 0.9."""
    return linked(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), Scratch(spark), k=3, num=9, den=10)


OP10_SQL = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id,
         list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), s AS (
  SELECT DISTINCT r, doc_id, hash(g) AS g FROM (
    SELECT r, doc_id, w[i:i + 2] AS g FROM (SELECT *, unnest(generate_series(1, greatest(len(w) - 2, 1))) AS i FROM d WHERE len(w) > 0))
), n AS (
  SELECT r, doc_id, count(*) AS n FROM s GROUP BY r, doc_id
), p AS (
  SELECT a.r AS x, b.r AS y, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.r < b.r GROUP BY a.r, b.r
), e AS (
  SELECT x, y FROM p JOIN n a ON a.r = x JOIN n b ON b.r = y WHERE 100 * i >= 90 * (a.n + b.n - i)
), l AS (
  SELECT x, y FROM e UNION ALL SELECT y, x FROM e
), c AS (
  SELECT r AS x, r AS y FROM n UNION SELECT c.x, l.y FROM c JOIN l ON c.y = l.x
)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(m.component_id, d.doc_id) AS component_id
FROM d LEFT JOIN n USING (r) LEFT JOIN (SELECT c.x AS r, min(z.doc_id) AS component_id FROM c JOIN d z ON z.r = c.y GROUP BY c.x) m USING (r)
"""
