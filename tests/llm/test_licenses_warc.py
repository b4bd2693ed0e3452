"""License scans and WARC archives on small tables."""

import base64
import hashlib
import random
import re

from pyspark.sql import functions as F

from millrace.llm import licenses, warc
from millrace.llm.common import Scratch

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def base(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    found = [(i, label) for p, label in licenses.BASE.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    at = sorted(i for i, _ in found)
    return len(words), len(found), at[0] if at else None, at[-1] if at else None, ",".join(sorted({x for _, x in found}))


def scan(spark, texts):
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").withColumn("s_", F.lit(1)).withColumn("hit_", F.lit(1))
    return licenses.scanned(d).select("doc_id", "licenses_.n_words", "licenses_.found.*").orderBy("doc_id").collect()


def test_base_places_match_brute_force(spark):
    r = random.Random(4)
    bits = ["GNU", "General", "public", "LICENSE", "apache", "Apache-License", "cc", "by", "CC_BY", "mit", "MIT License", "x", "é", "\n", "İ", "commit license", "ccby"]
    texts = ["".join(r.choice(bits) + r.choice([" ", "-", ".\n", "_"]) for _ in range(r.randint(0, 25))) for _ in range(150)]
    texts += [None, "", "the mit license " * 3000, "MIT license mit license", "GNU  General\nPublic--License"]
    for row, t in zip(scan(spark, texts), texts, strict=True):
        assert (row["n_words"], row["n_base"], row["first_word"], row["last_word"], row["base_labels"]) == base(t), t[:80] if t else t
        assert set(filter(None, row["base_labels"].split(","))) <= set(filter(None, row["labels"].split(",")))
        assert 0 <= row["score"] <= 1


def survivors(text):
    """Labels and best priority by all intervals against all others."""
    s = " " + " ".join(WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))) + " "
    found = [(m.start(), m.end(), p, i, label) for i, (label, key, rx, p) in enumerate(licenses.rules()) if key in s for m in re.finditer(f"(?<= )(?:{rx})(?= )", s)]

    def hidden(x):
        for y in found:
            if y[0] <= x[0] and x[1] <= y[1] and (y[2] > x[2] or (y[2] == x[2] and ((y[0], y[1]) != (x[0], x[1]) or y[3] < x[3]))):
                return True
        return False

    left = [x for x in found if not hidden(x)]
    return {x[4] for x in left}, max((x[2] for x in left), default=0)


def test_detections_match_brute_force(spark):
    r = random.Random(9)
    phrases = [re.sub(r"\(\?[:!][^()]*\)\??|\[sc\]|[()?\\]", lambda m: "c" if m[0] == "[sc]" else "", rx).split("|")[0] for _, _, rx, _ in licenses.rules()]
    tails = ["or later", "only", "version 2", "2 0", "2", "license", "or", "international", "the", "of the license", "CC BY", "4.0"]
    texts = [" ".join(f"{r.choice(phrases)} {r.choice(tails)}" for _ in range(r.randint(1, 8))) for _ in range(200)]
    texts += [None, "", "the same", "the same", "MPL 1.1, LGPL 2.1 " * 400, "in the public\ndomain"]
    labels = set()
    for row, t in zip(scan(spark, texts), texts, strict=True):
        own, best = survivors(t)
        assert set(filter(None, row["labels"].split(","))) == own | set(filter(None, row["base_labels"].split(","))), t
        assert row["score"] == ({3: 1.0, 2: 0.8}.get(best) or (0.6 if row["n_base"] else 0.0))
        labels |= own
    assert len(labels) > 100
    d = spark.createDataFrame([], "doc_id long, text string")
    assert licenses.scanned(d).count() == 0


def test_places_of_very_long_texts(spark):
    """More places than a block holds, at its edges and well beyond it."""
    for n in (licenses.BLOCK - 1, licenses.BLOCK, licenses.BLOCK + 1, 20_000):
        d = spark.createDataFrame([(" " + "mit license x " * n,)], "t string").select(F.explode(licenses.detections(F.col("t"))).alias("d")).select("d.*")
        got = sorted((x["start"], -x["neg_end"]) for x in d.where("label = 'mit'").collect())
        assert got == sorted({(1 + 14 * i, 12 + 14 * i) for i in range(n)}), n


def test_the_first_of_tied_rules_stands(spark, monkeypatch):
    table = [("zz", "mit ", "mit licen[sc]e", 2), ("aa", "mit ", "mit license", 2)]
    monkeypatch.setattr(licenses, "rules", lambda: table)
    assert scan(spark, ["an mit license"])[0]["labels"] == "mit,zz"
    assert survivors("an mit license") == ({"zz"}, 2)


def test_signatures_and_containment(spark):
    texts = ["Licensed under the Apache License, Version 2.0", "GNU General Public License v3 or later", "under the BSD 3-Clause License", "CC BY-NC-SA 4.0", "the Mozilla Public License 2.0 only and an MIT License",
             "GNU Lesser General Public License 2.1", "all rights\nreserved", "no terms here"]
    got = [r["labels"] for r in scan(spark, texts)]
    assert got == ["apache,apache-2.0", "gpl,gpl-3.0-or-later", "bsd-3-clause", "cc-by,cc-by-nc-sa-4.0", "mit,mpl-2.0-only", "lgpl-2.1", "all-rights-reserved", ""]


def test_every_rule_is_reached_by_the_stems(spark):
    assert len(licenses.rules()) > 200
    for label, key, rx, _ in licenses.rules():
        assert any(s.split()[0] in key + rx for s in licenses.STEMS) or key == "cc", label
        re.compile(rx)


def test_warc_round_trip(spark):
    big = "".join(random.Random(1).choice("abc\r\n<é") for _ in range(700_000))
    rows = [(5, "u", "same"), (3, "u", "same"), (9, "u", "same"), (1, None, None), (2, "a\r\nb", ""), (7, "v", big), (8, "w", big), (4, "x", "WARC/1.1\r\nWARC-Type: response\r\n\r\n"), (None, "y", "lost"), (None, "y", "same")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("refers_to", F.lit("clash")).repartition(3)
    archives = warc.archived(pages, Scratch(spark))
    chunks = warc.read_archives(archives).collect()
    whole = {}
    for c in sorted(chunks, key=lambda c: c["chunk_no"]):
        assert len(c["data"]) <= warc.CHUNK
        whole.setdefault((c["record_id"], c["page_id"]), []).append(c)
    assert len(whole) == len(rows) or sum(c["last"] for c in chunks) == len(rows)
    first = {}
    for p, _, h in rows:
        if p is not None:
            first[h or ""] = min(p, first.get(h or "", p))
    html = {p: (h or "").encode() for p, _, h in rows if p is not None}
    lost = [c for c in chunks if c["page_id"] is None and c["last"]]
    assert sorted((c["record_type"], c["refers_to"] or 0, c["payload_bytes"]) for c in lost) == [("response", 0, 4), ("revisit", 3, 4)]
    for (_, p), cs in whole.items():
        if p is None:
            continue
        last, raw = cs[-1], html[p]
        assert last["last"] and last["payload_bytes"] == len(raw)
        assert last["payload_digest"] == base64.b32encode(hashlib.sha1(raw).digest()).decode()
        root = first[raw.decode()]
        assert (last["record_type"], last["refers_to"]) == (("response", None) if p == root else ("revisit", root))
        assert b"".join(c["data"] for c in cs) == (raw if p == root else b"")
    assert max(c["chunk_no"] for c in chunks) > 1


def test_warc_small_payloads_and_no_pages(spark):
    pages = spark.createDataFrame([(1, "u", "aa"), (2, "u", "aa"), (3, "u", "aaaa"), (4, "u", "aaaa")], "page_id long, url string, html string")
    out = {c["page_id"]: c["refers_to"] for c in warc.read_archives(warc.archived(pages, Scratch(spark), min_bytes=3)).where("last").collect()}
    assert out == {1: None, 2: None, 3: None, 4: 3}
    assert warc.archived(pages.limit(0), Scratch(spark)).count() == 0


def test_warc_rows_that_share_an_id(spark):
    rows = [(1, "u", "aa"), (2, "u", "bb"), (5, "u", "aa"), (5, "u", "own"), (6, "u", "aa"), (6, "u", "bb"), (6, "u", "bb")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    out = sorted(((c["page_id"], c["record_type"], c["refers_to"] or 0, bytes(c["data"])) for c in warc.read_archives(warc.archived(pages, Scratch(spark))).where("last").collect()))
    assert out == [(1, "response", 0, b"aa"), (2, "response", 0, b"bb"), (5, "response", 0, b"own"), (5, "revisit", 1, b""), (6, "revisit", 1, b""), (6, "revisit", 2, b""), (6, "revisit", 2, b"")]


def test_warc_pages_without_ids(spark):
    rows = [(5, "u", "aa"), (None, "u", "aa"), (None, "v", "aa"), (None, "w", "own"), (None, "w", "own")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    out = sorted((c["page_id"] or 0, c["record_type"], c["refers_to"] or 0, bytes(c["data"])) for c in warc.read_archives(warc.archived(pages, Scratch(spark))).where("last").collect())
    assert out == [(0, "response", 0, b"own"), (0, "response", 0, b"own"), (0, "revisit", 5, b""), (0, "revisit", 5, b""), (5, "response", 0, b"aa")]
