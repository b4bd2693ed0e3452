"""Mixing, quality rules and chat formatting on small tables."""

import hashlib
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from millrace.llm import chat, mixing, quality
from millrace.llm.common import Scratch

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SPACE = " \t\n\x0b\x0c\r"


def docs(spark, rows, schema=DOCS):
    return spark.createDataFrame(rows, schema)


def odd_rows():
    r = random.Random(3)
    text = lambda n: " ".join(r.choice("alpha beta gamma delta".split()) for _ in range(n))
    rows = [(i, text(r.randint(1, 60)), "en", r.choice(["b", "a", "é", None]), 0) for i in range(60)]
    rows += [(None, text(9), None, None, None), (7, None, "en", "a", 0), (8, "", "en", "a", 0), (9, " \n ", "en", "a", 0), (3, "same row", "en", "a", 0), (3, "same row", "en", "a", 0), (99, text(30_000), "en", "b", 0)]
    return rows


def test_mix_meets_budgets_and_limits(spark):
    base = mixing.measured(docs(spark, odd_rows()))
    sizes = base.select("m.*")
    at = mixing.thresholds(sizes, Scratch(spark))
    out = mixing.mix(base, at, Scratch(spark)).select("source", "mix.*").collect()
    assert len(out) == len(odd_rows())
    total = sum(r["size"] for r in out)
    by = {}
    for r in out:
        by.setdefault(r["source"], []).append(r)
        assert 0 <= r["taken"] <= 2 * r["size"]
    assert abs(sum(g[0]["target"] for g in by.values()) - 1.5 * total) < 1e-6
    for source, g in by.items():
        own = sum(r["size"] for r in g)
        assert g[0]["source_size"] == own and g[0]["target"] <= 2 * own + 1e-9
        assert abs(sum(r["taken"] for r in g) - g[0]["target"]) <= 0.5 + 1e-9


def test_mixed_documents_repeat_whole_texts(spark):
    rows = odd_rows()
    d = docs(spark, rows).withColumn("m", F.lit(1)).withColumn("mix", F.lit("x"))
    out = mixing.mixed_documents(d, Scratch(spark))
    assert out.columns == d.columns
    texts = {r[1] for r in rows}
    got = out.collect()
    assert sum(r["text"] not in texts for r in got) <= 8  # pieces of boundary documents
    again = mixing.mixed_documents(d, Scratch(spark)).collect()
    key = lambda r: (str(r["doc_id"]), str(r["text"]))
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_mix_of_rows_without_ids(spark):
    rows = [(1, "x " * 100, "en", "a", 0)] + [(None, f"w{i}", "en", "b", 0) for i in range(200)]
    out = mixing.mixed_documents(docs(spark, rows), Scratch(spark))
    assert {x["source"]: x["n"] for x in out.groupBy("source").agg(F.sum(F.size(F.split(F.trim("text"), " "))).alias("n")).collect()} == {"a": 200, "b": 250}


@pytest.mark.parametrize("rows", [
    [(None, f"w{i}", None, "b", 0) for i in range(200)], [(None, "word", None, "b", 0)] * 200, [(5, "two words", None, "b", 0)] * 100, [(7, f"w{i % 3} x", None, None, 0) for i in range(100)],
    [(i % 2, "one " * (i % 4), None, "b", 0) for i in range(133)], [(1, "y " * 200_000, None, "b", 0), (1, None, None, "b", 0)],
])
def test_targets_are_met_by_equal_rows(spark, rows):
    """Null ids, repeated ids and repeated rows: totals are the targets to half a word, and SQL agrees."""
    rows = [(1, "x " * 100, "en", "a", 0), *rows]
    table = docs(spark, rows).repartition(3)
    scratch = Scratch(spark)
    base = mixing.measured(table.select("doc_id", "text", "source"))
    out = mixing.mix(base, mixing.thresholds(base.select("m.*"), scratch), scratch).select("doc_id", "source", "mix.*").collect()
    assert len(out) == len(rows)
    for source in {r["source"] for r in out}:
        own = [r for r in out if r["source"] == source]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 0.5 + 1e-9
        assert all(0 <= r["taken"] <= 2 * r["size"] for r in own)
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", rows)
    key = lambda r: tuple(map(str, r))
    assert sorted(key((r["doc_id"], r["size"], r["source_size"], r["target"], r["taken"])) for r in out) == sorted(map(key, con.execute(mixing.OP1_SQL).fetchall()))


def test_mix_of_nothing(spark):
    d = docs(spark, [])
    assert mixing.mixed_documents(d, Scratch(spark)).count() == 0
    empty = docs(spark, [(1, None, None, None, None), (2, " ", "en", "a", 1)])
    assert mixing.mixed_documents(empty, Scratch(spark)).count() == 0


def repeated(words):
    seen, hit = {}, set()
    for i in range(len(words) - 2):
        seen.setdefault(tuple(words[i : i + 3]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            hit |= {i + k for i in at for k in range(3)}
    return len(hit)


def test_quality_counts_match_brute_force(spark):
    r = random.Random(5)
    texts = [" ".join(r.choice("ab") for _ in range(r.randint(0, 12))) for _ in range(80)]
    texts += ["x x x x", "a b c a b c", "l\nl\n\nl\nm", "#$ %&|<>*\nÀÉ!? ", "", None, "  no break", "a\x0bb\x0cc", " ".join(str(i % 977) for i in range(20_000))]
    m = quality.measured(docs(spark, [(i, t, "en", "s", 0) for i, t in enumerate(texts)]))
    for row in m.select("text", "quality_.*").collect():
        t = row["text"] or ""
        words = [w for w in re.split(f"[{SPACE}]+", t) if w]
        lines = [x for x in t.split("\n") if re.search(f"[^{SPACE}]", x)]
        assert row["n_words"] == len(words)
        assert row["word_chars"] == sum(map(len, words))
        assert row["n_symbols"] == sum(c in "#*$%&|<>" for c in t)
        assert row["lines"]["twice"] == len(lines) - len(set(lines))
        assert row["n_repeat_words"] == repeated(words), t[:80]


def test_quality_rejects_outliers_of_their_group(spark):
    r = random.Random(1)
    clean = lambda: " ".join("".join(r.choice("aeioustrn") for _ in range(5)) for _ in range(80))
    rows = [(i, clean(), "en", "s", 0) for i in range(150)] + [(1000, clean().replace(" ", "### "), "en", "s", 0), (1001, "short", "en", "s", 0), (1002, None, None, None, 0)]
    d = docs(spark, rows).withColumn("quality_", F.lit(1)).withColumn("w", F.lit(2))
    out = quality.good_documents(d, Scratch(spark))
    assert out.columns == d.columns
    kept = {x["doc_id"] for x in out.collect()}
    assert kept == set(range(150))
    assert quality.good_documents(docs(spark, []), Scratch(spark)).count() == 0


def test_quality_limits_blend_groups_by_their_documents(spark):
    """Against plain sums over the grid, with groups of 1 to 300 documents, null keys and repeated rows."""
    r = random.Random(4)
    clean = lambda marks: " ".join("".join(r.choice("aeioustrn") for _ in range(5)) + ("!" if r.random() < marks else "") for _ in range(60))
    groups = {("en", "a"): (300, 0.0), ("en", "b"): (99, 0.3), ("en", "c"): (1, 0.5), ("de", "a"): (20, 0.1), (None, None): (3, 0.2)}
    rows = [(i, clean(marks), lang, source, 0) for (lang, source), (n, marks) in groups.items() for i in range(n)]
    rows += rows[-2:]
    m = quality.measured(docs(spark, rows))
    name = lambda x: "-" if x is None else f"={x}"
    got = {(x["g_lang"], x["g_source"]): x["limits"]["marks"] for x in quality.thresholds(m, "quality_", Scratch(spark)).collect()}
    values = [(name(x["lang"]), name(x["source"]), min(x["quality_"]["marks"] * 1000 // x["quality_"]["n_words"], 1000)) for x in m.collect()]
    seen = sorted({v for *_, v in values})

    def share(keep, parent):
        own = [v for *g, v in values if keep(g)]
        k = quality.PARENT if parent else 0
        return {v: (sum(x <= v for x in own) + k * (parent[v] if parent else 0)) / (len(own) + k) for v in seen}

    top = share(lambda g: True, None)
    for lang, source in got:
        at = share(lambda g: g == [lang, source], share(lambda g: g[0] == lang, top))
        none = at[0]
        low, high, some = (min(v for v in seen if at[v] >= p - 1e-12) for p in (0.5, 0.99, none + (1 - none) * 0.75))
        assert got[lang, source] == low + 3 * (max(high, some) - low)
    assert len(got) == 5


def test_quality_limits_of_rare_ratios_come_from_those_that_have_them(spark):
    """Of 200 documents two have a line twice: no cutoff rejects them, and one with far more than they goes."""
    r = random.Random(6)
    clean = lambda: " ".join("".join(r.choice("aeioustrn") for _ in range(5)) for _ in range(80))
    twice = lambda lines, copies: "\n".join([clean() for _ in range(lines)] + ["next page"] * (copies + 1))
    rows = [(i, clean(), "en", "s", 0) for i in range(200)] + [(300, twice(18, 1), "en", "s", 0), (301, twice(18, 1), "en", "s", 0), (302, twice(18, 1), "en", "s", 0), (400, twice(2, 7), "en", "s", 0)]
    kept = {x["doc_id"] for x in quality.good_documents(docs(spark, rows), Scratch(spark)).collect()}
    assert kept == {*range(200), 300, 301, 302}


def test_quality_of_very_long_texts(spark):
    """Beyond PACKED_WORDS places are sorted beside whole hashes."""
    r = random.Random(8)
    words = [f"{r.randrange(3000)}" for _ in range(quality.PACKED_WORDS + 5000)]
    words[70_000:70_010] = words[10:20]
    text = " ".join(words)
    for n in (quality.PACKED_WORDS, len(words)):
        row = quality.measured(docs(spark, [(1, " ".join(words[:n]), "en", "s", 0)])).select("quality_.*").first()
        assert (row["n_words"], row["n_repeat_words"]) == (n, repeated(words[:n]))
    assert repeated(words) >= 10 and len(text) > 300_000


def test_chat_round_trips_hostile_texts(spark):
    bits = ["<|im_end|>", "<|im_start|>", "\n", "<\\|im_end|>", "<\\\\|im_start|>", "<", "|im_end|>", "assistant", "%0A", "%", "é", ""]
    r = random.Random(2)
    rows = [(c, t, r.choice(["user", "assistant", "sys\ntem", "a%0A", "<|im_end|>", None]), "".join(r.choice(bits) for _ in range(r.randint(0, 9)))) for c in range(40) for t in range(r.randint(1, 5))]
    rows += [(None, 0, "user", None), (None, None, "assistant", "x"), (77, 1, "assistant", "twice"), (77, 1, "assistant", "twice")]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("level", F.lit(1)).withColumn("n", F.lit(1))
    out = chat.formatted(d)
    out = out.withColumns({"turns": chat.parsed(F.col("formatted")), "loss": chat.loss_text(F.col("formatted"), F.col("loss_spans"))}).collect()
    by = {}
    for c, t, role, text in rows:
        by.setdefault(c, []).append((-1 if t is None else t, role or "", text or ""))
    assert len(out) == len(by)
    for row in out:
        want = [x[1:] for x in sorted(by[row["conv_id"]], key=lambda x: (x[0], x[1].encode(), x[2].encode()))]
        assert row["round_trip"] and [tuple(t) for t in row["turns"]] == want
        assert row["loss"] == "".join(t for role, t in want if role == "assistant")
        assert row["formatted"].count("<|im_end|>") == len(want)
    assert chat.formatted(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_parser_refuses_broken_text(spark):
    bad = ["", "x", "<|im_start|>user", "<|im_start|>user\nhi<|im_end|>", "<|im_start|>u<|im_end|>\n", "<|im_start|>user\na<|im_start|>b<|im_end|>\n"]
    rows = spark.createDataFrame([(b,) for b in bad], "t string").select(chat.parsed(F.col("t")).alias("p")).collect()
    assert [r["p"] for r in rows] == [None if b else None for b in bad] or all(r["p"] in (None, []) for r in rows)


def test_hash_matches_plain_md5(spark):
    row = mixing.measured(docs(spark, [(123, "a b", "en", "s", 3)])).select("m.*").first()
    assert row["cell"] >> 30 == int(hashlib.md5(b"123").hexdigest()[:8], 16) >> 2 and row["cell"] % (1 << 30) == int(hashlib.md5(b"a b").hexdigest()[:8], 16) >> 2 and row["size"] == 2
