"""Packing, language identification, token counts and fingerprints on small tables."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import langid, lzprint, packing, tokencount

TEXTS = ["", None, "One two.", "it's 12 o'clock!! ÉTÉ été", "ΟΔΟΣ οδος", "<|endoftext|>", "a b\x0bc", "word " * 5000, "x", "x", "日本語 テキスト", "İstanbul", "éa"]


@pytest.fixture(scope="module")
def path():
    return packing.tokenizer_path()


def test_ids_are_the_tokenizers(path):
    ids = packing.WordIds(path)
    r = random.Random(1)
    texts = [t or "" for t in TEXTS] + ["".join(r.choice("abcé'.,!1Σς \ńſ%") for _ in range(r.randint(0, 40))) for _ in range(2000)]
    for t, e in zip(texts, ids.tokenizer.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(ids.of(t), "<u4").tolist() == e.ids, repr(t)


def test_ids_of_very_long_words(path):
    ids, r = packing.WordIds(path), random.Random(4)
    for w in ("".join(r.choice("abcdefgh") for _ in range(1_000_000)), "語の" * 100_000, "a" * packing.LONG_WORD + ",", "b" * (packing.LONG_WORD + 1)):
        assert np.frombuffer(ids.of(w), "<u4").tolist() == ids.tokenizer.encode(w, add_special_tokens=False).ids


def test_words_stay_right_in_a_full_cache(path, monkeypatch):
    monkeypatch.setattr(packing, "CACHE_WORDS", 5)
    ids, r = packing.WordIds(path), random.Random(5)
    for _ in range(200):
        t = " ".join(r.choice("one two, three four. five-six seven Eight! nine ten eleven".split()) for _ in range(12))
        assert np.frombuffer(ids.of(t), "<u4").tolist() == ids.tokenizer.encode(t, add_special_tokens=False).ids


def test_packing_is_whole_and_tight(spark, path):
    r = random.Random(2)
    rows = [(i, " ".join(r.choice("alpha beta gamma".split()) for _ in range(r.randint(1, 900)))) for i in range(300)] + [(1000 + i, t) for i, t in enumerate(TEXTS)] + [(None, "no id"), (1, "same id")]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("offset", F.lit(1)).repartition(3)
    got = [x.asDict() for x in packing.packed(d, path, 512).collect()]
    ids = packing.WordIds(path)
    want = sorted((-1 if i is None else i, len(ids.of(t or "")) // 4 + 1) for i, t in rows)
    by_doc, by_seq = {}, {}
    for x in got:
        by_doc.setdefault((x["doc_id"], x["doc_tokens"]), []).append(x)
        by_seq.setdefault(x["sequence_id"], []).append(x)
    assert sum(x["length"] for x in got) == sum(n for _, n in want)
    padding = 0
    for s in by_seq.values():
        at = 0
        for x in sorted(s, key=lambda x: x["offset"]):
            assert x["offset"] == at
            at += x["length"]
        assert at <= 512
        padding += 0 if at & (at - 1) == 0 else 512 - at
    assert padding == 0
    text = {i: t for i, t in rows if i is not None and i != 1}
    for (i, n), cs in by_doc.items():
        if i in text:
            raw, at = ids.of(text[i] or "") + b"\x01\0\0\0", 0
            for x in sorted(cs, key=lambda x: x["start"]):
                assert x["start"] == at and x["ids_crc32"] == zlib.crc32(raw[4 * at : 4 * (at + x["length"])])
                at += x["length"]
            assert at == n == len(raw) // 4
    assert packing.packed(d.limit(0), path).count() == 0


def test_sum_of_squares_choice():
    r = random.Random(3)
    p = packing.Packer(32)
    for i in range(500):
        n = r.randint(1, 31)
        before, levels = p.level(n), p.levels.copy()

        def cost(h, levels=levels, n=n):
            after = levels.copy()
            if h:
                after[h] -= 1
            if h + n < 32:
                after[h + n] += 1
            return int((after[1:] ** 2).sum())

        usable = [0, *(h for h in range(1, 33 - n) if levels[h])]
        assert cost(before) == min(map(cost, usable))
        p.add(i, n)


def test_language_held_out(spark):
    r = random.Random(1)
    vocab = {"aa": "bal dor min sel", "bb": "xuq zyx wov kyq", "cc": "éta ñuo àni öre"}
    rows = [(i, " ".join(r.choice(vocab[v].split()) for _ in range(30)), v) for i, v in enumerate(r.choices(list(vocab), k=300))]
    rows += [(900, None, "aa"), (901, "", "aa"), (902, "12 !?", None), (None, "bal dor", None), (903, "bal dor min " * 40_000, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("language", F.lit(0))
    out = langid.predicted(d, langid.trained(d)).select("doc_id", "lang", "text", "language_.*", langid.held_out().alias("held")).collect()
    for x in out:
        assert x["held"] == (zlib.crc32(str(x["doc_id"]).encode() if x["doc_id"] is not None else b"") % 3 == 1)
        assert 0 <= x["score"] <= 1
        if x["doc_id"] is not None and x["doc_id"] < 900:
            assert x["lang_pred"] == x["lang"]
    assert {x["doc_id"]: x["lang_pred"] for x in out if x["doc_id"] in (900, 901, 902, 903)} == {900: "und", 901: "und", 902: "und", 903: "aa"}
    kept = langid.spoken_documents(d)
    assert kept.columns == d.columns and kept.where("lang is null").count() == 0
    bare = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert [tuple(x) for x in langid.predicted(bare, langid.trained(bare)).select("language.*").collect()] == [("und", 0.0, True)]


def plain_prediction(model, text):
    """Language and score by loops over 3-grams, bits and languages."""
    raw = [b if b >= 128 or 97 <= b <= 122 else 32 for b in f" {text.lower()} ".encode()]
    counts = {}
    for at in range(len(raw) - 2):
        code = raw[at] * 65536 + raw[at + 1] * 256 + raw[at + 2]
        slot = (code * langid.MULTIPLIER % 2**32) >> 19
        if slot != ((0x202020 * langid.MULTIPLIER) % 2**32) >> 19:
            counts[slot] = counts.get(slot, 0) + 1
    total, losses = max(1, sum(counts.values())), []
    margins = [float(model["b"][k]) + sum((n / total) ** 0.5 * float(model["w"][s, k]) for s, n in counts.items()) for k in range(len(model["b"]))]
    for word in model["code"]:
        losses.append(sum(math.log1p(math.exp(-float(c) * z)) for c, z in zip(word, margins, strict=True)))
    best = min(range(len(losses)), key=losses.__getitem__)
    return model["names"][best], 1 / sum(math.exp(losses[best] - v) for v in losses)


@pytest.mark.parametrize("languages", [1, 2, 4, 9])
def test_predictions_match_plain_loops(spark, languages):
    r = random.Random(languages)
    syllables = ["ba", "né", "ko", "ri", "zu", "ta", "vø", "li", "sä", "mo", "pe", "du"]
    vocab = [["".join(r.choice(syllables) for _ in range(3)) for _ in range(15)] for _ in range(languages)]
    text = lambda v: " ".join(r.choice(vocab[v]) for _ in range(r.randint(1, 40)))
    rows = [(i, text(i % languages), f"l{i % languages}") for i in range(60 * languages)] + [(None, text(0), "l0"), (7, text(0), "l0"), (7, "A1 b2\tÉ!!", None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.trained(d)
    assert model["names"] == sorted({v for _, _, v in rows if v})
    for x in langid.predicted(d, model).select("text", "language.*").collect():
        name, score = plain_prediction(model, x["text"])
        assert x["lang_pred"] == name and abs(x["score"] - score) < 1e-4 and (x["ambiguous"] == (x["score"] < langid.AMBIGUOUS))


def test_held_out_accuracy_on_documents(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    out = langid.op7_language(spark, "/root/testdata/sf0.01").join(d, "doc_id").where("held_out and lang is not null and length(text) >= 200").select("lang", "lang_pred").collect()
    assert len(out) > 50 and sum(x["lang"] == x["lang_pred"] for x in out) >= 0.95 * len(out)


def test_language_of_odd_tables(spark):
    d = spark.createDataFrame([(1, "abc abc", "aa"), (1, "abc abc", "aa"), (3, "xyz xyz", "bb"), (5, "xyz xyz", "bb"), (6, "xyz xyz", "bb")], "doc_id long, text string, lang string")
    empty = d.limit(0)
    assert langid.trained(empty) is None and langid.predicted(empty, None).count() == 0 and langid.spoken_documents(empty).count() == 0
    out = langid.predicted(d, langid.trained(d)).select("doc_id", "language.*").collect()
    assert len(out) == 5 and len({tuple(x) for x in out if x["doc_id"] == 1}) == 1


def test_long_texts_are_learned_from(spark):
    r = random.Random(2)
    vocab = {"aa": "bal dor min sel", "bb": "xuq zyx wov kyq"}
    text = lambda v, n: " ".join(r.choice(vocab[v].split()) for _ in range(n))
    rows = [(i, text("aa", 30), "aa") for i in range(60)] + [(100 + i, " \n" * 15_000 + text("bb", 8_000) + "\n", "bb") for i in range(12)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for part in (d, d.where("lang = 'bb'")):
        out = langid.predicted(part, langid.trained(part)).select("lang", "language.lang_pred").collect()
        assert all(x["lang_pred"] == x["lang"] for x in out)


def test_codewords_are_apart():
    for n in (1, 2, 3, 4, 6, 9, 20):
        m = langid.codewords(n)
        assert m.shape[0] == n and all((m[i] != m[j]).sum() >= (n > 2) + 1 for i in range(n) for j in range(i))


def viterbi(word, pieces):
    best = [(0.0, 0)]
    for end in range(1, len(word) + 1):
        options = [(best[end - 1][0] + tokencount.UNKNOWN, -(best[end - 1][1] + len(word[end - 1].encode())))]
        options += [(best[s][0] + pieces[word[s:end]], -(best[s][1] + 1)) for s in range(end) if word[s:end] in pieces]
        top = max(options)
        best.append((top[0], -top[1]))
    return best[-1][1]


def test_token_counts_match_brute_force(spark):
    voc = packing.tokenizer_path("piece_bpe_32k.model")
    pieces = tokencount.scores(voc)
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "null id here")]
    out = tokencount.counted(spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_tokens", F.lit(0)), voc).collect()
    assert len(out) == len(rows)
    for x in out:
        text = dict(rows)[x["doc_id"]] or ""
        words = tokencount.WORD.findall(text)
        assert (x["n_pretokens"], x["n_tokens"]) == (len(words), sum(viterbi(tokencount.MARK + w, pieces) for w in words))


def test_very_long_words_are_scored_outside_the_trie(monkeypatch):
    pieces = tokencount.scores(packing.tokenizer_path("piece_bpe_32k.model"))
    r = random.Random(7)
    words = {tokencount.MARK + "".join(r.choice("abeinrst語") for _ in range(n)) for n in (1, 5, 40, 999, 1000, 1001, 3000)}
    want = {w: viterbi(w, pieces) for w in words}
    assert tokencount.Trie(pieces).counts(words) == want
    monkeypatch.setattr(tokencount, "LONG_WORD", 3)
    monkeypatch.setattr(tokencount, "CACHE_WORDS", 2)
    trie = tokencount.Trie(pieces)
    assert [trie.counts({w}) for w in sorted(words) * 2] == [{w: want[w]} for w in sorted(words) * 2]
    assert trie.rolled("ab" * 200_000) > 0


def test_token_counts_of_odd_tables(spark):
    voc = packing.tokenizer_path("piece_bpe_32k.model")
    d = spark.createDataFrame([(1, "the same"), (1, "the same"), (None, "the same"), (2, None)], "doc_id long, text string")
    assert sorted((x["n_pretokens"], x["n_tokens"] > 0) for x in tokencount.counted(d, voc).collect()) == [(0, False), (2, True), (2, True), (2, True)]
    assert tokencount.counted(d.limit(0), voc).count() == 0


def phrase_hashes(text):
    """Mixed hashes of the phrases of an LZ78 parse that keeps strings."""
    phrases, now = set(), ""
    for c in text:
        now += c
        if now not in phrases:
            phrases.add(now)
            now = ""
    out = set()
    for p in phrases:
        x = sum((ord(c) + 1) * pow(lzprint.BASE, len(p) - 1 - i, lzprint.PRIME) for i, c in enumerate(p)) % lzprint.PRIME
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> shift)) * factor % 2**64
        out.add(x ^ (x >> 31))
    return out


def test_parse_and_likeness_match_sets_of_strings(spark):
    r = random.Random(8)
    texts = ["", "a", "aaaaaaa", "abababab", "日本語日本語", "x\x00y\x00"] + ["".join(r.choice("ab cé") for _ in range(r.choice((5, 60, 400, 3000)))) for _ in range(40)]
    rows = [(len(texts) - i, t) for i, t in enumerate(texts)]
    out = {x["doc_id"]: x for x in lzprint.fingerprinted(spark.createDataFrame(rows, "doc_id long, text string"), 3).collect()}
    shown = lambda s: "".join(f"{x:016x}" for x in sorted(s)[: lzprint.BOTTOM])

    def alike(a, b):
        least = sorted(a | b)[: lzprint.BOTTOM]
        return sum(x in a and x in b for x in least) / len(least) if least else 1.0

    for (i, t), after in zip(rows, texts[1:] + texts[:1], strict=True):
        k = len(t) // 3
        own, edited, other = map(phrase_hashes, (t, t[: len(t) - k] + after[:k], after))
        assert (out[i]["fingerprint"], out[i]["edited_fingerprint"]) == (shown(own), shown(edited))
        assert abs(out[i]["near_edited"] - alike(own, edited)) < 1e-12 and abs(out[i]["near_next"] - alike(own, other)) < 1e-12


def test_tasks_follow_the_bytes(spark, monkeypatch):
    d = spark.createDataFrame([(i % 90, "some words " * (i % 7)) for i in range(200)], "doc_id long, text string")
    want = sorted(map(tuple, lzprint.fingerprinted(d, 1).collect()))
    monkeypatch.setattr(lzprint, "RANGE_BYTES", 200)
    many = lzprint.fingerprinted(d)
    assert many.rdd.getNumPartitions() > 20 and sorted(map(tuple, many.collect())) == want


def test_fingerprints_match_brute_force(spark):
    r = random.Random(6)
    rows = [(3 * i, "".join(r.choice("abcd é") for _ in range(r.randint(0, 300)))) for i in range(70)] + [(1, None), (2, ""), (4, "x" * 50_000), (5, "dup"), (7, "dup")]
    for buckets in (1, 3, 16):
        d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("part", F.lit(1)).withColumn("key", F.lit(1)).repartition(4)
        out = {x["doc_id"]: x for x in lzprint.fingerprinted(d, buckets).collect()}
        order = sorted(rows, key=lambda x: -x[0])
        assert len(out) == len(rows)
        for (i, t), (_, after) in zip(order, order[1:] + order[:1], strict=True):
            t, after, x = t or "", after or "", out[i]
            k = len(t) // 3
            edited = t[: len(t) - k] + after[:k]
            mine, theirs, other = map(lzprint.fingerprint, (t, edited, after))
            assert x["n_chars"] == len(t) and x["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
            assert (x["fingerprint"], x["edited_fingerprint"]) == (lzprint.encoded(mine), lzprint.encoded(theirs))
            assert (x["near_edited"], x["near_next"]) == (lzprint.likeness(mine, theirs), lzprint.likeness(mine, other))
    assert out[5]["fingerprint"] == out[7]["fingerprint"]


def test_fingerprints_of_odd_tables(spark):
    schema = "doc_id long, text string"
    assert lzprint.fingerprinted(spark.createDataFrame([], schema), 4).count() == 0
    one = lzprint.fingerprinted(spark.createDataFrame([(1, "abcabc")], schema), 4).first()
    assert one["near_next"] == 1.0
    same = lzprint.fingerprinted(spark.createDataFrame([(1, "a"), (1, "b"), (None, "c"), (None, "d")], schema), 4).collect()
    assert len(same) == 4
    a, b = lzprint.fingerprint("the cat sat on the mat " * 20), lzprint.fingerprint("the cat sat on the mat " * 19 + "and slept")
    assert lzprint.likeness(a, b) > lzprint.likeness(a, lzprint.fingerprint("zyxw " * 90)) == 0.0


def test_language_of_rows_without_ids(spark):
    """A language whose labelled rows have no ids, or one id, is drawn from by text."""
    r = random.Random(8)
    say = lambda words: " ".join(r.choice(words) for _ in range(6))
    rows = [(None, say("haus baum und der die".split()), "de", "s", 0) for _ in range(3000)] + [(7, say("house tree and the of".split()), "en", "s", 0) for _ in range(3000)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    model = langid.trained(d, per_lang=50)
    assert model["names"] == ["de", "en"]
    assert {(x["lang"], x["lang_pred"]) for x in langid.predicted(d, model).select("lang", "language.lang_pred").distinct().collect()} == {("de", "de"), ("en", "en")}


def test_words_of_letters_skip_the_tokenizers_text_path(path):
    """The library's way from texts to ids, offsets and all, was most of the packing's time."""
    ids, texts = packing.WordIds(path), ["Plain words, and MORE words. été über ñandú!", "été, über; łódź straße words%%% 12 o'clock", "日本語 テキスト οδος ﬁn éa ẞ ǅ"]
    texts += [" ".join(f"{a}{b}{c}" for c in ("x", "é", "ß")) for a in "abcdeéü" for b in "fghñ"]
    want = [e.ids for e in ids.tokenizer.encode_batch(texts, add_special_tokens=False)]
    calls, real = [], ids.tokenizer
    ids.tokenizer = type("Counted", (), {"encode": lambda self, w, **k: calls.append(w) or real.encode(w, **k)})()
    assert [np.frombuffer(ids.of(t), "<u4").tolist() for t in texts] == want
    assert calls and not any(" " in w or packing.plain(w) for w in calls)
