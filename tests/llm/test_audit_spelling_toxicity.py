"""Filter audit, spelling variants and toxicity against brute force, and their edge cases."""

import re
import zlib
from itertools import permutations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import filteraudit, spelling, toxicity

DOCS = "doc_id long, text string, source string, DOC_ID_ string, n long"


def documents(spark, rows, slices=3):
    return spark.createDataFrame(spark.sparkContext.parallelize([(*r, "x", 1) for r in rows], slices), DOCS)


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int, text string")


LONG = " ".join(f"w{i}" for i in range(60))
AUDITED = [
    (5, LONG, "a"), (5, LONG, "a"), (3, LONG, "b"), (9, LONG + " #", None), (None, LONG, "a"), (None, None, None), (1, None, ""), (2, "", "a"),
    (7, "A B C", "b"), (7, "other", "b"), (8, "one " * 70, "b"), (4, "one " * 70, "a"), (11, "ä" * 300_000 + "$", "a"), (12, "A" * 50_000, "c"), (13, LONG, "a"),
]
JUDGED = [(5, 1, 0, None), (5, 0, 1, None), (8, 1, None, None), (13, None, 1, None), (None, 1, 1, None), (99, 1, 1, None)]


def masks(rows):
    out = []
    for doc_id, text, source in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        m = {"A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text), "D": bool(re.search("[#$%&*|]", text))}
        m["E"] = doc_id is not None and any(i is not None and i < doc_id and (t or "") == text for i, t, _ in rows)
        out.append((doc_id, source or "", m))
    return out


def test_audit_is_brute_force(spark):
    got = {tuple(r[:3]): tuple(r[3:]) for r in filteraudit.audit(documents(spark, AUDITED), labels(spark, JUDGED)).collect()}
    want, found = {}, masks(AUDITED)
    good = {i for i, q, _, _ in JUDGED if q == 1 and i}
    toxic = {i for i, _, t, _ in JUDGED if t == 1 and i}
    for part in {p for _, p, _ in found}:
        own, shapley = [(i, m) for i, p, m in found if p == part], dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                removed = [(i, m) for i, m in left if m[f]]
                left = [(i, m) for i, m in left if not m[f]]
                shapley[f] += len(removed)
                redundant = sum(m[f] for _, m in own) - len(removed)
                unique = sum(m[f] and sum(m.values()) == 1 for _, m in own)
                want[part, "".join(order), step] = [len(left), len(removed), redundant, unique, sum(i in good for i, _ in removed), sum(i in toxic for i, _ in removed), f]
        for order in permutations("ABCDE"):
            for step in range(1, 6):
                row = want[part, "".join(order), step]
                row[-1] = shapley[row[-1]]
    assert got == {k: tuple(v) for k, v in want.items()}


def test_duplicates_across_blocks_and_tasks(spark, monkeypatch):
    monkeypatch.setattr(filteraudit, "BLOCK", 400)
    rows = [(i % 40, f"text {i % 7} " * 10, f"s{i % 3}") for i in range(300)]
    records = [list(filteraudit.dealt(rows[k::4], k)) for k in range(4)]
    assert all(len(text or "") < 400 and len(settled) <= 2001 for part in records for _, (text, _, _, settled) in part)
    merged = list(filteraudit.told([r for part in records for r in part]))
    want = {}
    for doc_id, source, m in masks(rows):
        key = doc_id, source, m["E"]
        want[key] = want.get(key, 0) + 1
    got = {}
    for doc_id, source, mask, n in merged:
        key = doc_id, source, mask >= 16
        got[key] = got.get(key, 0) + n
    assert got == want
    assert {r["doc_id"] for r in filteraudit.duplicates(documents(spark, rows)).collect()} == {k[0] for k in want if k[2]}


def test_one_fingerprint_many_texts(monkeypatch):
    monkeypatch.setattr(filteraudit.xxhash, "xxh64_intdigest", lambda raw: 1)
    rows = [(i, f"text {i % 5}", "s") for i in range(20)]
    got = list(filteraudit.told(filteraudit.dealt(rows, 0)))
    assert sorted(i for i, _, mask, _ in got if mask < 16) == [0, 1, 2, 3, 4] and sum(n for *_, n in got) == 20


def test_audit_of_nothing(spark):
    assert filteraudit.audit(documents(spark, []), labels(spark, JUDGED)).count() == 0
    assert filteraudit.audit(documents(spark, AUDITED), labels(spark, [])).where("good_lost + toxic_lost > 0").count() == 0


def one_edit(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_forms(counts: dict[str, int]) -> dict[str, tuple]:
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    form = {}
    for w, own in near.items():
        best = min(own, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best and counts[best] >= 10 * counts[w] else None
    out = {}
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        out[w] = form[w], root, counts[w], len(near[w]), counts.get(form[w])
    return out


def vocabulary_of(rng, n):
    letters = np.array(list("abcé"))
    words = {"".join(rng.choice(letters, rng.integers(7, 10))) for _ in range(n)}
    words |= {"a" * k for k in range(7, 40)} | {"aaaaaab" * 4, "x" * 20_000, "x" * 20_001, "x" * 10_000 + "y" + "x" * 10_000, "×÷ÀÿÞ×÷À"}
    return {w: int(3 ** rng.integers(1, 9)) for w in words}


@pytest.mark.parametrize("seed", [1, 2])
def test_forms_are_brute_force(spark, seed):
    counts = vocabulary_of(np.random.default_rng(seed), 600)
    vocab = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in spelling.grouped(vocab).collect()}
    assert got == brute_forms(counts)


def test_colliding_keys_are_told_apart(monkeypatch):
    plain = spelling.deletion_keys
    monkeypatch.setattr(spelling, "deletion_keys", lambda words: (plain(words)[0] & np.uint64(3), plain(words)[1]))
    counts = {w: n for w, n in vocabulary_of(np.random.default_rng(3), 80).items() if len(w) < 1000}
    found = dict.fromkeys(counts, (0, None))
    for row in spelling.packed(list(counts), np.array(list(counts.values())), 1):
        r = row.to_pylist()[0]
        arrays = [np.frombuffer(r[c], t) for c, t in (("keys", np.uint64), ("places", np.int32), ("owners", np.int32))]
        for w, _, near, best in spelling.met(*arrays, r["words"].split("\n"), np.frombuffer(r["counts"], np.int64)):
            have = found[w]
            found[w] = have[0] + near, min((b for b in (have[1], best) if b), default=None)
    for w, (form, _, n, n_near, _) in brute_forms(counts).items():
        assert found[w][0] == n_near and (form is None or found[w][1] == (-counts[form], form)), w


def test_chain_of_forms(spark):
    chain = ["aaaaaaa", "aaaaaab", "aaaaabb", "aaaabbb", "aaabbbb", "aabbbbb"]
    vocab = spark.createDataFrame([(w, 2 * 10**i) for i, w in enumerate(chain)], "word string, n long")
    got = {r["word"]: r["root"] for r in spelling.grouped(vocab).collect()}
    assert got == dict.fromkeys(chain, chain[-1])


def spelled(rows):
    counts = {}
    for doc_id, text, _ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            if h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= 7:
                counts[w] = counts.get(w, 0) + 1
    return {w: n for w, n in counts.items() if n >= 2}


def test_vocabulary_of_damaged_words(spark, monkeypatch):
    monkeypatch.setattr(spelling, "BLOCK_WORDS", 5)
    rows = [(i, f"Question questioN Éclairée Éclairée {'variant' * (i % 3)} x{i}", None) for i in range(200)]
    rows += [(None, "Question nothing-else", None), (None, None, None), (7, "", None), (7, "nothing", None), (8, "z" * 100_000, None), (9, "z" * 100_000, None)]
    got = {r["word"]: r["n"] for r in spelling.vocabulary(documents(spark, rows), spelling.one_of_31).collect()}
    assert got == spelled(rows) and any(w not in ("question", "Éclairée") and len(w) == 7 for w in got)


def test_spelling_of_nothing(spark):
    assert spelling.grouped(spelling.vocabulary(documents(spark, []))).count() == 0
    assert spelling.grouped(spelling.vocabulary(documents(spark, [(1, None, None)]))).count() == 0


BAD = ["idiot", "moron", "stupid", "disgusting"]


def corpus(seed=5, n=800):
    """Documents of plain words, of which a quarter have a word that makes them toxic."""
    rng = np.random.default_rng(seed)
    plain = ["walking", "river", "the", "is", "answer", "garden", "morning", "on", "so", "letters", "house", "winter"]
    rows, marks = [], []
    for i in range(n):
        words = list(rng.choice(plain, rng.integers(5, 40)))
        if i % 4 == 0:
            words.insert(int(rng.integers(len(words))), str(rng.choice(BAD)))
        rows.append((i, " ".join(words), None))
        marks.append((i, 1, int(i % 4 == 0), None))
    return rows, marks


@pytest.fixture(scope="module")
def toxic_model(spark):
    rows, marks = corpus()
    return toxicity.trained(documents(spark, rows), labels(spark, marks), per_label=400)


def test_toxicity_of_held_out_rows(spark, toxic_model):
    rows, marks = corpus()
    out = toxicity.scored(documents(spark, rows), toxic_model).where(toxicity.held_out(F.col("doc_id"))).select("doc_id", "score").collect()
    wrong = [r for r in out if (r["score"] >= 0.5) != (r["doc_id"] % 4 == 0)]
    assert len(out) > 100 and not wrong


def test_disguises_are_restored(spark, toxic_model):
    restorer = toxicity.Restorer(toxic_model["costs"])
    said = ["the 1d10t is", "an i d i o t", "M0R0N!", "m-o-r-o-n", "idiiiiiot", "$tupid", "5tup1d", "d.i.s.g.u.s.t.i.n.g", "sttttupid", "s t u p 1 d", "di$gusting"]
    for text in said:
        assert restorer.words(text) & set(BAD), (text, restorer.text(text))
    for text in ["The river is on the house", "a$$$ of%%% river&&&", "walking, the garden... morning!!", "2023 and 1999", "WINTER!! HOUSE!!"]:
        assert restorer.text(text) == text.lower()
    rows = [(i, f"walking in the garden {t} so letters", None) for i, t in enumerate(said)]
    assert all(r["score"] >= 0.5 for r in toxicity.scored(documents(spark, rows), toxic_model).collect())


def test_viterbi_takes_the_cheapest_path(toxic_model):
    """All readings of short spans, costed one by one."""
    costs = toxic_model["costs"]
    restorer = toxicity.Restorer(costs)

    def price(read, extra):
        state = 0
        for ch in read + " ":
            s = toxicity.symbol(ch)
            extra += costs[state * 28 + s]
            state = state % 28 * 28 + s
        return extra

    for span, joints in [("1d10t", False), ("mooo0n", False), ("i d 1 o", True), ("5t-u", True), ("sc*m", False)]:
        readings, before, times = [("", 0.0)], "", 0
        for ch in span:
            apart = joints and not (ch.isalnum() or ch in "@$!")
            if not apart:
                before, times = ch, times + 1 if ch == before else 1
            readings = [(r + out, c + extra) for r, c in readings for out, extra in restorer.choices(ch, times, apart)]
        best = min(price(r, c) for r, c in readings)
        assert abs(min(price(r, c) for r, c in readings if r == restorer.decoded(span, joints)) - best) < 1e-9


def test_toxicity_edges(spark, toxic_model):
    rows = [(None, "idiot", None), (1, None, None), (2, "", None), (2, "idiot", None), (2, "idiot", None), (3, "a1" * 100_000, None), (4, "i " * 100_000, None), (5, "…!?" * 9, None), (6, "a" * 100_000, None)]
    docs = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, source string, SCORE double")
    out = toxicity.scored(docs, toxic_model)
    assert out.columns == ["doc_id", "text", "source", "SCORE", "score_"]
    got = [(r["text"], r["score_"]) for r in out.collect()]
    assert len(got) == len(rows) and all(0 <= s <= 1 for _, s in got)
    assert len({s for t, s in got if t == "idiot"}) == 1 and len({s for t, s in got if not t}) == 1
    assert min(s for t, s in got if t == "idiot") > 0.5 > max(s for t, s in got if not t)


def test_toxicity_without_labels(spark):
    rows, marks = corpus(n=40)
    docs = documents(spark, rows)
    for given in ([], [(i, q, 0, t) for i, q, _, t in marks], [(i, q, None, t) for i, q, _, t in marks]):
        assert {r["score"] for r in toxicity.scored(docs, toxicity.trained(docs, labels(spark, given))).collect()} == {0.0}
    empty = documents(spark, [])
    assert toxicity.scored(empty, toxicity.trained(empty, labels(spark, marks))).count() == 0


def test_letter_counts_are_whole(spark):
    rows = [(1, "Ab é", None), (2, None, None), (3, "abc" * 900_000, None)]
    counts = toxicity.letter_counts(documents(spark, rows))
    assert counts.sum() == sum(len((t or "").encode()) + 1 for _, t, _ in rows) and counts[1, 2, 3] == 900_000 and counts[0, 0, 1] == 2


def test_sql_of_crc(spark):
    """The SQL's linear CRC-32 is the library's."""
    rows = [(i, f"Question éclairée{i} {'abcdefg' * (i % 5)}", None, None, 1) for i in range(300)] + [(None, "question nothing", None, None, 1)]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [r[:2] for r in rows])
    got = {r[0]: r[1:] for r in con.execute(spelling.OP12_SQL).fetchall()}
    want = brute_forms(spelled([r[:3] for r in rows]))
    assert got == want
