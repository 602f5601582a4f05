"""Held-out text search, token mixtures and truncation against brute force and known answers."""

from __future__ import annotations

import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from tickloom.llm import leakage, mixing, nearest, queries, truncation
from tickloom.session import data_dir

VOCABULARY = [w + s for w in ("amber", "cobalt", "ledger", "fold", "quote", "bell", "vault", "spread", "clerk", "fix") for s in ("", "s", "ed", "ing")]


def prose(rng, n):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


# --- nearest time


def test_nearest_against_brute_force(spark):
    rng = random.Random(3)
    left = [("l", str(i), rng.choice("ab"), rng.randrange(0, 4_000), 40) for i in range(300)] + [("l", "n1", None, 5, 40), ("l", "n2", "a", None, 40)]
    right = [(rng.choice("ab"), rng.randrange(0, 4_000) // 3 * 3, i) for i in range(200)] + [(None, 4, 900), ("a", None, 901)]
    ls = spark.createDataFrame(left, "left_table string, left_key string, entity string, t long, tol long").withColumn("block", F.lit(1))
    rs = spark.createDataFrame(right, "entity string, t long, rid long")
    want = set()
    for _, key, e, t, tol in left:
        near = [(abs(t - rt), rid) for re, rt, rid in right if e and t is not None and re == e and rt is not None and abs(t - rt) <= tol]
        if near:
            want.add((key, min(near)[1]))
    for kw in ({}, {"broadcast_keys": 0}):
        got = nearest.nearest_by_time(ls, rs, block_us=500, **kw)
        assert {(r["left_key"], r["rid"]) for r in got.collect()} == want


def test_nearest_over_many_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        test_nearest_against_brute_force(spark)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_nearest_of_nothing(spark):
    ls = spark.createDataFrame([], "left_table string, left_key string, entity string, t long, tol long")
    rs = spark.createDataFrame([], "entity string, t long, rid long")
    assert nearest.nearest_by_time(ls, rs).count() == 0


# --- leaks


def slow_words(text):
    """Words one character at a time: a second way to the folding."""
    out, word, i = [], "", 0
    text = unicodedata.normalize("NFKC", "".join(c for c in text if c not in leakage.INVISIBLE)).casefold()
    while i < len(text):
        c = text[i]
        if c.isalnum():
            word += c
        elif c == "-" and word and (m := re.match(r"-[ \t]*\r?\n\s*(?=\w)", text[i:])):
            i += m.end() - 1
        elif word:
            out.append(word)
            word = ""
        i += 1
    return [*out, word] if word else out


def brute(docs, items, n=13):
    runs = {}
    for i, t in items:
        w = slow_words(t or "")
        for k in range(len(w) - n + 1):
            runs.setdefault(tuple(w[k : k + n]), set()).add(i)
    found = set()
    for d, t in docs:
        w = slow_words(t or "")
        for k in range(len(w) - n + 1):
            found |= {(d, i) for i in runs.get(tuple(w[k : k + n]), ())}
    return found


def spoil(rng, words):
    out = []
    for w in words:
        kind = rng.randrange(6)
        if kind == 0:
            w = w.upper()
        elif kind == 1 and len(w) > 3:
            w = w[:2] + "-\n" + w[2:]
        elif kind == 2:
            w = w[:1] + "­" + w[1:]
        elif kind == 3:
            w = w + rng.choice([",", ".", " —", "​", "!\n"])
        out.append(w)
    return " ".join(out)


def test_leaks_against_brute_force(spark):
    rng = random.Random(7)
    items = [(i, prose(rng, rng.randrange(5, 40))) for i in range(30)] + [(90, None), (91, ""), (92, items_twice := prose(rng, 20)), (93, items_twice)]
    docs = []
    for d in range(150):
        body = prose(rng, 30)
        if rng.random() < 0.6:
            words = (rng.choice(items)[1] or "x").split()
            k = rng.randrange(len(words)) if len(words) > 1 else 0
            body += " " + spoil(rng, words[k : k + rng.randrange(8, 20)]) + " " + prose(rng, 5)
        docs.append((d, body))
    docs += [(900, None), (901, ""), (902, "word " * 100_000), (0, docs[0][1])]
    df = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id long, text string, item_id string")
    it = spark.createDataFrame([(i, t, 5) for i, t in items], "item_id long, text string, doc_id int")
    want = brute(docs, items)
    assert len(want) > 20
    for kw in ({}, {"block_items": 7}):
        assert {(r["doc_id"], r["item_id"]) for r in leakage.leaks(df, it, **kw).collect()} == want
    assert leakage.leaks(df.where("false"), it).count() == 0 and leakage.leaks(df, it.where("false")).count() == 0


def readings(text):
    """All readings of a text whose line-end hyphens each may be dropped or part words."""
    parts = re.split(r"(?<=\w)-\n(?=\w)", text)
    out = [parts[0]]
    for p in parts[1:]:
        out = [a + g + p for a in out for g in ("", " ")]
    return [slow_words(t) for t in out]


def test_each_hyphen_is_read_both_ways(spark):
    rng = random.Random(12)
    words = [f"w{chr(97 + i)}" for i in range(8)] + ["well", "known", "cobalt", "cob", "alt", "wellknown"]
    items = [(i, " ".join(rng.choice(words) for _ in range(18))) for i in range(8)] + [(50, "one two cobalt three well known four five six seven eight nine ten")]
    docs = []
    for d in range(120):
        w = rng.choice(items)[1].split()
        k = rng.randrange(len(w) - 8)
        text = " ".join(w[k:])
        text = re.sub("cobalt", lambda m: rng.choice(["cob-\nalt", "cobalt"]), text)
        text = re.sub("well known", lambda m: rng.choice(["well-\nknown", "well known"]), text)
        docs.append((d, " ".join(rng.choice(words) for _ in range(4)) + " " + text))
    docs.append((999, "one two cob-\nalt three well-\nknown four five six seven eight nine ten"))
    runs = {}
    for i, t in items:
        w = t.split()
        for k in range(len(w) - 12):
            runs.setdefault(tuple(w[k : k + 13]), set()).add(i)
    want = {(d, i) for d, t in docs for w in readings(t) for k in range(len(w) - 12) for i in runs.get(tuple(w[k : k + 13]), ())}
    df, it = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for kw in ({}, {"block_items": 2, "chunk_chars": 500}):
        assert {(r["doc_id"], r["item_id"]) for r in leakage.leaks(df, it, **kw).collect()} == want and (999, 50) in want


def test_offsets_point_into_the_original(spark):
    words = [f"w{i}" for i in range(20)]
    text = "Intro:\n" + " ".join(words[:5]) + " w­5, W-\n6 " + " ".join(words[7:]) + " and more"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    r = leakage.leaks(docs, spark.createDataFrame([(3, " ".join(words))], "item_id long, text string")).first()
    assert r["words"] == 20 and text[r["first_char"] : r["last_char"]].startswith("w0 w1") and text[r["first_char"] : r["last_char"]].endswith("w19")


# --- mixture


@pytest.fixture
def sized(spark):
    rows = [(i, s, t) for s, n, t in (("big", 4000, 10), ("mid", 600, 20), ("tiny", 30, 15), ("other", 50, 9)) for i, t in ((hash_id, t) for hash_id in range({"big": 0, "mid": 10_000, "tiny": 20_000, "other": 30_000}[s], {"big": 0, "mid": 10_000, "tiny": 20_000, "other": 30_000}[s] + n))]
    return spark.createDataFrame(rows, "doc_id long, source string, tokens long")


TARGETS = [("big", 0.5, 2), ("mid", 0.3, 2), ("tiny", 0.1, 4), ("absent", 0.1, 9), (None, 0.5, 1), ("mid", 0.4, 9)]


def test_shares_meet_their_targets(spark, sized):
    targets = spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int")
    rated = mixing.rates(sized, targets)
    mixed = mixing.mix(sized, rated)
    got = {r["source"]: r for r in mixing.shares(mixed, rated).collect()}
    assert set(got) == {"big", "mid", "tiny", "absent"} and got["absent"]["actual_share"] == 0.0 and got["tiny"]["rate"] == 4.0
    for s, want in (("big", 0.5), ("mid", 0.3), ("tiny", 0.1)):
        assert got[s]["actual_share"] == pytest.approx(want / 0.9, abs=0.03)
    assert mixed.groupBy("doc_id").count().agg(F.max("count")).first()[0] == 4
    again = mixing.mix(sized.repartition(7), rated)
    assert again.exceptAll(mixed).count() == 0 and mixed.exceptAll(again).count() == 0


def test_a_budget_beyond_the_caps(spark, sized):
    targets = spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int")
    rated = {r["source"]: r["rate"] for r in mixing.rates(sized, targets, budget=1_000_000).collect()}
    assert rated == {"big": 2.0, "mid": 2.0, "tiny": 4.0, "absent": 0.0}


def test_tokens_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a", "Hello world"), (2, "a", ""), (3, "a", None), (4, "b", "<|endoftext|>")], "doc_id long, source string, text string")
    got = {r["doc_id"]: r["tokens"] for r in mixing.count_tokens(docs).collect()}
    assert got[1] == 2 and got[2] == 0 and got[3] == 0 and got[4] > 1
    none = spark.createDataFrame([], "source string, target_share double, max_repeats int")
    assert mixing.mix(*mixing.prepared(docs, none)).count() == 0


# --- truncation


def corpus(seed=3, n=1500):
    """Texts of one source with a 200-character limit, sign-offs, headlines, lists and a few broken transfers; and which are cut."""
    rng = random.Random(seed)
    rows, cut = [], set()
    for i in range(n):
        sentences = [prose(rng, rng.randrange(5, 12)).capitalize() + "." for _ in range(rng.randrange(2, 9))]
        text = " ".join(sentences)
        kind = rng.randrange(10)
        if kind == 0:
            text += "\nThe evening desk"
        elif kind == 1:
            text += "\n- gap count: 12\n- hit rate: 7"
        elif kind == 2 and len(text) > 260:
            text = text[:200].rstrip("\n") if text[199] not in ". " else text[:201]
            if not text.rstrip().endswith("."):
                cut.add(i)
        elif kind == 3 and i % 5 == 0:
            text = text[: rng.randrange(60, len(text) - 3)]
            if not text.rstrip().endswith("."):
                cut.add(i)
        elif kind == 4 and len(text) > 220:
            body = text[:150]
            text = body + rng.choice(["…", "...", " [+93 chars]", "... (read more)"])
            if not body.rstrip().endswith("."):
                cut.add(i)
        rows.append((i, "wire", text))
    return rows, cut


def test_truncation(spark):
    rows, cut = corpus()
    extra = [(9001, "wire", None), (9002, "wire", ""), (9003, "wire", "  \n"), (9004, None, "One two."), (9005, "long", "Word. " * 50_000 + "and the")]
    df = spark.createDataFrame([(*r, "x") for r in rows + extra], "doc_id long, source string, text string, reason string")
    judged = truncation.truncated(df)
    got = {r["doc_id"] for r in judged.where("cut").collect()}
    cut |= {9005}
    assert len(got & cut) / len(cut) > 0.98 and len(got & cut) / len(got) > 0.98
    shares = {r["source"]: r for r in truncation.by_source(judged).collect()}
    assert shares["wire"]["texts"] == len(rows) + 2 and shares["wire"]["cut_texts"] == len(got - {9005})
    assert truncation.truncated(df.where("false")).count() == 0


def test_a_limit_stands_out_and_reposts_do_not(spark):
    rng = random.Random(5)
    rows = [(i, "s", "x" * rng.randrange(50, 400)) for i in range(600)] + [(1000 + i, "s", f"{i:03d}" + "y" * 117) for i in range(40)] + [(2000 + i, "s", "z" * 333) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    found = truncation.length_hazards(truncation._endings(df)).where("significant").select("length").distinct().collect()
    assert [r["length"] for r in found] == [120]


def test_hazards_against_a_loop(spark):
    rng = random.Random(21)
    lengths = [rng.randrange(20, 90) for _ in range(300)] + [60] * 45 + [rng.randrange(200, 400) for _ in range(20)] + [90] * 40
    rows = [(i, "s", f"{i:04d}".ljust(n, "x")) for i, n in enumerate(lengths)]
    got = {r["length"]: r for r in truncation.length_hazards(truncation._endings(spark.createDataFrame(rows, "doc_id long, source string, text string"))).where("measure = 'chars'").collect()}
    for length, r in got.items():
        at_risk = lambda k: sum(1 for n in lengths if n >= k)
        band = [k for k in range(max(length - 10, 0), length + 11) if k != length]
        ends, exposure = sum(lengths.count(k) for k in band), sum(map(at_risk, band))
        assert (r["n"], r["at_risk"]) == (lengths.count(length), at_risk(length))
        if exposure:
            assert r["expected"] == pytest.approx(at_risk(length) * min((ends + 0.5) / exposure, 1 - 1e-9))
    assert {k for k, r in got.items() if r["significant"]} == {60, 90}


def test_marks_are_learned_from_lengths(spark):
    rng = random.Random(30)
    rows = []
    for i in range(400):
        text = " ".join(prose(rng, rng.randrange(6, 12)).capitalize() + "." for _ in range(rng.randrange(3, 9)))
        if i % 8 == 0 and len(text) > 150:
            text = text[:150].rstrip() + f" {{{len(text) - 150} signs gone}}"
        elif i % 11 == 0:
            text += " [checked by desk]"
        rows.append((i, "wire", text))
    at = truncation._at_peaks(truncation._endings(df := spark.createDataFrame(rows, "doc_id long, source string, text string")), truncation.length_hazards(truncation._endings(df)))
    assert [r[0] for r in truncation.cut_marks(at).collect()] == ["{9 signs gone}"]


def test_long_words_and_last_lines(spark):
    word = "QUJD" * 25_000
    same = "x" * 500 + "tail " * 90 + "and"
    rows = [(1, "s", f"Start {word} end."), (2, "s", f"Start {word} end."), (3, "s", f"Start {word}x then."), (4, "s", f"Look at {word}"), (5, "t", "a" + same), (6, "t", "b" + same), (7, "t", "c" + same)]
    got = {r["doc_id"]: r["cut"] for r in truncation.truncated(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()}
    # three lone lines that differ only far from their end are three forms
    assert got == {1: False, 2: False, 3: False, 4: True, 5: True, 6: True, 7: True}


def test_queries_run(spark):
    d = data_dir("sf0.001")
    got = {name: query(spark, d).collect() for name, query in queries.QUERIES.items()}
    ids = {r["doc_id"] for r in got["p10_judged"] if r["cut"]}
    assert ids == {r["doc_id"] for r in got["p10_found"]} and sum(r["cut_texts"] for r in got["p10_sources"]) == sum(r["cut"] for r in got["p10_judged"])
    assert {(r["doc_id"], r["item_id"]) for r in got["p8_passages"]} == {(r["doc_id"], r["item_id"]) for r in got["p8_found"]} and all(r["words"] >= 13 for r in got["p8_passages"])
    assert {(r["left_key"], r["tick_id"]) for r in got["p3_lags"]} == {(r["left_key"], r["tick_id"]) for r in got["p3_found"]}
    taken: dict[str, int] = {}
    for r in got["p9_mix"]:
        taken[r["source"]] = taken.get(r["source"], 0) + r["tokens"]
    assert taken == {r["source"]: r["tokens_out"] for r in got["p9_shares"] if r["tokens_out"]}
    for r in got["p9_shares"]:
        assert r["documents_out"] <= r["documents"] * r["max_repeats"]
