import collections
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from counterfact.llm import pitman_yor
from counterfact.llm.pitman_yor import (
    CONTEXTS,
    Sampler,
    Totals,
    _from_planes,
    _live_pairs,
    _packed,
    _seated_pairs,
    blocks,
    held_out,
    pair_counts,
    pair_sweep,
    score_texts,
    seated,
    sweep,
    word_counts,
)
from counterfact.llm.staging import stage
from tests.llm.cases import ASCII_LOWER, SCHEMA, WORD, edge_table, empty_table, prose


def tokens(text):
    return [*WORD.findall((text or "").translate(ASCII_LOWER)), ""]


def check_base(rows, texts, held):
    counts = collections.Counter(w for i, t in texts.items() if not held[i] for w in tokens(t))
    total, words = sum(counts.values()), len(counts)
    assert len(rows) == len(texts)
    for r in rows:
        i = r["doc_id"]
        seen = tokens(texts[i])
        assert (r["held_out"], r["n_tokens"], r["train_tokens"]) == (held[i], len(seen), total)
        assert r["n_known"] == sum(counts[w] > 0 for w in seen)
        want = sum(math.log10((counts[w] + 1) / (total + words + 1)) for w in seen)
        assert abs(want - r["base_score"]) <= 1e-9 * max(1, abs(want))


@pytest.mark.parametrize("customers", [1, 2, 5, 40, 3000])
def test_seating_has_the_tables_of_a_restaurant(customers):
    """The mean number of tables equals that of customers seated one by one."""
    discount, strength, base, others = 0.6, 1.5, 0.4, 3.0
    n = 400
    got = seated(
        np.full(n, customers), np.full(n, others), np.full(n, base), discount, strength, np.arange(n) * 7919, 3, 32
    )
    assert got.min() >= 1 and got.max() <= customers
    rng = np.random.default_rng(1)
    tables = np.ones(n)
    for sat in range(1, customers):
        new = (strength + discount * (others + tables)) * base
        tables += rng.random(n) < new / (new + sat - discount * tables)
    spread = math.sqrt((tables.var() + got.var()) / n) + 1e-9
    assert abs(got.mean() - tables.mean()) < 5 * spread + 0.03 * tables.mean()


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(2)
    counts = rng.poisson(1.5, (50, CONTEXTS))
    counts = counts[counts.any(1)]
    tables, above = (counts > 0).astype(float), np.ones(len(counts))

    def totals():
        return Totals(counts.sum(0).astype(float), tables.sum(0), above.sum(), len(counts), 0.7, 0.6, 1.0)

    for turn in range(4):
        tables, above = sweep(counts, tables, above, np.arange(len(counts)) + 9, totals(), turn, Sampler())
        assert ((tables >= (counts > 0)) & (tables <= counts)).all()
        assert ((above >= 1) & (above <= tables.sum(1))).all()
        now = totals()
        assert np.allclose(now.predictive(counts, tables, above).sum(0) + now.unknown(), 1)


def test_query_equals_brute_force_and_beats_it(spark):
    d = "/root/testdata/sf0.01"
    rows = entry.queries()["op7_pitman_yor"](spark, d).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    check_base(rows, texts, {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts})
    out = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)
    assert all(r["score"] < 0 for r in rows)


def test_the_word_before_decides(spark):
    """Of 300 words of one class each has one follower; only restaurants of single words can know it."""
    words = ["".join("bdfgklmnpr"[int(c)] + "a" for c in f"{k:03d}") for k in range(300)]
    texts = [" ".join(words[(7 * k + i) % 300] for i in range(60)) for k in range(140)]
    texts += [f"{words[0]} {words[150]}", f"unseen {words[150]}"]
    table = spark.createDataFrame([(k, t, None, None, None) for k, t in enumerate(texts)], SCHEMA).repartition(3)
    for size in (1 << 25, 1):
        rows = {r["doc_id"]: r for r in score_texts(table, F.col("doc_id") >= 135, block_bytes=size).collect()}
        # Sixty followers, one first word and one end.
        assert all(rows[k]["score"] > -8 > -100 > rows[k]["base_score"] for k in range(135, 140))
        # A pair that is never seen is scored by its class.
        assert rows[140]["score"] < -5 and rows[141]["score"] < -5


@pytest.mark.parametrize("block_bytes", [1 << 25, 1])
def test_pairs_equal_brute_force(spark, block_bytes):
    """Every distinct pair of training texts is one table, whichever blocks hold it."""
    texts = {k: prose(50, k % 7) for k in range(30)}
    table = spark.createDataFrame([(k, t, None, None, None) for k, t in texts.items()], SCHEMA).repartition(3)
    cut = stage(blocks(table, "doc_id", "text", F.col("doc_id") % 5 == 2, block_bytes), "blocks")
    pairs = stage(pair_counts(cut, 4), "pairs")
    train = [tokens(t) for k, t in texts.items() if k % 5 != 2]
    counts = collections.Counter(p for seen in train for p in zip(seen, seen[1:]))
    once, twice = pairs.agg(F.sum("once"), F.sum("twice")).first()
    assert (once, twice) == tuple(sum(n == k for n in counts.values()) for k in (1, 2))
    got = {r["word"]: (r["n"], r["n0"]) for r in word_counts(cut).collect()}
    assert got == {w: (sum(seen.count(w) for seen in train), sum(seen[0] == w for seen in train)) for seen in train for w in seen}
    # With a discount of nothing and words that are never new, every pair has one table, whichever block adds it.
    flat = cut.select("block", F.posexplode("words").alias("number", "word"))
    none = [F.lit(0.0).cast("float").alias(f"p{k}") for k in range(CONTEXTS)]
    packed = _packed(flat.select("block", "number", F.lit(1).cast("bigint").alias("n"), F.lit(1).cast("bigint").alias("own"), *none))
    sat = _seated_pairs(cut, pairs, packed, 0.0, Sampler()).where("word IS NOT NULL")
    sums = [f"n{k}" for k in range(CONTEXTS)]
    found = {r["word"]: r for r in sat.groupBy("word").agg(*[F.sum(c).alias(c) for c in ("n", "own", *sums)]).collect()}
    kind = lambda w: 1 if w[-1] in ".!?" else 2 if len(w) <= 3 else 3 if len(w) <= 7 else 4
    for w, r in found.items():
        assert (r["n"], r["n0"]) == got[w]
        assert r["own"] == sum(u == w for u, _ in counts)
        assert [r[f"n{k}"] for k in range(1, 5)] == [sum(x == w and kind(u) == k for u, x in counts) for k in range(1, 5)]


def test_a_sweep_seats_pairs_given_all_others():
    """The mean number of tables equals that of customers seated one by one, after those of the pair have left."""
    n, customers, mine, own = 400, 12, 5, 9
    totals = Totals(np.array([20.0, 30, 10, 5, 9]), np.array([6.0, 9, 4, 2, 3]), 11.0, 40, 0.6, 0.5, 1.0)
    full = lambda v: np.full(n, v)
    got = pair_sweep(
        full(customers), full(mine), full(own), full(1), full(7), full(2), full(4), full(2), np.arange(n) * 7919, totals, 0.7, 3,
        Sampler(),
    )
    free = (1 + 0.5 * 11) / 41
    parent = (4 - 0.5 * 2 + free) / (1 + 24)
    base = (7 - mine - 0.6 * 2) / (1 + 30) + (1 + 0.6 * 9) / (1 + 30) * parent
    rng = np.random.default_rng(1)
    want = np.ones(n)
    for sat in range(1, customers):
        new = (1 + 0.7 * (own - mine + want)) * base
        want += rng.random(n) < new / (new + sat - 0.7 * want)
    assert got.min() >= 1 and got.max() <= customers
    assert abs(got.mean() - want.mean()) < 5 * math.sqrt((want.var() + got.var()) / n) + 1e-9


@pytest.mark.parametrize("block_bytes", [1 << 25, 1])
def test_pairs_are_sampled_in_sweeps_and_averaged(spark, monkeypatch, block_bytes):
    """The sums of every kept seating are those of its pairs, which sit anew; a score is the mean over the seatings."""
    texts = {k: prose(60, k % 9) for k in range(30)}
    table = spark.createDataFrame([(k, t, None, None, None) for k, t in texts.items()], SCHEMA).repartition(3)
    caught = {}
    sample = pitman_yor.sample_seatings

    def catch(sums, fixed, places, discount, rule):
        caught.update(fixed=fixed, places=places, sums=sums, discount=discount, kept=sample(sums, fixed, places, discount, rule))
        return caught["kept"]

    monkeypatch.setattr(pitman_yor, "sample_seatings", catch)
    rows = {r["doc_id"]: r for r in score_texts(table, F.col("doc_id") % 5 == 2, block_bytes=block_bytes).collect()}
    train = [tokens(t) for k, t in texts.items() if k % 5 != 2]
    pairs = collections.Counter(p for seen in train for p in zip(seen, seen[1:]))
    n = collections.Counter(w for seen in train for w in seen)
    names = {r["id"]: r["word"] for r in caught["sums"].collect()}
    at = {(r["block"], r["number"]): names[r["id"]] for r in caught["places"].collect()}
    kind = lambda w: 1 if w[-1] in ".!?" else 2 if len(w) <= 3 else 3 if len(w) <= 7 else 4
    fixed = caught["fixed"].collect()

    def seats_of(payloads):
        found = {p: 1 for p in pairs}
        for r in fixed:
            before, after, *_ = _live_pairs(r["live"], r["n_live"])
            tables = _from_planes(payloads[r["block"]], r["n_live"], "<i8")[0]
            for u, w, t in zip(before.tolist(), after.tolist(), tables.tolist()):
                pair = at[r["block"], u], at[r["block"], w]
                assert 1 <= t <= pairs[pair]
                # All blocks that hold the pair find the same tables.
                assert found.setdefault(("seen", pair), t) == t
                found[pair] = t
        return {p: found[p] for p in pairs}

    sat = [seats_of({r["block"]: r["seats"] for r in fixed})]
    models = []
    for one in caught["kept"]:
        sat.append(seats_of({r["block"]: r["payload"] for r in one.pairs.collect()}))
        words = {names[r["id"]]: r for r in one.words.collect()}
        for w, r in words.items():
            assert r["own"] == sum(t for (u, _), t in sat[-1].items() if u == w)
            of_kinds = [sum(t for (u, x), t in sat[-1].items() if x == w and kind(u) == k) for k in range(1, 5)]
            assert [r[f"n{k}"] for k in range(1, 5)] == of_kinds
        assert [sum(r[f"n{k}"] for r in words.values()) for k in range(CONTEXTS)] == one.totals.customers.tolist()
        models.append((one.totals, words, sat[-1]))
    # Every sweep seats them anew.
    assert all(a != b for a, b in zip(sat, sat[1:]))

    def probability(u, w, model):
        totals, words, tables = model
        r = words.get(w)
        cells = [[r[f"{c}{k}"] if r else 0 for k in range(CONTEXTS)] for c in "nt"]
        chances = totals.predictive(*[np.array([c], float) for c in cells], np.array([r["above"] if r else 0.0]))[0]
        if u is None:
            return chances[0]
        own = words[u]["own"] if u in words else 0
        seated_ = max(pairs[u, w] - caught["discount"] * tables.get((u, w), 0), 0)
        return (seated_ + (1 + caught["discount"] * own) * chances[kind(u)]) / (1 + n[u])

    for k in (0, 2, 3, 7):
        seen = tokens(texts[k])
        want = sum(math.log10(np.mean([probability(u, w, m) for m in models])) for u, w in zip([None, *seen], seen))
        assert abs(want - rows[k]["score"]) < 1e-4
    for u in list(n)[:3]:
        if u:
            for model in models:
                total = sum(probability(u, w, model) for w in n) + probability(u, "never seen", model)
                assert abs(total - 1) < 1e-9


def test_small_blocks_give_the_same(spark):
    table = spark.createDataFrame([(k, prose(60, k % 9), None, None, None) for k in range(40)], SCHEMA).repartition(3)
    one, many = (
        {r["doc_id"]: r.asDict() for r in score_texts(table, held_out(), block_bytes=size).collect()}
        for size in (1 << 25, 1)
    )
    assert one.keys() == many.keys()
    for k, r in one.items():
        assert all(abs(r[c] - many[k][c]) < 1e-6 for c in ("n_known", "base_score", "score"))


def test_planes_keep_all_numbers():
    columns = [
        np.array([0, 255, 3], "<i8"), np.array([0, 256, 65535], "<i8"), np.array([1 << 40, 0, 7], "<i8"),
        np.array([-1, 5, 1 << 62], "<i8"), np.array([(1 << 64) - 1, 0, 1], "<u8"), np.array([0, 0, 0], "<i4"),
        np.array([0.5, -2.0, 1e-9], "<f4"), np.array([200, 0, 1], "u1"),
    ]
    for n in (3, 1, 0):
        some = [c[:n] for c in columns]
        found = _from_planes(pitman_yor._planes(*some), n, *[c.dtype.str for c in columns])
        assert all((a == b).all() and a.dtype == b.dtype for a, b in zip(some, found, strict=True))


def test_order_of_codes_that_fit_and_that_do_not():
    codes = np.random.default_rng(3).integers(0, 50, 1000)
    places = np.arange(1000, dtype=np.int32) * 3 + 1
    want = np.argsort(codes, kind="stable")
    for end in (50, 1 << 60):
        got, order = pitman_yor._ordered(codes.copy(), places.copy(), end)
        assert (got == codes[want]).all() and (order == places[want]).all()


def test_words_of_blocks_move_packed_by_parts(spark, monkeypatch):
    """A block and a part of the vocabulary exchange one row; the number of parts does not change a score."""
    texts = [prose(60, k % 9) for k in range(30)] + ["Zz \u00e9t\u00e9 one \U0001f600 two", "", None]
    table = spark.createDataFrame([(k, t, None, None, None) for k, t in enumerate(texts)], SCHEMA).repartition(3)
    rows = {}
    written = pitman_yor.stage_compact

    def catch(df, label):
        out = written(df, label)
        rows[label] = out.count()
        return out

    monkeypatch.setattr(pitman_yor, "stage_compact", catch)
    found = []
    for size in (1 << 30, 20):
        monkeypatch.setattr(pitman_yor, "PART_WORDS", size)
        scored = score_texts(table, F.col("doc_id") % 5 == 2)
        found.append({r["doc_id"]: r.asDict() for r in scored.collect()})
        parts = -(-rows["vocabulary"] // size)
        assert rows["places"] <= rows["blocks"] * parts
        assert all(rows[c] <= rows["blocks"] * (parts + 1) for c in ("tables", "tables-1", "tables-2"))
        assert all(rows[c] == rows["vocabulary"] for c in ("sums", "seating-0", "seating-1", "seating-2"))
    assert parts > 1 and rows["blocks"] == 3
    assert found[0].keys() == found[1].keys() and len(found[0]) == len(texts)
    for k, r in found[0].items():
        assert all(abs(r[c] - found[1][k][c]) < 1e-9 for c in ("n_known", "base_score", "score"))


def test_edges(spark):
    table = edge_table(spark)
    rows = score_texts(table, held_out()).collect()
    assert len(rows) == 11
    by = {r["doc_id"]: r for r in rows}
    assert by[None]["held_out"]
    assert [by[k]["n_tokens"] for k in (1, 2, 3)] == [1, 1, 1]
    nothing = score_texts(table, F.lit(True)).collect()
    assert {(r["train_tokens"], r["base_score"], r["n_known"]) for r in nothing} == {(0, 0.0, 0)}
    assert all(abs(r["score"]) < 1e-6 * r["n_tokens"] for r in nothing)
    assert score_texts(empty_table(spark), held_out()).count() == 0
