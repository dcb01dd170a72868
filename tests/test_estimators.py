"""The estimators against brute force in Python on a small corpus."""

import math
import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from counterfact import fixed
from counterfact.functions.batches import count_scorer, map_batches, masked_scorer
from counterfact.operators import environments as envs
from counterfact.operators.dictionary import TermDictionary, mask_hits, single_hits
from counterfact.plans import cloze, environments, evaluation, grid, summary
from counterfact.sinks import writers
from counterfact.sources import corpus

TERMS = TermDictionary([("he", "she"), ("king", "queen")])
WORDS = "he she king queen the a went saw old, new x y z He Queen".split()
GRID = grid.Grid((0, 1), ("0.25", "0.5"), ("0.1", "0.5"))


def make_lines(seed, n):
    rng = random.Random(seed)
    return [" ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 9))) for _ in range(n)]


TRAIN, TEST = make_lines(1, 300), make_lines(2, 120)


@pytest.fixture(scope="module")
def train(lines_of):
    return lines_of(TRAIN, 5)


@pytest.fixture(scope="module")
def test_lines(lines_of):
    return lines_of(TEST, 3)


@pytest.fixture(scope="module")
def assigned(train):
    """Environment lines of one cell on the driver."""
    rows = envs.env_assign(train, TERMS, 0, 0.25).collect()
    return [(r.env, r.line) for r in rows]


def cut(line, context="left"):
    w = re.findall(r"\b\w+\b", line.lower())
    left = ["<s>"] + w
    for i, word in enumerate(w):
        yield (left[i] if context == "left" else f"{left[i]} {(w + ['</s>'])[i + 1]}"), word


class Brute:
    def __init__(self, env_lines, alpha, context="left"):
        self.alpha, self.context = alpha, context
        self.counts = {fixed.ENV_A: {}, fixed.ENV_B: {}}
        self.totals = {fixed.ENV_A: {}, fixed.ENV_B: {}}
        self.words = set(TERMS.terms)
        for env, line in env_lines:
            for ctx, word in cut(line, context):
                self.counts[env][ctx, word] = self.counts[env].get((ctx, word), 0) + 1
                self.totals[env][ctx] = self.totals[env].get(ctx, 0) + 1
                self.words.add(word)
        self.v = len(self.words) + 1

    def logit(self, method, ctx, word):
        def one(n, total):
            return math.log(n + self.alpha) - math.log(total + self.alpha * self.v)

        n = [self.counts[e].get((ctx, word), 0) for e in self.counts]
        t = [self.totals[e].get(ctx, 0) for e in self.counts]
        return one(sum(n), sum(t)) if method == "eLM" else sum(map(one, n, t)) / 2

    def prob(self, method, ctx, word):
        vocabulary = [*self.words, None]
        z = sum(math.exp(self.logit(method, ctx, w)) for w in vocabulary)
        return math.exp(self.logit(method, ctx, word)) / z


def brute_bias(model, method):
    out = {}
    for i, line in enumerate(TEST):
        found = [(c, w) for c, w in cut(line, model.context) if w in TERMS.opposites]
        if len(found) != 1:
            continue
        ctx, word = found[0]
        p1, p2 = model.prob(method, ctx, word), model.prob(method, ctx, TERMS.opposites[word])
        p = p1 / (p1 + p2)
        out[i] = 1 - (0 if p in (0, 1) else -(p * math.log2(p) + (1 - p) * math.log2(1 - p)))
    return out


@pytest.mark.parametrize("context", ["left", "both"])
def test_line_bias_equals_brute_force(train, test_lines, assigned, context):
    model = grid.fit_grid(train, TERMS, GRID, context)
    rows = grid.grid_line_bias(model, test_lines).where("seed = 0 AND p_env_a = 0.25").collect()
    for alpha in ("0.1", "0.5"):
        brute = Brute(assigned, float(alpha), context)
        for method in fixed.METHODS:
            got = {r.doc_id: r.bias for r in rows if r.method == method and r.alpha_text == alpha}
            assert got == pytest.approx(brute_bias(brute, method), abs=1e-9)
            assert all(0 <= b <= 1 for b in got.values())


def test_probabilities_sum_to_one(spark, train, assigned):
    model = grid.fit_grid(train, TERMS, GRID)
    words = Brute(assigned, 0.1).words | {"never seen"}
    requests = spark.createDataFrame([(c, w) for c in ("<s>", "the", "old", "nowhere") for w in words], "ctx string, word string")
    sums = model.score_words(requests).where("seed = 0 AND p_env_a = 0.25").groupBy("ctx", "alpha", "method").agg(F.sum("prob").alias("s"))
    assert [r.s for r in sums.collect()] == pytest.approx([1.0] * 16)


@pytest.mark.parametrize("most, block", [(8_192, 8), (9, 8), (3, 1), (8_192, 1)])
def test_grid_counts_equal_direct_counts(train, monkeypatch, most, block):
    """With the seeds in one group or several, and the values of p in one block or several."""
    monkeypatch.setattr(grid, "MOST_BINS", most)
    monkeypatch.setattr(grid, "BLOCK", block)
    assert GRID.small == (most > 3 and block > 1)
    model = grid.fit_grid(train, TERMS, GRID)
    cells = model.cell_counts(model.counts).collect()
    for seed, p in GRID.cells:
        env_lines = envs.env_assign(train, TERMS, seed, float(p))
        direct = {(r.env, r.ctx, r.word): r.n for r in cloze.fit_per_env(env_lines).collect()}
        assert {(r.env, r.ctx, r.word): r.n for r in cells if (r.seed, r.p_text) == (seed, p)} == direct
        pooled = {(r.ctx, r.word): r.n for r in cloze.fit_pooled(env_lines).collect()}
        assert pooled == {(r.ctx, r.word): r.n for r in cloze.pool_counts(cloze.fit_per_env(env_lines)).collect()}


def test_five_hundred_cells_equal_the_direct_form(train, test_lines):
    """A grid of many cells, with values of p in any order, 0 and 1 among them."""
    p_values = ["1.0", "0.0", *[f"{x / 100:.2f}" for x in range(97, 1, -2)]]
    many = grid.Grid(tuple(range(10)), tuple(p_values), ("0.1",))
    assert len(many.cells) == 500
    model = grid.fit_grid(train, TERMS, many)
    items = cloze.distinct_items(cloze.cell_items(test_lines, TERMS))
    scored = model.score_items(items).where("seed IN (0, 7) AND p_text IN ('0.0', '0.25', '0.97', '1.0')").collect()
    sizes = {(r.seed, r.j): r.vocab_size for r in model.vocab_sizes().collect()}
    assert len(sizes) == 500
    for seed, p in [(0, "0.0"), (7, "0.25"), (0, "0.97"), (7, "1.0")]:
        env_lines = envs.env_assign(train, TERMS, seed, float(p))
        counts = cloze.fit_per_env(env_lines)
        size = cloze.vocabulary_size(counts, TERMS)
        assert sizes[seed, many.borders.index(p)] == size
        brute = Brute([(r.env, r.line) for r in env_lines.collect()], 0.1)
        for r in scored:
            if (r.seed, r.p_text) == (seed, p):
                assert r.p1 == pytest.approx(brute.prob(r.method, r.ctx, r.target))
                assert r.p2 == pytest.approx(brute.prob(r.method, r.ctx, r.opposite))


def test_a_grid_is_checked():
    for bad in ({"seeds": ()}, {"p_values": ("0.5", "0.50")}, {"seeds": (1, 1)}, {"methods": ("xLM",)}, {"alphas": ()}):
        with pytest.raises(ValueError):
            grid.Grid(**bad)


def test_direct_scores_equal_grid(train, test_lines):
    counts = cloze.fit_per_env(envs.env_assign(train, TERMS, 0, 0.25))
    size = cloze.vocabulary_size(counts, TERMS)
    items = cloze.distinct_items(cloze.cell_items(test_lines, TERMS))
    found = cloze.candidate_scores(items, counts, [fixed.ENV_A, fixed.ENV_B], 0.1, size)
    mean = {tuple(r)[:3]: r.bias for r in cloze.pair_bias(cloze.mean_head_score(found)).collect()}
    model = grid.fit_grid(train, TERMS, GRID)
    rows = model.score_items(items).where("seed = 0 AND p_env_a = 0.25 AND alpha = 0.1 AND method = 'iLM'").collect()
    assert mean == pytest.approx({(r.ctx, r.target, r.opposite): r.bias for r in rows})
    one = cloze.candidate_scores(items, cloze.pool_counts(counts, "all"), ["all"], 0.1, size)
    pooled = {tuple(r)[:3]: r.bias for r in cloze.pair_bias(cloze.mean_head_score(one)).collect()}
    rows = model.score_items(items).where("seed = 0 AND p_env_a = 0.25 AND alpha = 0.1 AND method = 'eLM'").collect()
    assert pooled == pytest.approx({(r.ctx, r.target, r.opposite): r.bias for r in rows})


def test_summary_of_items_equals_summary_of_lines(train, test_lines):
    model = grid.fit_grid(train, TERMS, GRID)
    weighted = {(r.p_env_a, r.alpha, r.method): tuple(r)[3:] for r in grid.grid_summary(model, test_lines).collect()}
    lines = summary.bias_summary(grid.grid_line_bias(model, test_lines), ("p_env_a", "alpha", "method"))
    for r in lines.collect():
        assert weighted[r.p_env_a, r.alpha, r.method] == pytest.approx((r.n_scored, r.mean_bias, r.std_bias))


def test_evaluation_equals_brute_force(train, test_lines, assigned):
    model = grid.fit_grid(train, TERMS, grid.Grid((0,), ("0.25",), ("0.1",)))
    brute = Brute(assigned, 0.1)
    positions = evaluation.masked_positions(evaluation.eval_batches(test_lines, 8), 3, keep=("batch",))
    per_batch = {}
    for r in positions.collect():
        assert r.batch == r.doc_id // 8
        word = r.word if r.word in brute.words else None
        per_batch.setdefault(r.batch, []).append(-math.log(brute.prob("iLM", r.ctx, word)))
    row = evaluation.model_eval(model, test_lines, 3).where("method = 'iLM'").first()
    means = [sum(x) / len(x) for x in per_batch.values()]
    assert row.eval_loss == pytest.approx(sum(means) / len(means))
    assert row.token_loss == pytest.approx(sum(map(sum, per_batch.values())) / sum(map(len, per_batch.values())))
    assert row.perplexity == pytest.approx(math.exp(row.eval_loss))


def test_plugged_in_scorer_equals_line_bias(train, test_lines, assigned):
    brute = Brute(assigned, 0.1)

    def make_scorer():
        def score(masked, targets, opposites):
            contexts = [next(c for c, w in cut(m.replace(fixed.MASK, "MASKED")) if w == "masked") for m in masked]
            return (
                [brute.prob("iLM", c, t) for c, t in zip(contexts, targets)],
                [None if o == "king" else brute.prob("iLM", c, o) for c, o in zip(contexts, opposites)],
            )

        return score

    scored = masked_scorer(mask_hits(single_hits(test_lines, TERMS), TERMS), make_scorer).collect()
    model = grid.fit_grid(train, TERMS, grid.Grid((0,), ("0.25",), ("0.1",)))
    want = {r.doc_id: (r.p1, r.p2) for r in grid.grid_line_bias(model, test_lines).where("method = 'iLM'").collect()}
    assert len(scored) == len(want)
    for r in scored:
        assert r.p1 == pytest.approx(want[r.doc_id][0])
        assert (r.p2 is None) if r.opposite == "king" else r.p2 == pytest.approx(want[r.doc_id][1])


def test_a_scorer_that_sees_the_model_equals_line_bias(train, test_lines):
    """On all lines, also those whose context no environment has seen."""
    env_lines = envs.env_assign(train, TERMS, 0, 0.25).where("line NOT LIKE '%old%'")
    model = environments.fit_environments(env_lines, TERMS, 0.1)
    hits = cloze.hit_items(mask_hits(single_hits(test_lines, TERMS), TERMS))
    evidence = cloze.item_evidence(hits, model.counts, model.n_env, 0.1)
    joined = hits.join(evidence, ["ctx", "target", "opposite"], "left")
    scored = masked_scorer(joined, count_scorer(model.n_env, 0.1, model.vocab_size), evidence=cloze.EVIDENCE).collect()
    logits = {(r.ctx, r.target, r.word): math.exp(r.logit) for r in model.logits(cloze.distinct_items(hits), "iLM").collect()}
    of = {r.doc_id: r.ctx for r in hits.collect()}
    assert len(scored) == len(of) and evidence.where("envs IS NULL").count() > 0
    for r in scored:
        assert r.p1 == pytest.approx(logits[of[r.doc_id], r.target, r.target])
        assert r.p2 == pytest.approx(logits[of[r.doc_id], r.target, r.opposite])
    bias = {r.doc_id: r.bias for r in model.line_bias(test_lines, ["iLM"]).collect()}
    for r in scored:
        p = r.p1 / (r.p1 + r.p2)
        assert bias[r.doc_id] == pytest.approx(1 + p * math.log2(p) + (1 - p) * math.log2(1 - p))


def test_a_scorer_of_one_environment_sees_its_counts(train, test_lines, assigned):
    """The evidence names the environments, so a caller may use any of them."""
    model = environments.fit_environments(envs.env_assign(train, TERMS, 0, 0.25), TERMS, 0.1)
    hits = cloze.hit_items(mask_hits(single_hits(test_lines, TERMS), TERMS))
    v = model.vocab_size

    def make_scorer():
        def score(masked, targets, opposites, seen):
            found = []
            for names, n_t, n_o, n_ctx in zip(*(seen[c] for c in ("envs", "n_target", "n_opposite", "n_ctx"))):
                at = {} if names is None else {e: i for i, e in enumerate(names)}
                i = at.get("env_A")
                t, o, total = (0, 0, 0) if i is None else (n_t[i], n_o[i], n_ctx[i])
                found.append(((t + 0.1) / (total + 0.1 * v), (o + 0.1) / (total + 0.1 * v)))
            return tuple(zip(*found))

        return score

    evidence = cloze.item_evidence(hits, model.counts, model.n_env, 0.1)
    joined = hits.join(evidence, ["ctx", "target", "opposite"], "left")
    got = {r.doc_id: (r.p1, r.p2) for r in masked_scorer(joined, make_scorer, evidence=cloze.EVIDENCE).collect()}
    brute = Brute([(e, x) for e, x in assigned if e == fixed.ENV_A], 0.1)
    for r in hits.collect():
        n = [brute.counts[fixed.ENV_A].get((r.ctx, w), 0) for w in (r.target, r.opposite)]
        total = brute.totals[fixed.ENV_A].get(r.ctx, 0)
        assert got[r.doc_id] == pytest.approx(tuple((x + 0.1) / (total + 0.1 * v) for x in n))


def test_environments(train, lines_of):
    a = {p: {r.doc_id for r in envs.env_assign(train, TERMS, 0, p).where("env = 'env_A'").collect()} for p in (0.1, 0.25, 0.9)}
    assert a[0.1] < a[0.25] < a[0.9] and len(a[0.9]) < len(TRAIN)
    cells = envs.grid_assign(train, TERMS, (0, 1), ("0.25", "0.5"))
    assert cells.count() == 4 * len(TRAIN)
    one = {(r.env, r.doc_id, r.line) for r in cells.where("seed = 0 AND p_env_a = 0.25").collect()}
    assert one == {(r.env, r.doc_id, r.line) for r in envs.env_assign(train, TERMS, 0, 0.25).collect()}
    sizes = envs.grid_sizes(train, (0, 1), ("0.25", "0.5")).collect()
    assert all(r.n_a + r.n_b == len(TRAIN) for r in sizes) and len(sizes) == 4
    assert envs.experiment_grid(envs.grid_sizes(train, (0, 1), ("0.25", "0.5"))).count() == 16
    assert [r.env for r in envs.env_list(train.withColumn("env", F.lit(fixed.POOLED_ENV))).collect()] == ["erm"]


def test_nested_streams_hold_every_cell(spark, train, tmp_path):
    """Every cell out of the stored streams equals its own assignment; no line is stored for every p."""
    seeds, p_values = (0, 3), ("0.9", "0.25", "1.0", "0.5", "0.0")
    streams = envs.nested_streams(train, TERMS, seeds, p_values)
    writers.write_streams(streams, str(tmp_path / "streams"))
    stored = corpus.stored_streams(spark, str(tmp_path / "streams"))
    assert len(TRAIN) * len(seeds) <= stored.count() <= 2 * len(TRAIN) * len(seeds)
    sizes = {(r.seed, r.p_env_a, r.env): (r.n_lines, r.n_chars) for r in envs.stream_sizes(stored, p_values).collect()}
    for p in p_values:
        got = envs.cell_of_streams(stored, p)
        cells = {(r.seed, r.env, r.doc_id, r.line) for r in got.collect()}
        for seed in seeds:
            want = {(r.env, r.doc_id, r.line) for r in envs.env_assign(train, TERMS, seed, float(p)).collect()}
            here = {(e, k, x) for s, e, k, x in cells if s == seed}
            # Swapping also makes white space plain, which the drawn lines do not have.
            assert here == want and len(want) == len(TRAIN)
            for env in (fixed.ENV_A, fixed.ENV_B):
                own = [x for e, _, x in want if e == env]
                assert sizes.get((seed, float(p), env), (0, 0)) == (len(own), sum(map(len, own)))
    plan = envs.cell_of_streams(stored, "0.25")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [((" in plan


def test_seeds_share_the_text_of_their_streams(spark, lines_of, tmp_path):
    """Of eight seeds, each with its own rows, a text that cannot be packed is kept once for each value and side."""
    name = "spark.sql.maxConcurrentOutputFileWriters"
    before, digits = spark.conf.get(name, None), random.Random(0)
    texts = [f"he is {digits.getrandbits(2400):x}" for _ in range(1000)]
    seeds, p_values = tuple(range(8)), ("0.5", "0.9")
    streams = envs.nested_streams(lines_of(texts, 3), TERMS, seeds, p_values)
    for _ in range(2):  # a second export replaces the first
        writers.write_streams(streams, str(tmp_path / "streams"))
    stored = corpus.stored_streams(spark, str(tmp_path / "streams"))
    rows = lambda df: sorted(map(tuple, df.select(streams.columns).collect()))
    assert rows(stored) == rows(streams)
    # A digit holds half a byte. Two values for each side: 4 texts a line; stored for each seed they were about 11.
    size = sum(f.stat().st_size for f in (tmp_path / "streams").rglob("*.parquet"))
    assert size < 5.5 * sum(map(len, texts)) / 2
    assert spark.conf.get(name, None) == before


@pytest.mark.parametrize("partitions, shuffles", [(1, 8), (4, 3), (37, 8)])
def test_results_do_not_depend_on_partitions(spark, lines_of, test_lines, partitions, shuffles):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", shuffles)
    try:
        model = grid.fit_grid(lines_of(TRAIN, partitions), TERMS, grid.Grid((0,), ("0.25",), ("0.1",)))
        rows = grid.grid_summary(model, test_lines).orderBy("method").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    got = [round(v, 9) for r in rows for v in (r.mean_bias, r.std_bias)]
    assert _FIRST.setdefault("rows", got) == got


_FIRST = {}


def test_map_batches_may_change_the_row_count(spark):
    def double(columns):
        return {"x": pa.concat_arrays([columns["id"], columns["id"]])}

    rows = map_batches(spark.range(0, 2500, 1, 2), double, "x bigint", 100).collect()
    assert sorted(r.x for r in rows) == sorted([i for i in range(2500)] * 2)


def test_estimators_of_a_folder_with_three_environments(spark, lines_of, test_lines, tmp_path):
    """Two of the three hold the assigned lines, so the mean over those two is known from the grid model."""
    env_lines = envs.env_assign(lines_of(TRAIN), TERMS, 0, 0.25)
    for env, name in (("env_A", "env A"), ("env_B", "env+B")):
        env_lines.where(F.col("env") == env).select("line").write.text(str(tmp_path / f"{name}.txt"))
    lines_of(["other words here"]).select("line").write.text(str(tmp_path / "third.txt"))
    model = environments.fit_environments(corpus.env_folder_scan(spark, str(tmp_path)), TERMS, 0.1)
    assert sorted(r.env for r in model.envs.collect()) == ["env A", "env+B", "third"] and model.n_env == 3
    two = environments.fit_environments(env_lines, TERMS, 0.1)
    want = grid.grid_line_bias(grid.fit_grid(lines_of(TRAIN), TERMS, grid.Grid((0,), ("0.25",), ("0.1",))), test_lines)
    expected = {(r.doc_id, r.method): r.bias for r in want.collect()}
    got = {(r.doc_id, r.method): r.bias for r in two.line_bias(test_lines, ["eLM", "iLM"]).collect()}
    assert got.keys() == expected.keys() and all(got[k] == pytest.approx(expected[k]) for k in got)
    alone = model.line_bias(test_lines, ["env A", "eLM", "iLM"]).collect()
    assert {r.method for r in alone} == {"env A", "eLM", "iLM"}
    result = {r.method: r for r in model.evaluate(test_lines, 0, ["eLM", "iLM", "third"]).collect()}
    assert set(result) == {"eLM", "iLM", "third"}


def test_ten_thousand_environments_equal_brute_force(spark, test_lines):
    """The mean of many estimators, of which most have not seen a context or a word."""
    rng = random.Random(9)
    rows = [(f"env {rng.randrange(10_000)}", " ".join(rng.choice(WORDS) for _ in range(4))) for _ in range(3_000)]
    rows += [(f"env {e}", "he went") for e in range(10_000)]
    model = environments.fit_environments(spark.createDataFrame(rows, "env string, line string"), TERMS, 0.1)
    assert model.n_env == 10_000
    counts, totals, vocabulary = {}, {}, set(TERMS.terms)
    for env, line in rows:
        for ctx, word in cut(line):
            counts.setdefault((ctx, word), {}).setdefault(env, 0)
            counts[ctx, word][env] += 1
            totals.setdefault(ctx, {}).setdefault(env, 0)
            totals[ctx][env] += 1
            vocabulary.add(word)
    v = len(vocabulary) + 1
    assert model.vocab_size == v

    def logit(ctx, word):
        n, t = counts.get((ctx, word), {}), totals.get(ctx, {})
        over = sum(math.log(x + 0.1) for x in n.values()) + (10_000 - len(n)) * math.log(0.1)
        under = sum(math.log(x + 0.1 * v) for x in t.values()) + (10_000 - len(t)) * math.log(0.1 * v)
        return (over - under) / 10_000

    items = cloze.distinct_items(cloze.cell_items(test_lines, TERMS))
    plain = cloze.mean_logits(items, model.counts, model.n_env, 0.1, v).collect()
    assert plain and all(r.logit == pytest.approx(logit(r.ctx, r.word)) for r in plain)
    for r in model.logits(items, "iLM").collect():
        z = sum(math.exp(logit(r.ctx, w)) for w in [*vocabulary, None])
        assert r.logit == pytest.approx(logit(r.ctx, r.word) - math.log(z))
    assert model.line_bias(test_lines, ["eLM", "iLM"]).count() > 0


def test_many_names_are_listed(spark):
    rows = spark.range(3_000).select(F.concat(F.lit("e"), F.col("id") % 1_500).alias("env"))
    assert [r.env for r in envs.env_list(rows).collect()] == sorted(f"e{i}" for i in range(1_500))


def test_join_frequent_equals_a_join(spark, monkeypatch):
    monkeypatch.setattr(evaluation, "FREQUENT_SHARE", 3)
    many = spark.range(100).select(F.when(F.col("id") < 60, 0).otherwise(F.col("id") % 7).alias("k"), "id")
    one = spark.range(7).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    asked = many.groupBy("k").agg(F.count("*").alias("n_rows"))
    got = evaluation.join_frequent(many, one, asked, ["k"])
    assert {tuple(r) for r in got.select("id", "k", "v").collect()} == {
        tuple(r) for r in many.join(one, "k").select("id", "k", "v").collect()
    }


def test_folded_contexts_give_the_same_scores(train, lines_of, monkeypatch):
    """Only the contexts that are asked for have rows of their own; scores and sizes of vocabularies stay."""
    cells = grid.Grid((0, 1), ("0.25", "0.5"), ("0.1",))
    test_lines = lines_of(["x he", "the queen went", "king", "new she", "z z king", "no such he"])
    asked = cloze.cell_items(test_lines, TERMS).select("ctx")
    names = {r.ctx for r in asked.distinct().collect()}
    whole, folded = grid.fit_grid(train, TERMS, cells), grid.fit_grid(train, TERMS, cells, asked=asked)
    assert {r.ctx for r in folded.counts.select("ctx").distinct().collect()} - {None} < names
    assert folded.counts.count() < whole.counts.count()
    assert sorted(folded.vocab_sizes().collect()) == sorted(whole.vocab_sizes().collect())
    scores = [
        sorted((*r[:-3], round(r.p1, 9), round(r.p2, 9), round(r.bias, 9)) for r in grid.grid_line_bias(m, test_lines).collect())
        for m in (folded, whole)
    ]
    assert scores[0] == scores[1] and len(scores[0]) == 6 * 4 * 2
    assigned = envs.env_assign(train, TERMS, 0, 0.25)
    some, every = cloze.fit_per_env(assigned, asked=asked), cloze.fit_per_env(assigned)
    columns = ["env", "ctx", "word", "n"]
    assert sorted(some.where("ctx IS NOT NULL").select(*columns).collect()) == sorted(
        every.join(asked.distinct(), "ctx", "left_semi").select(*columns).collect()
    )
    assert cloze.vocabulary_size(some, TERMS) == cloze.vocabulary_size(every, TERMS)
    monkeypatch.setattr(cloze, "ASKED_CONTEXTS", 0)
    assert cloze.fit_per_env(assigned, asked=asked).where("ctx IS NULL").count() == 0


def test_folded_environments_give_the_same_scores(spark, train, lines_of):
    """Pooled, mean and one environment, asked for a few contexts."""
    test_lines = lines_of(["x he", "the queen went", "king"])
    env_lines = envs.env_assign(train, TERMS, 0, 0.25)
    asked = cloze.cell_items(test_lines, TERMS).select("ctx")
    found = []
    for contexts in (None, asked):
        model = environments.fit_environments(env_lines, TERMS, 0.1, asked=contexts)
        rows = model.line_bias(test_lines, [*fixed.METHODS, fixed.ENV_B]).collect()
        found.append((model.n_env, model.vocab_size, sorted((*r[:-1], round(r.bias, 9)) for r in rows)))
    assert found[0] == found[1] and len(found[0][2]) == 9
