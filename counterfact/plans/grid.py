"""All cells of the experiment grid in one pass over the training text.

Draws do not depend on p, so a line is in environment A of a cell where its draw is below p and otherwise,
swapped, in environment B. The sorted values of p cut the draws into bins: bin j lies between value j - 1 and
value j. The counts of a cell are sums over bins: environment A at value j has the bins up to j, environment B the
others.

Every ``(ctx, word)`` of a line is counted once for a group of seeds, under the bins of the line for all seeds of
the group. There are as many seeds in a group as give ``MOST_BINS`` combinations of bins at most: a rare pair has
one row a group, and a frequent one no more rows than combinations. So neither the text nor the counts are fanned
out over p, and a bin without a line takes no room. Cells are made from the counts, after these have been cut down
to what is asked for. A grid of one group of seeds and one block of values of p is small enough to be counted with a
column for each cell from the beginning.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from counterfact import fixed
from counterfact.functions import text
from counterfact.functions.measures import entropy_bias, pair_probability
from counterfact.operators.dictionary import TermDictionary
from counterfact.operators.environments import line_draw
from counterfact.plans import cloze
from counterfact.staging import stage

# Combinations of bins that the seeds of a group may have, and values of p that are columns of a row.
MOST_BINS, BLOCK = 8_192, 8
_CELL_COLUMNS = ("seed", "p_text", "p_env_a", "alpha_text", "alpha", "method")


@dataclass(frozen=True)
class Grid:
    """Seeds, shares of environment A, smoothing values and methods; numbers as text."""

    seeds: Sequence[int] = fixed.SEEDS
    p_values: Sequence[str] = fixed.P_ENV_A
    alphas: Sequence[str] = fixed.ALPHAS
    methods: Sequence[str] = fixed.METHODS

    def __post_init__(self) -> None:
        if not self.cells or not self.alphas or not self.methods:
            raise ValueError("a grid needs a cell, a smoothing value and a method")
        unknown = set(self.methods) - set(fixed.METHODS)
        if unknown:
            raise ValueError(f"unknown methods: {sorted(unknown)}")
        for values in (self.seeds, [float(p) for p in self.p_values], [float(a) for a in self.alphas], self.methods):
            if len(set(values)) < len(values):
                raise ValueError(f"repeated values: {list(values)}")

    @property
    def cells(self) -> list[tuple[int, str]]:
        return [(s, p) for s in self.seeds for p in self.p_values]

    @property
    def borders(self) -> list[str]:
        """The values of p in rising order, which are the borders of the bins."""
        return sorted(self.p_values, key=float)

    @property
    def groups(self) -> list[list[int]]:
        """Seeds that are counted together."""
        base, size = len(self.p_values) + 1, 1
        while base ** (size + 1) <= MOST_BINS:
            size += 1
        return [list(self.seeds[at : at + size]) for at in range(0, len(self.seeds), size)]

    def group_bins(self, group: Sequence[int]) -> Column:
        """Bins of a line for the seeds of a group, as the digits of one number."""
        digits = [_bin(line_draw(seed), self.borders) * (len(self.p_values) + 1) ** i for i, seed in enumerate(group)]
        return sum(digits[1:], digits[0]).cast("int")

    def digit(self, i: int) -> str:
        """Bin for the i-th seed of a group, out of the column ``bins``."""
        base = len(self.p_values) + 1
        return f"cast(bins div {base**i} % {base} AS int)"

    @property
    def small(self) -> bool:
        """Whether all cells are columns of one row."""
        return len(self.groups) == 1 and self.n_blocks == 1

    @property
    def n_blocks(self) -> int:
        """Blocks of values of p."""
        return -(-len(self.p_values) // BLOCK)

    def p_literal(self) -> Column:
        """Array of the values of p, for ``explode``."""
        return F.array(
            *[
                F.struct(F.lit(j).alias("j"), F.lit(p).alias("p_text"), F.lit(float(p)).alias("p_env_a"))
                for j, p in enumerate(self.borders)
            ]
        )

    def alpha_literal(self) -> Column:
        """Array of the smoothing values, for ``explode``."""
        return F.array(
            *[
                F.struct(F.lit(k).alias("k"), F.lit(a).alias("alpha_text"), F.lit(float(a)).alias("alpha"))
                for k, a in enumerate(self.alphas)
            ]
        )


@dataclass(frozen=True)
class GridModel:
    """Estimators of all cells: a table ``(ctx, word, part, bins, keep, swap)`` of counts, where ``part`` numbers
    the group of seeds, ``keep`` are the words of the lines as they are, ``swap`` those of the swapped lines. The
    table of a small grid has the counts of its cells instead, as ``per_cell_columns`` gives them. Contexts may be
    folded; those that were asked for are whole."""

    grid: Grid
    dictionary: TermDictionary
    counts: DataFrame
    context: str = "left"
    sizes: DataFrame | None = None

    def vocab_sizes(self) -> DataFrame:
        """Vocabulary size per seed and p: that of the fit, if there is one."""
        return self.sizes if self.sizes is not None else self.count_vocabulary()

    def count_vocabulary(self) -> DataFrame:
        """The same from the counts: a word is in the cells from its first kept bin on, and in those before its
        last swapped one."""
        n_bins, extra = len(self.grid.p_values), len(self.dictionary) + 1
        unlisted = self.counts.where(~self.dictionary.contains(F.col("word")))
        spans = []
        # A column for each place in a group; a group with fewer seeds leaves the last ones unused.
        for i in range(len(self.grid.groups[0])):
            if self.grid.small:
                first = " ".join(f"WHEN a{i}_{j} > 0 THEN {j}" for j in range(n_bins))
                last = " ".join(f"WHEN b{i}_{j} > 0 THEN {j + 1}" for j in reversed(range(n_bins)))
            else:
                first, last = (f"WHEN {x} > 0 THEN {self.grid.digit(i)}" for x in ("keep", "swap"))
            spans.append(F.expr(f"min(CASE {first} ELSE {n_bins} END) AS first{i}"))
            spans.append(F.expr(f"max(CASE {last} ELSE 0 END) AS last{i}"))
        of_word = unlisted.groupBy("part", "word").agg(*spans)
        spans = self._of_group(
            lambda i, seed: F.struct(F.lit(seed).alias("seed"), F.col(f"first{i}").alias("first"), F.col(f"last{i}").alias("last"))
        )
        found = of_word.select(F.inline(spans)).groupBy("seed", "first", "last").agg(F.count(F.lit(1)).alias("n"))
        # A row for each seed and pair of bins; what is made of them has one row per cell.
        sizes = {(seed, j): extra for seed in self.grid.seeds for j in range(n_bins)}
        for seed, first, last, n in found.collect():
            for j in range(n_bins):
                if j >= first or j < last:
                    sizes[seed, j] += n
        rows = [(seed, j, size) for (seed, j), size in sizes.items()]
        return self.counts.sparkSession.createDataFrame(rows, "seed int, j int, vocab_size bigint")

    def _of_group(self, value) -> Column:
        """Array over the seeds of a row's group, of ``value(place in the group, seed)``."""
        arrays = [F.array(*[value(i, seed) for i, seed in enumerate(group)]) for group in self.grid.groups]
        return arrays[0] if len(arrays) == 1 else F.get(F.array(*arrays), F.col("part"))

    def per_cell_columns(self, rows: DataFrame) -> DataFrame:
        """Rows ``(ctx, word, part, block, a0_0, b0_0, a0_1, ...)`` from rows with ``bins``, ``keep`` and ``swap``: the
        words in the environments, with a column for each seed of the group and each value of p of the block."""
        places, width = range(len(self.grid.groups[0])), range(min(BLOCK, len(self.grid.p_values)))
        block = F.explode(F.sequence(F.lit(0), F.lit(self.grid.n_blocks - 1))) if self.grid.n_blocks > 1 else F.lit(0)
        rows = rows.select("ctx", "word", "part", "keep", "swap", *[F.expr(self.grid.digit(i)).alias(f"d{i}") for i in places])
        sums = []
        for i in places:
            for r in width:
                j = f"{r} + block * {BLOCK}"
                sums.append(F.expr(f"sum(if(d{i} <= {j}, keep, 0)) AS a{i}_{r}"))
                sums.append(F.expr(f"sum(if(d{i} > {j}, swap, 0)) AS b{i}_{r}"))
        return rows.select("*", block.alias("block")).groupBy("ctx", "word", "part", "block").agg(*sums)

    def _per_value(self, counts: DataFrame) -> DataFrame:
        """Rows ``(seed, ctx, word, block, a0, b0, a1, b1, ...)`` of counts that were cut down."""
        width = range(min(BLOCK, len(self.grid.p_values)))
        # A word has few rows of bins, MOST_BINS at most, so they are dealt as they are and summed up once.
        wide = counts if self.grid.small else self.per_cell_columns(counts.repartition("ctx", "word", "part"))
        columns = lambda i: [F.col(f"{x}{i}_{r}").alias(f"{x}{r}") for r in width for x in "ab"]
        seeds = self._of_group(lambda i, seed: F.struct(F.lit(seed).alias("seed"), *columns(i)))
        return wide.select("ctx", "word", "block", F.inline(seeds))

    def _over_blocks(self, rows: DataFrame, keys: Sequence[str], arrays: Sequence[str]) -> DataFrame:
        """One row for the blocks of a key, their arrays one after the other."""
        if self.grid.n_blocks == 1:
            return rows.drop("block")
        gathered = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("block", *arrays))).alias("_all"))
        return gathered.select(*keys, *[F.flatten(F.col("_all")[c]).alias(c) for c in arrays])

    def cell_counts(self, counts: DataFrame) -> DataFrame:
        """Rows ``(seed, p_text, env, ctx, word, n)``, one for each cell and environment that has the word."""
        cells = self.word_bins(counts).withColumn("_c", F.explode(self.grid.p_literal()))
        sides = F.array(
            F.struct(F.lit(fixed.ENV_A).alias("env"), F.get("a", F.col("_c.j")).alias("n")),
            F.struct(F.lit(fixed.ENV_B).alias("env"), F.get("b", F.col("_c.j")).alias("n")),
        )
        return cells.select("seed", "_c.p_text", "ctx", "word", F.inline(sides)).where("n > 0")

    def word_bins(self, counts: DataFrame) -> DataFrame:
        """Rows ``(seed, ctx, word, a, b)``: arrays over p of the words in the environments."""
        width = range(min(BLOCK, len(self.grid.p_values)))
        sides = [F.array(*[f"{x}{r}" for r in width]).alias(x) for x in "ab"]
        rows = self._per_value(counts).select("seed", "ctx", "word", "block", *sides)
        return self._over_blocks(rows, ["seed", "ctx", "word"], ["a", "b"])

    def context_totals(self, contexts: DataFrame) -> DataFrame:
        """Per seed and context: arrays over p with the number of words, of distinct words, and for every smoothing
        value the sum of the geometric means of the smoothed counts."""
        here = self._per_value(self.counts.join(contexts.select("ctx").distinct(), "ctx", "left_semi"))
        width, ks = range(min(BLOCK, len(self.grid.p_values))), range(len(self.grid.alphas))
        sums = []
        for r in width:
            sums.append(F.expr(f"sum(a{r} + b{r}) AS n{r}"))
            sums.append(F.expr(f"count_if(a{r} + b{r} > 0) AS s{r}"))
            for k in ks:
                alpha = f"{float(self.grid.alphas[k])!r}D"
                mean = f"sqrt((a{r} + {alpha}) * (b{r} + {alpha}))"
                sums.append(F.expr(f"sum(if(a{r} + b{r} > 0, {mean}, 0D)) AS g{r}_{k}"))
        arrays = {"n_ctx": F.array(*[f"n{r}" for r in width]), "n_seen": F.array(*[f"s{r}" for r in width])}
        arrays |= {f"g{k}": F.array(*[f"g{r}_{k}" for r in width]) for k in ks}
        rows = here.groupBy("seed", "ctx", "block").agg(*sums)
        rows = rows.select("seed", "ctx", "block", *[v.alias(c) for c, v in arrays.items()])
        whole = self._over_blocks(rows, ["seed", "ctx"], list(arrays))
        return whole.select("seed", "ctx", "n_ctx", "n_seen", F.array(*[f"g{k}" for k in ks]).alias("g"))

    def word_counts(self, requests: DataFrame, *words: str) -> DataFrame:
        """Counts, as arrays over p, of the words that columns of the requests name after ``ctx``.

        The counts are cut down by a semi join first, so that a small table of requests is
        broadcast and the counts are not moved.
        """
        wanted = requests.select("ctx", F.explode(F.array(*words)).alias("word")).distinct()
        return self.word_bins(self.counts.join(wanted, ["ctx", "word"], "left_semi"))

    def per_seed(self, df: DataFrame) -> DataFrame:
        """Rows for every seed."""
        return df.withColumn("seed", F.explode(F.array(*[F.lit(s) for s in self.grid.seeds])))

    def per_cell(self, df: DataFrame) -> DataFrame:
        """Rows for every p, smoothing value and method, with the vocabulary size of the cell."""
        keep = df.columns
        cells = df.withColumn("_c", F.explode(self.grid.p_literal())).select(*keep, "_c.*")
        # One row per cell of the grid.
        sized = cells.join(F.broadcast(self.vocab_sizes()), ["seed", "j"])
        alphas = sized.withColumn("_a", F.explode(self.grid.alpha_literal())).select(*sized.columns, "_a.*")
        return alphas.withColumn("method", F.explode(F.array(*[F.lit(m) for m in self.grid.methods])))

    def probability(self, prefix: str) -> Column:
        """Probability of a word whose counts were joined under the prefix."""
        j = F.col("j")
        a = F.coalesce(F.get(f"{prefix}a", j), F.lit(0))
        b = F.coalesce(F.get(f"{prefix}b", j), F.lit(0))
        n_ctx = F.coalesce(F.get("n_ctx", j), F.lit(0))
        n_seen = F.coalesce(F.get("n_seen", j), F.lit(0))
        g = F.coalesce(F.get(F.get("g", F.col("k")), j), F.lit(0.0))
        alpha, size = F.col("alpha"), F.col("vocab_size")
        pooled = (a + b + alpha) / (n_ctx + alpha * size)
        # The totals of the environments cancel out between numerator and normaliser.
        mean = F.sqrt((a + alpha) * (b + alpha)) / (g + (size - n_seen) * alpha)
        return F.when(F.col("method") == fixed.METHODS[0], pooled).otherwise(mean)

    def score_words(self, requests: DataFrame) -> DataFrame:
        """Probability of ``word`` after ``ctx`` for distinct requests, in every cell."""
        joined = (
            self.per_seed(requests)
            .join(_named(self.word_counts(requests, "word"), "word", "w"), ["seed", "ctx", "word"], "left")
            .join(self.context_totals(requests), ["seed", "ctx"], "left")
        )
        scored = self.per_cell(joined).withColumn("prob", self.probability("w"))
        return scored.select(*requests.columns, *_CELL_COLUMNS, "prob")

    def score_items(self, items: DataFrame) -> DataFrame:
        """Bias of every distinct ``(ctx, target, opposite)`` in every cell."""
        found = self.word_counts(items, "target", "opposite")
        joined = (
            self.per_seed(items)
            .join(_named(found, "target", "t"), ["seed", "ctx", "target"], "left")
            .join(_named(found, "opposite", "o"), ["seed", "ctx", "opposite"], "left")
            .join(self.context_totals(items), ["seed", "ctx"], "left")
        )
        scored = (
            self.per_cell(joined)
            .withColumn("p1", self.probability("t"))
            .withColumn("p2", self.probability("o"))
            .withColumn("p", pair_probability(F.col("p1"), F.col("p2")))
            .where(F.col("p").isNotNull())
            .withColumn("bias", entropy_bias(F.col("p")))
        )
        return scored.select(*items.columns, *_CELL_COLUMNS, "p1", "p2", "bias")


def _bin(draw: Column, borders: Sequence[str]) -> Column:
    """Bin of a draw: the number of borders that are not above it."""
    inside = [F.when(draw >= float(p), 1).otherwise(0) for p in borders]
    return sum(inside[1:], inside[0])


def _named(counts: DataFrame, word: str, prefix: str) -> DataFrame:
    return counts.select(
        "seed", "ctx", F.col("word").alias(word), F.col("a").alias(f"{prefix}a"), F.col("b").alias(f"{prefix}b")
    )


def fit_grid(
    train_lines: DataFrame,
    dictionary: TermDictionary,
    grid: Grid | None = None,
    context: str = "left",
    asked: DataFrame | None = None,
) -> GridModel:
    """Count the words of all cells in one pass and write the counts as a table.

    The model scores every context, or, with ``asked``, those of this table; see ``cloze.fold_contexts``.
    Only lines with a term have a second, swapped, stream of words; in all other lines one row counts for both
    environments. A stream that counts in no cell is not taken apart into words.
    """
    grid = grid or Grid()
    last = len(grid.p_values)
    groups = [F.struct(F.lit(k).alias("part"), grid.group_bins(g).alias("bins")) for k, g in enumerate(grid.groups)]
    # The highest bin of all seeds is 0, or the lowest the last one, where a stream counts in no cell.
    draws = [line_draw(seed) for seed in grid.seeds]
    least, most = (F.least(*draws), F.greatest(*draws)) if len(draws) > 1 else (draws[0], draws[0])
    drawn = train_lines.select(F.array(*groups).alias("groups"), least.alias("least"), most.alias("most"), "line")
    some_a, some_b = F.col("least") < float(grid.borders[-1]), F.col("most") >= float(grid.borders[0])
    prepared = drawn.withColumn("swaps", some_b & dictionary.has_token(F.col("line"))).select(
        "groups",
        "swaps",
        F.when(some_a | ~F.col("swaps"), text.words(F.col("line"))).alias("plain"),
        F.when(F.col("swaps"), text.words(dictionary.swap_line(F.col("line")))).alias("swapped"),
    )

    def stream(keep: int, swap: int, column: str) -> Column:
        return F.struct(F.lit(keep).alias("keep"), F.lit(swap).alias("swap"), F.col(column).alias("words"))

    streams = prepared.select(
        "groups",
        F.inline(
            F.when(F.col("swaps"), F.array(stream(1, 0, "plain"), stream(0, 1, "swapped"))).otherwise(
                F.array(stream(1, 1, "plain"))
            )
        ),
    ).where(F.col("words").isNotNull())
    pairs = cloze.fold_contexts(cloze.explode_pairs(streams, "words", ["groups", "keep", "swap"], context), asked)
    rows = pairs.select("ctx", "word", F.inline("groups"), "keep", "swap")
    model = GridModel(grid, dictionary, rows, context)
    if grid.small:
        counts = model.per_cell_columns(rows)
    else:
        sums = [F.sum(c).alias(c) for c in ("keep", "swap")]
        counts = rows.groupBy("ctx", "word", "part", "bins").agg(*sums)
    model = replace(model, counts=stage(counts, "counts"))
    return replace(model, sizes=model.count_vocabulary())


def grid_items(model: GridModel, test_lines: DataFrame) -> DataFrame:
    """Lines with exactly one term, with target, opposite and context."""
    return cloze.cell_items(test_lines, model.dictionary, model.context)


def grid_line_bias(model: GridModel, test_lines: DataFrame) -> DataFrame:
    """Bias of every scored line in every cell. Scores are computed per distinct item and joined back."""
    items = stage(grid_items(model, test_lines), "items")
    scored = model.score_items(cloze.distinct_items(items))
    return items.join(scored, ["ctx", "target", "opposite"]).select(
        "doc_id", "line_no", "target", "opposite", "ctx", *_CELL_COLUMNS, "p1", "p2", "bias"
    )


def grid_summary(model: GridModel, test_lines: DataFrame) -> DataFrame:
    """Lines, mean and sample deviation of the bias per (p, alpha, method), over seeds.

    Distinct items carry their number of lines as weight, so the lines are not fanned out over the
    cells. The squares are taken around the mean, which is known first, so no digits are lost.
    """
    items = stage(cloze.distinct_items(grid_items(model, test_lines)), "items")
    keys = ["p_env_a", "alpha", "method"]
    scored = stage(model.score_items(items).select(*keys, "n_lines", "bias"), "scored")
    n, bias, mean = F.col("n_lines"), F.col("bias"), F.col("mean_bias")
    means = scored.groupBy(*keys).agg(F.sum(n).alias("n_scored"), (F.sum(n * bias) / F.sum(n)).alias("mean_bias"))
    # One row per cell of the grid.
    apart = scored.join(F.broadcast(means), keys).groupBy(*keys, "n_scored", "mean_bias")
    squares = apart.agg(F.sum(n * (bias - mean) * (bias - mean)).alias("_q"))
    deviation = F.when(F.col("n_scored") > 1, F.sqrt(F.col("_q") / (F.col("n_scored") - 1)))
    return squares.select(*keys, "n_scored", "mean_bias", deviation.alias("std_bias"))
