"""Random assignment of lines to environments, and operators over environments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from counterfact import fixed
from counterfact.functions.draws import draw_below, unit_draw
from counterfact.operators.dictionary import TermDictionary


def line_draw(seed: int | Column) -> Column:
    """Draw of a line; it does not depend on p, so environment A grows with p."""
    return unit_draw(seed, F.col("doc_id"), F.col("line_no"))


def env_assign(lines: DataFrame, dictionary: TermDictionary, seed: int, p_env_a: float) -> DataFrame:
    """Lines of environment A unchanged, all others swapped in environment B."""
    in_a = F.col("env") == fixed.ENV_A
    return lines.withColumn("env", line_env(seed, p_env_a)).withColumn(
        "line", F.when(in_a, F.col("line")).otherwise(dictionary.swap_line(F.col("line")))
    )


def line_env(seed: int, p_env_a: float) -> Column:
    """Environment of a line."""
    in_a = draw_below(p_env_a, seed, F.col("doc_id"), F.col("line_no"))
    return F.when(in_a, fixed.ENV_A).otherwise(fixed.ENV_B)


def grid_cells(seeds: Sequence[int], p_values: Sequence[str]) -> Column:
    """Array of the (seed, p) cells, for ``explode``; p is kept as text and as number."""
    return F.array(
        *[
            F.struct(F.lit(s).alias("seed"), F.lit(p).alias("p_text"), F.lit(float(p)).alias("p_env_a"))
            for s in seeds
            for p in p_values
        ]
    )


def grid_assign(
    lines: DataFrame, dictionary: TermDictionary, seeds: Sequence[int], p_values: Sequence[str], side: str | None = None
) -> DataFrame:
    """Environment lines of every (seed, p) cell; swaps once per line, before the fan-out. With ``side``, those of
    this environment alone."""
    # Nothing is swapped in environment A.
    swapped = lines.withColumn(
        "swapped", F.col("line") if side == fixed.ENV_A else dictionary.swap_line(F.col("line"))
    )
    per_seed = swapped.select(
        "*", F.explode(F.array(*[F.struct(F.lit(s).alias("seed"), line_draw(s).alias("u")) for s in seeds])).alias("d")
    ).select("doc_id", "line_no", "line", "swapped", "d.seed", "d.u")
    p_cells = F.array(*[F.struct(F.lit(p).alias("p_text"), F.lit(float(p)).alias("p_env_a")) for p in p_values])
    per_cell = per_seed.withColumn("c", F.explode(p_cells)).withColumn("in_a", F.col("u") < F.col("c.p_env_a"))
    if side is not None:
        per_cell = per_cell.where(F.col("in_a") if side == fixed.ENV_A else ~F.col("in_a"))
    return per_cell.select(
        "seed",
        "c.p_text",
        "c.p_env_a",
        F.when(F.col("in_a"), fixed.ENV_A).otherwise(fixed.ENV_B).alias("env"),
        "doc_id",
        "line_no",
        F.when(F.col("in_a"), F.col("line")).otherwise(F.col("swapped")).alias("line"),
    )


def nested_streams(
    lines: DataFrame, dictionary: TermDictionary, seeds: Sequence[int], p_values: Sequence[str]
) -> DataFrame:
    """Rows ``(seed, from_p, side, doc_id, line_no, line)`` that hold the environments of every (seed, p) cell.

    Environment A grows with p, so a line is in A from one value of p on, ``from_p``, and swapped in B before it;
    a line that no value reaches has ``inf``. A line is stored once a seed as it is (``keep``) and once swapped
    (``swap``), or once for ``both`` where swapping changes nothing, and not once for every p.
    """
    borders = sorted(p_values, key=float)
    swapped = lines.withColumn("swapped", dictionary.swap_line(F.col("line")))

    def reached(seed: int) -> Column:
        u = line_draw(seed)
        return F.coalesce(*[F.when(u < float(p), F.lit(p)) for p in borders], F.lit("inf"))

    drawn = F.array(*[F.struct(F.lit(s).alias("seed"), reached(s).alias("from_p")) for s in seeds])
    per_seed = swapped.select("doc_id", "line_no", "line", "swapped", F.inline(drawn))
    stream = lambda side, text: F.struct(F.lit(side).alias("side"), F.col(text).alias("line"))
    in_a, in_b = F.col("from_p") != "inf", F.col("from_p") != borders[0]
    sides = F.when(F.col("line") == F.col("swapped"), F.array(stream("both", "line"))).otherwise(
        F.concat(
            F.when(in_a, F.array(stream("keep", "line"))).otherwise(F.array()),
            F.when(in_b, F.array(stream("swap", "swapped"))).otherwise(F.array()),
        )
    )
    return per_seed.select("seed", "from_p", "doc_id", "line_no", F.inline(sides))


def cell_of_streams(streams: DataFrame, p: str) -> DataFrame:
    """Environment lines of the cells of one p, out of ``nested_streams``; partitions are pruned where these are
    stored by ``from_p`` and ``side``."""
    in_a = F.col("from_p").cast("double") <= float(p)
    here = streams.where((in_a & F.col("side").isin("keep", "both")) | (~in_a & F.col("side").isin("swap", "both")))
    env = F.when(in_a, fixed.ENV_A).otherwise(fixed.ENV_B).alias("env")
    return here.select("seed", env, "doc_id", "line_no", "line")


def stream_sizes(streams: DataFrame, p_values: Sequence[str]) -> DataFrame:
    """Lines and characters ``(seed, p_env_a, env, n_lines, n_chars)`` of all cells, in one pass over the streams."""
    sums = streams.groupBy("seed", "from_p", "side").agg(
        F.count(F.lit(1)).alias("n_lines"), F.sum(F.length("line")).alias("n_chars")
    )
    cells = sums.withColumn("p_env_a", F.explode(F.array(*[F.lit(float(p)) for p in p_values])))
    in_a = F.col("from_p").cast("double") <= F.col("p_env_a")
    here = cells.where((in_a & F.col("side").isin("keep", "both")) | (~in_a & F.col("side").isin("swap", "both")))
    env = F.when(in_a, fixed.ENV_A).otherwise(fixed.ENV_B).alias("env")
    return here.groupBy("seed", "p_env_a", env).agg(F.sum("n_lines").alias("n_lines"), F.sum("n_chars").alias("n_chars"))


def grid_sizes(lines: DataFrame, seeds: Sequence[int], p_values: Sequence[str]) -> DataFrame:
    """Lines of environments A and B in every (seed, p) cell, without a fan-out of the lines."""
    draws = lines.select(*[line_draw(s).alias(f"u{i}") for i, s in enumerate(seeds)])
    sums = [F.count(F.lit(1)).alias("n_lines")]
    structs = []
    for i, s in enumerate(seeds):
        for j, p in enumerate(p_values):
            sums.append(F.count_if(F.col(f"u{i}") < float(p)).alias(f"a{i}_{j}"))
            structs.append(
                F.struct(
                    F.lit(s).alias("seed"),
                    F.lit(p).alias("p_text"),
                    F.lit(float(p)).alias("p_env_a"),
                    F.col(f"a{i}_{j}").alias("n_a"),
                    (F.col("n_lines") - F.col(f"a{i}_{j}")).alias("n_b"),
                )
            )
    return draws.agg(*sums).select(F.inline(F.array(*structs)))


def experiment_grid(
    cells: DataFrame, alphas: Sequence[str] = fixed.ALPHAS, methods: Sequence[str] = fixed.METHODS
) -> DataFrame:
    """Every cell with every smoothing value and method."""
    alpha = F.array(*[F.struct(F.lit(a).alias("alpha_text"), F.lit(float(a)).alias("alpha")) for a in alphas])
    return (
        cells.withColumn("a", F.explode(alpha))
        .select(*cells.columns, "a.alpha_text", "a.alpha")
        .withColumn("method", F.explode(F.array(*[F.lit(m) for m in methods])))
    )


def pooled_train(env_lines: DataFrame) -> DataFrame:
    """All lines of all environments under the pooled name, duplicates kept. The columns stay, and ``part``
    tells the environment a line comes from: in order of ``part``, one environment follows the other."""
    pooled = env_lines.withColumn("part", F.col("env"))
    return pooled.withColumn("env", F.lit(fixed.POOLED_ENV))


def env_list(env_lines: DataFrame, pooled: bool = False) -> DataFrame:
    """Distinct environment names in order of name; a stand-in name when there is none."""
    names = env_lines.select("env").distinct()
    if not pooled:
        names = names.where(F.col("env") != fixed.POOLED_ENV)
    stand_in = names.agg(F.count("env").alias("_n")).where("_n = 0").select(F.lit(fixed.NO_ENV).alias("env"))
    return names.where(F.col("env").isNotNull()).unionByName(stand_in).orderBy("env")


def env_names(env_lines: DataFrame) -> list[str]:
    """Environment names on the driver, for tables with a column for each of them."""
    return sorted(row.env for row in env_lines.select("env").distinct().collect())


def env_sizes(env_lines: DataFrame, envs: Sequence[str] = ()) -> DataFrame:
    """Examples per environment; named environments without examples get 0."""
    sizes = env_lines.groupBy("env").agg(F.count(F.lit(1)).alias("n"))
    if not envs:
        return sizes
    names = F.broadcast(env_lines.sparkSession.createDataFrame([(e,) for e in envs], "env string"))
    return names.join(sizes, "env", "left").select("env", F.coalesce("n", F.lit(0)).alias("n"))


def size_summary(sizes: DataFrame) -> DataFrame:
    """One row: smallest non-empty size, number of environments, number of all examples."""
    return sizes.agg(
        F.min(F.when(F.col("n") > 0, F.col("n"))).alias("min_size"),
        F.count(F.lit(1)).alias("n_env"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_examples"),
    )
