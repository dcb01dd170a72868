import math
import random

import pytest

from counterfact.operators import runlog
from counterfact.plans import summary


@pytest.fixture(scope="module")
def log(spark):
    rng = random.Random(5)
    rows = [("r", s // 40, s // 4, s, "AB"[s % 2], rng.random()) for s in range(1, 200)]
    return spark.createDataFrame(rows, "run string, epoch int, round int, step bigint, env string, loss double")


@pytest.mark.parametrize("stretch", [7, 10_000])
def test_running_loss_and_best(log, monkeypatch, stretch):
    monkeypatch.setattr(runlog, "STRETCH", stretch)
    rows = sorted(log.collect(), key=lambda r: r.step)
    sums, want, best, low = {}, {}, set(), math.inf
    for r in rows:
        s, n = sums.get(r.epoch, (0.0, 0))
        sums[r.epoch] = (s + r.loss, n + 1)
        want[r.step] = (s + r.loss) / (n + 1)
        if r.loss < low:
            best.add(r.step)
            low = r.loss
    got = {r.step: r.running_loss for r in runlog.running_epoch_loss(log).collect()}
    assert got == pytest.approx(want)
    assert {r.step for r in runlog.improvements(log).collect()} == best
    assert runlog.best_checkpoint(log).first().step == max(best)


def test_ties_of_a_step_have_one_answer(spark):
    """Whatever the order of the rows."""
    rng = random.Random(6)
    rows = [("r", 0, s // 5, rng.randrange(9) / 4) for s in range(300)]
    found = set()
    for k in (1, 2, 7):
        rng.shuffle(rows)
        log = spark.createDataFrame(rows, "run string, epoch int, step bigint, loss double").repartition(k)
        running = sorted((r.step, r.loss, round(r.running_loss, 9)) for r in runlog.running_epoch_loss(log).collect())
        better = sorted((r.step, r.loss) for r in runlog.improvements(log).collect())
        found.add((tuple(running), tuple(better), tuple(runlog.best_checkpoint(log).first())))
    assert len(found) == 1
    running, better, _ = found.pop()
    means, total = [], 0.0
    for n, (_, loss, _) in enumerate(running, 1):
        total += loss
        means.append(total / n)
    assert sorted(m for _, _, m in running) == pytest.approx(sorted(means))
    assert len({s for s, _ in better}) == len(better)


def test_best_checkpoint_example(spark):
    rows = [("r", i + 1, x) for i, x in enumerate([3.0, 2.5, 2.5, 2.7, 2.4])] + [("r", 6, None)]
    evals = spark.createDataFrame(rows, "run string, step bigint, loss double")
    assert sorted(r.step for r in runlog.improvements(evals).collect()) == [1, 2, 5]
    assert runlog.best_checkpoint(evals).first().step == 5


def test_losses(spark):
    rows = [(1, 0, "A", 1.0), (1, 0, "A", 2.0), (1, 1, "B", None), (2, 2, "A", 4.0)]
    log = spark.createDataFrame(rows, "epoch int, round int, env string, loss double")
    found = runlog.epoch_env_loss(log, ["A", "B", "C"]).collect()
    assert {(r.epoch, r.env): (r.avg_loss, r.n_updates) for r in found} == {
        (1, "A"): (1.5, 2), (1, "B"): (None, 0), (1, "C"): (None, 0),
        (2, "A"): (4.0, 1), (2, "B"): (None, 0), (2, "C"): (None, 0),
    }
    assert {r["round"]: r.avg_loss for r in runlog.round_loss(log).collect()} == {0: 1.5, 1: 0.0, 2: 4.0}
    rounds = spark.createDataFrame([(1, 0), (1, 1), (2, 2), (2, 3)], "epoch int, round int")
    assert {r["round"]: r.avg_loss for r in runlog.round_loss(log, rounds).collect()} == {0: 1.5, 1: 0.0, 2: 4.0, 3: 0.0}
    wide = {r.epoch: (r.A, r.B) for r in runlog.loss_history(log, ["A", "B"]).collect()}
    assert wide == {2: (1.5, None), 3: (4.0, None)}


def test_round_log(spark):
    rows = [("r", 0, k // 3, k + 1, float(k)) for k in range(20)]  # the last round is cut after two steps
    log = spark.createDataFrame(rows, "run string, epoch int, round int, step bigint, loss double")
    val = spark.createDataFrame([("r", 20, 1.0)], "run string, global_step bigint, val_loss double")
    got = {r.global_step: (r.epoch, r.train_loss, r.val_loss) for r in runlog.round_log(log, val, 4).collect()}
    assert got == {12: (1, 10.0, None), 20: (1, 18.5, 1.0)}


def test_batch_means_are_not_weighted(spark):
    rows = [(0, 1.0), (0, 3.0), (1, 5.0)]
    row = runlog.batch_mean_loss(spark.createDataFrame(rows, "batch int, loss double")).first()
    assert (row.eval_loss, row.token_loss, row.n_batches) == (3.5, 3.0, 2)
    empty = runlog.batch_mean_loss(spark.createDataFrame([], "batch int, loss double")).first()
    assert (empty.eval_loss, empty.token_loss, empty.n_batches) == (0.0, 0.0, 0)


def test_bias_summary(spark):
    rows = [(0.1, "1", "eLM", 0.0), (0.1, "1", "eLM", 1.0), (0.1, "1", "eLM", math.nan), (0.5, "1", "eLM", 0.25)]
    table = summary.bias_summary(spark.createDataFrame(rows, "p_env_a double, lr string, method string, bias double"))
    got = {r.p_env_a: (r.n_scored, r.mean_bias, r.std_bias) for r in table.collect()}
    assert got[0.1] == pytest.approx((2, 0.5, 0.7071067811865476))
    assert got[0.5] == (1, 0.25, None)
    series = summary.plot_series(table).first().series
    assert [p.p_env_a for p in series] == [0.1, 0.5]


def test_cells(spark):
    cells = spark.createDataFrame([(0,), (1,), (2,)], "seed int")
    done = spark.createDataFrame([(1,), (1,)], "seed int")
    assert {r.seed for r in summary.missing_cells(cells, done, ["seed"]).collect()} == {0, 2}
    assert {r.seed for r in summary.pending_runs(cells, done, ["seed"]).collect()} == {0, 2}
