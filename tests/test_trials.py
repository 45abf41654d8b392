import math

import pytest

from entityvec.operators import trials

SCHEMA = "name string, config map<string,string>, metrics map<string,string>"
M = "val/retrieval_recall@100"


def frame(spark, *rows):
    return spark.createDataFrame([(n, c, m) for n, c, m in rows], SCHEMA)


def test_best_trial(spark):
    df = frame(
        spark, ("a-trial-1", {}, {M: "0.5"}), ("a-trial-2", {}, {"retrieval_recall@100": "0.7"}),
        ("other", {}, {M: "0.99"}), ("a-trial-3", {}, {M: "n/a", "retrieval_recall@100": "0.9"}),
        ("a-trial-4", {}, {M: "nan"}), ("a-trial-5", {}, {}), ("a-trial-6", {}, None), ("a-trial-0", {}, {M: "0.7"}))
    assert trials.best_trial(df).first().name == "a-trial-0"
    with pytest.raises(ValueError, match="usable"):
        trials.best_trial(df.filter("name in ('a-trial-3', 'a-trial-4', 'a-trial-5')"))
    with pytest.raises(ValueError, match="no trial"):
        trials.best_trial(df, "zzz")


def test_objectives(spark):
    df = frame(spark, ("a", {}, {"retrieval_recall@100": "0.5", "best_val_loss": "1", "val_loss": "2"}),
               ("b", {}, {"retrieval_recall@100": "0.5", "val_loss": "2"}),
               ("c", {}, {"retrieval_recall@100": "0.5"}), ("d", {}, {"retrieval_recall@100": "nan"}), ("e", {}, {}))
    got = {r.name: (r.recall, r.loss) for r in trials.trial_objectives(df).collect()}
    assert got == {"a": (0.5, 1.0), "b": (0.5, 2.0), "c": (0.5, math.inf)}


def test_merge(spark):
    df = frame(spark, ("a", {"margin": '{"value": 0.3}', "dropout": "0.2", "batch_size": None}, {}), ("b", None, {}))
    rows = {r.name: r for r in trials.merge_hyperparameters(df, {"margin": 0.5, "hidden_dim": 512}).collect()}
    assert (rows["a"].margin, rows["a"].dropout, rows["a"].hidden_dim, rows["a"].batch_size) == ("0.3", "0.2", "512", None)
    assert (rows["b"].margin, rows["b"].dropout) == ("0.5", None)
    assert len(rows["a"].asDict()) == 2 + len(trials.HYPERPARAMETERS)


def test_wrapped_null_setting_is_null(spark):
    df = spark.createDataFrame([("a", {"margin": '{"value": null}', "dropout": '{"other": 1}'})], "name string, config map<string,string>")
    row = trials.merge_hyperparameters(df, {"margin": 0.5}).first()
    assert (row.margin, row.dropout) == (None, '{"other": 1}')


def by_hand(losses, patience):
    best, best_epoch, waited = math.inf, None, 0
    for e, loss in enumerate(losses, 1):
        if loss < best:
            best, best_epoch, waited = loss, e, 0
        else:
            waited += 1
            if patience > 0 and waited >= patience:
                return best_epoch, best, e, True, e
    return best_epoch, best, None, False, len(losses)


@pytest.mark.parametrize("chunk", [2, 10_000])
@pytest.mark.parametrize("patience", [0, 1, 3])
def test_early_stop(spark, chunk, patience):
    runs = {
        "falls": [5, 4, 3, 2, 1], "flat": [3, 3, 3, 3, 3, 3], "late": [5, 6, 7, 4, 8, 9, 9, 1],
        "nan": [math.nan, 2.0, math.nan, 1.0, math.nan, math.nan, math.nan, 0.5], "never": [math.nan] * 4,
        "inf": [math.inf, math.inf, 1.0]}
    rows = [(r, e, float(x)) for r, xs in runs.items() for e, x in enumerate(xs, 1)]
    df = spark.createDataFrame(rows, "run string, epoch int, val_loss double")
    got = {r[0]: (r.best_epoch, r.best_val_loss, r.stop_epoch, r.early_stopped, r.epochs_completed)
           for r in trials.early_stop(df, patience, chunk=chunk).collect()}
    assert got == {r: by_hand(xs, patience) for r, xs in runs.items()}


def test_epochs(spark):
    df = spark.createDataFrame([(1, 2.0), (1, 4.0)], "epoch int, loss double")
    assert [tuple(r) for r in trials.epoch_summary(df).collect()] == [(1, 3.0, 2)]
    both = trials.epoch_summary(df, spark.createDataFrame([(1,), (2,)], "epoch int"))
    assert {r.epoch: r.mean_loss for r in both.collect()} == {1: 3.0, 2: math.inf}
