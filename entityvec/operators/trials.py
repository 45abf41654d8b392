"""Experiment tables: best trial, merged settings, early stopping, epoch means."""

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from entityvec.functions.scratch import written

# Default pattern, metric and settings that a trial passes on.
TRIAL_PATTERN = ".*-trial-.*"
TRIAL_METRIC = "val/retrieval_recall@100"
HYPERPARAMETERS = (
    "learning_rate", "weight_decay", "margin", "dropout", "use_residual", "use_layer_norm",
    "loss_distance", "hidden_dim", "num_hidden_layers", "hidden_dim_multiplier", "activation",
    "batch_size", "ucb_exploration_constant", "ucb_warmup_samples",
    "retrieval_metric_max_queries",
)


def _entry(pairs: Column, key: str) -> Column:
    return F.try_element_at(pairs, F.lit(key))


def metric_value(metrics: Column, name: str) -> Column:
    """Metric under its name, else under the short name; unusable values count as -inf."""
    def number(key: str) -> Column:
        v = F.trim(_entry(metrics, key))
        return F.nanvl(F.coalesce(v.try_cast("double"), F.lit(-math.inf)), F.lit(-math.inf))

    short = name.replace("val/", "")
    out = F.lit(-math.inf)
    for key in (short, name):
        out = F.when(F.coalesce(F.map_contains_key(metrics, key), F.lit(False)), number(key)) \
            .otherwise(out)
    return out


def best_trial(trials: DataFrame, name_pattern: str = TRIAL_PATTERN,
               metric: str = TRIAL_METRIC, check: bool = True) -> DataFrame:
    """The matching trial with the highest metric, as one row with ``metric_value``.

    Equal metrics go to the smaller name. With ``check`` a best value that is not finite,
    or no matching trial, is an error.
    """
    ranked = (trials.filter(F.col("name").rlike(name_pattern))
              .withColumn("metric_value", metric_value(F.col("metrics"), metric)))
    best = ranked.orderBy(F.col("metric_value").desc(), "name").limit(1)
    if check:
        row = best.select("name", "metric_value").first()
        if row is None:
            raise ValueError(f"no trial matches {name_pattern}")
        if not math.isfinite(row["metric_value"]):
            raise ValueError(f"trial {row['name']} has no usable value of {metric}")
    return best


def trial_objectives(trials: DataFrame) -> DataFrame:
    """(name, recall, loss) of the trials with a finite recall@100."""
    def number(*keys: str) -> Column:
        out = F.lit(math.inf)
        for key in reversed(keys):
            out = F.when(F.map_contains_key("metrics", key),
                         _entry(F.col("metrics"), key).try_cast("double")).otherwise(out)
        return out

    recall = number("retrieval_recall@100")
    usable = recall.isNotNull() & ~F.isnan(recall) & (F.abs(recall) < math.inf)
    return trials.filter(usable).select(
        "name", recall.alias("recall"), number("best_val_loss", "val_loss").alias("loss"))


def _wraps_value(text: Column) -> Column:
    """Whether the text is a JSON object with a field ``value``, null or not."""
    return F.coalesce(F.array_contains(F.json_object_keys(text), "value"), F.lit(False))


def merge_hyperparameters(trials: DataFrame, base: Mapping[str, object],
                          keys: Sequence[str] = HYPERPARAMETERS,
                          config: str = "config") -> DataFrame:
    """One column per key: the trial's setting, unwrapped from ``{"value": ...}``, or the base.

    A wrapped null is null, not the text that wraps it.
    """
    def setting(key: str) -> Column:
        own = _entry(F.col(config), key)
        default = base.get(key)
        fallback = F.lit(None if default is None else str(default)).cast("string")
        return F.when(F.coalesce(F.map_contains_key(config, key), F.lit(False)),
                      F.when(_wraps_value(own), F.get_json_object(own, "$.value")).otherwise(own)).otherwise(fallback)

    others = [c for c in trials.columns if c != config]
    return trials.select(*others, *[setting(k).alias(k) for k in keys])


def early_stop(history: DataFrame, patience: int = 0, run: str = "run", epoch: str = "epoch",
               loss: str = "val_loss", chunk: int = 10_000) -> DataFrame:
    """Per run: best epoch and loss, and the epoch at which training stops.

    Only a strictly lower loss is an improvement. Training stops at the first validation
    that is the ``patience``-th in a row without one (0: never).

    A long run is cut into chunks of epochs: what earlier chunks contribute (lowest loss, row
    count, last improvement) is joined in, so no task needs a whole run.
    """
    value = F.col(loss).cast("double")
    rows = written(history.select(
        run, epoch, F.nanvl(F.coalesce(value, F.lit(math.inf)), F.lit(math.inf)).alias("_loss"),
        F.floor(F.col(epoch) / chunk).cast("bigint").alias("_chunk")), "history")
    keys = [run, "_chunk"]
    earlier = Window.partitionBy(run).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    here = Window.partitionBy(*keys).orderBy(epoch)
    so_far = here.rowsBetween(Window.unboundedPreceding, 0)

    totals = rows.groupBy(*keys).agg(F.min("_loss").alias("m"), F.count(F.lit(1)).alias("n"))
    totals = totals.select(*keys, F.min("m").over(earlier).alias("_m"),
                           F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_n"))
    best = F.least("_m", F.min("_loss").over(here.rowsBetween(Window.unboundedPreceding, -1)))
    rows = (rows.join(totals, keys)
            .withColumn("_better", F.col("_loss") < F.coalesce(best, F.lit(math.inf)))
            .withColumn("_seq", F.col("_n") + F.row_number().over(here)))
    mark = F.when(F.col("_better"), F.struct(
        F.col("_seq").alias("seq"), F.col(epoch).alias("epoch"), F.col("_loss").alias("loss")))
    rows = rows.select(*keys, epoch, "_seq", "_better", mark.alias("_mark"))

    marks = rows.groupBy(*keys).agg(F.max("_mark").alias("m"))
    marks = marks.select(*keys, F.max("m").over(earlier).alias("_before"))
    last = F.coalesce(F.max("_mark").over(so_far), F.col("_before"))
    rows = rows.join(marks, keys).withColumn("_last", last)
    waited = F.col("_seq") - F.coalesce("_last.seq", F.lit(0))
    state = F.struct(F.col(epoch).alias("at"), F.col("_seq").alias("seq"), F.col("_last").alias("best"))
    stops = F.lit(patience > 0) & ~F.col("_better") & (waited >= patience)
    ends = rows.groupBy(run).agg(F.min(F.when(stops, state)).alias("stop"), F.max(state).alias("end"))
    final = F.coalesce("stop", "end")
    return ends.select(
        run, final["best"]["epoch"].alias("best_epoch"),
        F.coalesce(final["best"]["loss"], F.lit(math.inf)).alias("best_val_loss"),
        F.col("stop.at").alias("stop_epoch"), F.col("stop").isNotNull().alias("early_stopped"),
        final["seq"].alias("epochs_completed"))


def epoch_summary(batches: DataFrame, epochs: DataFrame | None = None, epoch: str = "epoch",
                  loss: str = "loss") -> DataFrame:
    """Mean batch loss per epoch; listed epochs without a batch are infinite."""
    means = batches.groupBy(epoch).agg(F.avg(loss).alias("mean_loss"),
                                       F.count(F.lit(1)).alias("batches"))
    if epochs is None:
        return means
    return epochs.select(epoch).distinct().join(means, epoch, "left").select(
        epoch, F.coalesce("mean_loss", F.lit(math.inf)).alias("mean_loss"),
        F.coalesce("batches", F.lit(0)).alias("batches"))
