"""Batched vector models run as Arrow UDFs: injected backbones and the MLP projector."""

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from entityvec.functions.shipping import ship, unpack

VectorFn = Callable[[Sequence], object]


def pool_output(output, pooling: str = "cls_token") -> np.ndarray:
    """Model output to one vector per input.

    A mapping may hold ``pooler_output`` (n, d) and ``last_hidden_state`` (n, tokens, d).
    ``pooler_output`` is used if asked for and present; otherwise the first token, then
    the pooled output, then the first output.
    """
    if isinstance(output, np.ndarray):
        return output.astype(np.float32)
    if isinstance(output, (list, tuple)):
        return np.asarray(output[0], dtype=np.float32)
    pooled, hidden = output.get("pooler_output"), output.get("last_hidden_state")
    if pooling == "pooler_output" and pooled is not None:
        chosen = pooled
    elif hidden is not None:
        chosen = np.asarray(hidden)[:, 0]
    elif pooled is not None:
        chosen = pooled
    else:
        chosen = next(iter(output.values()))
    return np.asarray(chosen, dtype=np.float32)


def vectorizer(load: Callable[[], VectorFn], batch_size: int = 16,
               pooling: str = "cls_token"):
    """Iterator pandas UDF; ``load`` runs once per task, the model sees ``batch_size`` inputs."""

    @F.pandas_udf("array<float>")
    def run(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for s in series:
            out = []
            for i in range(0, len(s), batch_size):
                out.extend(pool_output(model(s.iloc[i:i + batch_size].tolist()), pooling))
            yield pd.Series(out, dtype=object)

    # Keeps the optimizer from running a model a second time for a filter on its output.
    return run.asNondeterministic()


def apply_vectorizer(df: DataFrame, load: Callable[[], VectorFn], source: str,
                     output: str = "embedding", batch_size: int = 16,
                     pooling: str = "cls_token") -> DataFrame:
    return df.withColumn(output, vectorizer(load, batch_size, pooling)(F.col(source)))


def attempted_vectors(df: DataFrame, load: Callable[[], VectorFn], source: str, batch_size: int = 16,
                      pooling: str = "cls_token") -> DataFrame:
    """Add ``embedding`` and ``error``; where a batch fails, its inputs are tried one by one."""

    @F.pandas_udf("embedding array<float>, error string")
    def run(series: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = load()

        def made(inputs: list) -> list[tuple]:
            try:
                return [(v, None) for v in pool_output(model(inputs), pooling)]
            except Exception as e:
                if len(inputs) == 1:
                    return [(None, f"{type(e).__name__}: {e}")]
                return [row for x in inputs for row in made([x])]

        for s in series:
            rows = [row for i in range(0, len(s), batch_size) for row in made(s.iloc[i:i + batch_size].tolist())]
            yield pd.DataFrame(rows, columns=["embedding", "error"])

    out = df.withColumn("_made", run.asNondeterministic()(F.col(source)))
    return out.select(*df.columns, "_made.embedding", "_made.error")


@dataclass(frozen=True)
class Norm:
    scale: np.ndarray
    shift: np.ndarray

    def __call__(self, x: np.ndarray, eps: float = 1e-5) -> np.ndarray:
        centred = x - x.mean(1, keepdims=True)
        return centred / np.sqrt((centred**2).mean(1, keepdims=True) + eps) * self.scale + self.shift


@dataclass(frozen=True)
class Projector:
    """Weights of the projector; a linear part is (matrix out x in, bias)."""

    input: tuple[np.ndarray, np.ndarray]
    output: tuple[np.ndarray, np.ndarray]
    hidden: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)
    residual: tuple[np.ndarray, np.ndarray] | None = None
    input_norm: Norm | None = None
    hidden_norms: list[Norm] = field(default_factory=list)
    output_norm: Norm | None = None
    activation: str = "gelu"

    def __post_init__(self):
        activate(np.zeros((1, 1)), self.activation)
        if self.hidden_norms and len(self.hidden_norms) != len(self.hidden):
            raise ValueError("one norm per hidden layer is needed")


def hidden_widths(base: int, layers: int, multiplier: float) -> list[int]:
    """Widths of the hidden layers; each is the rounded multiple of the one before, >= 16."""
    widths = [base]
    while len(widths) < layers:
        widths.append(max(16, int(round(widths[-1] * multiplier))))
    return widths[:layers]


def activate(x: np.ndarray, kind: str) -> np.ndarray:
    if kind == "relu":
        return np.maximum(x, 0.0)
    if kind == "silu":
        return x / (1.0 + np.exp(-x))
    if kind == "gelu":
        return 0.5 * x * (1.0 + _erf(x / np.sqrt(2.0)))
    raise ValueError(f"unknown activation: {kind}")


def _erf(x: np.ndarray) -> np.ndarray:
    """Abramowitz and Stegun 7.1.26, absolute error at most 1.5e-7."""
    t = 1.0 / (1.0 + 0.3275911 * np.abs(x))
    poly = t * (0.254829592 + t * (-0.284496736 + t * (
        1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return np.sign(x) * (1.0 - poly * np.exp(-x * x))


def _linear(x: np.ndarray, part) -> np.ndarray:
    return x @ part[0].T + part[1]


def project_batch(x: np.ndarray, w: Projector) -> np.ndarray:
    """Unit output vectors of a batch; dropout has no effect outside training."""
    steps = [(w.input, w.input_norm)]
    steps += [(h, w.hidden_norms[i] if w.hidden_norms else None) for i, h in enumerate(w.hidden)]
    out = x
    for part, norm in steps:
        out = _linear(out, part)
        out = activate(norm(out) if norm else out, w.activation)
    out = _linear(out, w.output)
    if w.output_norm:
        out = w.output_norm(out)
    if w.residual is not None:
        out = out + _linear(x, w.residual)
    return out / np.maximum(np.sqrt((out * out).sum(1, keepdims=True)), 1e-12)


def project_vectors(df: DataFrame, weights: Projector, vector: str | Column,
                    output: str = "projected") -> DataFrame:
    """Projected unit vectors; the weights are sent to each executor once."""
    sent = ship(df.sparkSession, weights)

    @F.pandas_udf("array<double>")
    def run(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        w = unpack(sent)
        for s in series:
            if len(s):
                x = np.stack(s.to_numpy()).astype(np.float64)
                yield pd.Series(list(project_batch(x, w)))
            else:
                yield pd.Series([], dtype=object)

    vec = F.col(vector) if isinstance(vector, str) else vector
    return df.withColumn(output, run.asNondeterministic()(vec))
