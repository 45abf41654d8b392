import math
import pathlib
import sys

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from entityvec.functions.scratch import scratch_tables, written
from entityvec.operators import inference
from entityvec.operators.inference import Norm, Projector
from entityvec.sources import resumable
from entityvec.streaming import incremental

# The functions below run in tasks, which do not see this file.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def load():
    def model(payloads):
        if any(bytes(p) == b"boom" for p in payloads):
            raise RuntimeError("cannot")
        return np.array([[len(p), p[0]] for p in payloads], np.float32)
    return model


@pytest.fixture
def packaged(spark, tmp_path):
    rows = []
    for i in range(100):
        payload = bytes([i]) * (i % 5 + 1)
        if i in (13, 14) or 20 <= i < 30:
            payload = b"boom"
        if i == 3:
            payload = None
        if i == 4:
            payload = b""
        valid = None if i == 5 else not 40 <= i < 50
        rows.append((i, payload, valid))
    path = str(tmp_path / "in")
    spark.createDataFrame(rows, "OSMID bigint, image_bytes binary, is_valid boolean").coalesce(1).write.parquet(path)
    return path


def run(spark, packaged, out, **options):
    made = resumable.packaged_inference(
        spark, packaged, out, options.pop("load", load), options.pop("model_id", "m"),
        batch_size=2, chunk_rows=10, **options)
    return {r.chunk.split("#")[1]: (r.status, r.rows) for r in made.collect()}


def keys(spark, out):
    got = [r.OSMID for r in resumable.read_vectors(spark, out).collect()]
    assert len(got) == len(set(got))
    return sorted(got)


def test_states_and_resume(spark, packaged, tmp_path):
    out = str(tmp_path / "out")
    first = run(spark, packaged, out)
    assert first["0"] == ("done", 7) and first["2"] == ("failed", 0) and first["4"] == ("empty", 0)
    # Chunk 1 failed in part: nothing of it is committed and it stays pending.
    assert "1" not in first and first["3"] == ("done", 10) and len(first) == 9
    want = [i for i in range(100) if i not in (3, 4, 5) and not 10 <= i < 30 and not 40 <= i < 50]
    assert keys(spark, out) == want
    assert run(spark, packaged, out) == {}

    def cured():
        return lambda payloads: np.array([[1.0, 2.0]] * len(payloads), np.float32)

    assert run(spark, packaged, out, load=cured) == {"1": ("done", 10)}
    assert keys(spark, out) == sorted(want + list(range(10, 20)))
    assert run(spark, packaged, out, load=cured) == {}
    assert resumable.read_vectors(spark, out).schema["embedding"].dataType.elementType.typeName() == "float"


def test_equal_file_names_in_two_folders(spark, tmp_path):
    base, out = tmp_path / "in here", str(tmp_path / "out")

    def put(folder, lo):
        target = base / folder
        (spark.range(lo, lo + 5).select(F.col("id").alias("OSMID"), F.lit(b"ab").alias("image_bytes"))
         .coalesce(1).write.parquet(str(tmp_path / f"t{lo}")))
        target.mkdir(parents=True)
        for f in (tmp_path / f"t{lo}").glob("*.parquet"):
            f.rename(target / "0001.parquet")

    put("d=1", 0)
    run(spark, str(base), out)
    put("d=2", 5)
    made = run(spark, str(base), out)
    assert made == {"0": ("done", 5)} and keys(spark, out) == list(range(10))
    chunks = {r.chunk for r in resumable.read_ledger(spark, out).collect()}
    assert chunks == {"d=1/0001.parquet#0", "d=2/0001.parquet#0"}


def test_limit_over_thousands_of_chunks(spark):
    n = 3000
    usable = spark.range(n * 2).select(F.format_string("c%05d", F.floor(F.col("id") / 2)).alias("chunk"))
    chunks = usable.distinct()
    none = spark.createDataFrame([], resumable.LEDGER)
    whole, cut = resumable._within_limit(chunks, usable, none, 4001)
    assert whole.count() == 2000 and cut == ("c02000", 1)
    assert whole.agg(F.max("chunk")).first()[0] == "c01999"


def test_other_model_is_refused(spark, packaged, tmp_path):
    out = str(tmp_path / "out")
    run(spark, packaged, out)
    with pytest.raises(ValueError, match="holds results"):
        run(spark, packaged, out, model_id="other")
    with pytest.raises(ValueError):
        run(spark, packaged, out, filter_valid=False)


def test_limit_counts_committed_rows(spark, packaged, tmp_path):
    out = str(tmp_path / "out")

    def fine():
        return lambda payloads: np.array([[1.0]] * len(payloads), np.float32)

    run(spark, packaged, out, load=fine, limit=3)
    assert keys(spark, out) == [0, 1, 2]
    run(spark, packaged, out, load=fine, limit=3)
    assert keys(spark, out) == [0, 1, 2]
    run(spark, packaged, out, load=fine, limit=20)
    assert len(keys(spark, out)) == 20
    run(spark, packaged, out, load=fine)
    assert len(keys(spark, out)) == 100 - 3 - 10


def test_pooling():
    hidden, pooled = np.arange(12.0).reshape(2, 3, 2), np.ones((2, 2))
    both = {"last_hidden_state": hidden, "pooler_output": pooled}
    assert (inference.pool_output(both) == hidden[:, 0]).all()
    assert (inference.pool_output(both, "pooler_output") == pooled).all()
    assert (inference.pool_output({"last_hidden_state": hidden}, "pooler_output") == hidden[:, 0]).all()
    assert (inference.pool_output({"pooler_output": pooled}) == pooled).all()
    assert (inference.pool_output({"x": pooled * 2}) == 2).all()
    assert (inference.pool_output((pooled * 3,)) == 3).all()
    assert inference.pool_output(pooled).dtype == np.float32


def test_model_is_loaded_per_task_and_batched(spark):
    def counting():
        sizes = []

        def model(xs):
            sizes.append(len(xs))
            return np.array([[max(sizes), len(xs)]] * len(xs), np.float32)
        return model

    df = spark.range(0, 100, 1, 2).select("id", F.col("id").cast("string").alias("p"))
    got = inference.apply_vectorizer(df, counting, "p", batch_size=7).collect()
    assert {r.embedding[0] for r in got} == {7.0}
    assert {r.embedding[1] for r in got} == {7.0, 1.0}


def naive(x, w):
    def gelu(v):
        return 0.5 * v * (1 + math.erf(v / math.sqrt(2)))

    def norm(v, n):
        m = sum(v) / len(v)
        s = math.sqrt(sum((a - m) ** 2 for a in v) / len(v) + 1e-5)
        return [(a - m) / s * g + b for a, g, b in zip(v, n.scale, n.shift)]

    def lin(v, part):
        return [sum(a * b for a, b in zip(row, v)) + c for row, c in zip(*part)]

    out = lin(x, w.input)
    out = [gelu(a) for a in norm(out, w.input_norm)]
    for part, n in zip(w.hidden, w.hidden_norms):
        out = [gelu(a) for a in norm(lin(out, part), n)]
    out = norm(lin(out, w.output), w.output_norm)
    out = [a + b for a, b in zip(out, lin(x, w.residual))]
    size = math.sqrt(sum(a * a for a in out))
    return [a / size for a in out]


def test_projector(spark):
    rng = np.random.default_rng(0)

    def linear(o, i):
        return rng.normal(size=(o, i)), rng.normal(size=o)

    def layer_norm(n):
        return Norm(rng.normal(size=n), rng.normal(size=n))

    w = Projector(linear(16, 5), linear(3, 16), [linear(16, 16)], linear(3, 5), layer_norm(16),
                  [layer_norm(16)], layer_norm(3))
    x = rng.normal(size=(20, 5))
    df = spark.createDataFrame([(i, list(map(float, v))) for i, v in enumerate(x)], "i int, v array<double>")
    got = inference.project_vectors(df, w, "v").orderBy("i").collect()
    for r in got:
        assert r.projected == pytest.approx(naive(r.v, w), abs=1e-5)
    assert inference.hidden_widths(64, 4, 0.5) == [64, 32, 16, 16]
    assert inference.activate(np.array([[-1.0, 2.0]]), "silu") == pytest.approx(
        np.array([[-1 / (1 + math.e), 2 / (1 + math.exp(-2))]]))
    with pytest.raises(ValueError):
        Projector(linear(2, 2), linear(2, 2), activation="tanh")


def test_stream_resumes(spark, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    schema = "OSMID bigint, image_bytes binary"

    def put(lo, hi):
        spark.range(lo, hi).select(F.col("id").alias("OSMID"), F.lit(b"ab").alias("image_bytes")) \
            .coalesce(1).write.mode("append").parquet(source)

    def go():
        s = spark.createDataFrame([], schema).schema
        incremental.stream_inference(spark, source, s, load, out, state).awaitTermination()
        return spark.read.parquet(out).count()

    put(0, 30)
    assert go() == 30
    put(30, 50)
    assert go() == 50
    assert go() == 50
    spark.createDataFrame([(90, bytearray(b"boom")), (91, bytearray(b"ok"))], schema).coalesce(1).write.mode("append").parquet(source)
    assert go() == 52
    bad = spark.read.parquet(out).filter("error is not null").collect()
    assert [(r.OSMID, r.embedding, r.error) for r in bad] == [(90, None, "RuntimeError: cannot")]
    assert spark.read.parquet(out).select("OSMID").distinct().count() == 52


def test_scratch_tables_end_with_their_owner(spark):
    root = spark.conf.get("spark.checkpoint.dir")

    def tables():
        return {str(p) for p in pathlib.Path(root).glob("entityvec/**/*.parquet")}

    before = tables()
    with scratch_tables(spark):
        inner = written(spark.range(5), "five")
        assert inner.count() == 5 and len(tables()) > len(before)
    assert tables() == before


def test_stream_bandit_in_steps(spark, tmp_path):
    source = str(tmp_path / "in")
    seen = {}

    def keep(batch, _):
        for r in batch.collect():
            seen[r.band] = (r.n, r.reward_sum)

    for part in ([(0, 1.0), (1, 2.0), (-1, 9.0)], [(0, 3.0)]):
        spark.createDataFrame(part, "band int, reward double").write.mode("append").parquet(source)
        stream = spark.readStream.schema("band int, reward double").parquet(source)
        incremental.stream_bandit(stream, keep, str(tmp_path / "state")).awaitTermination()
    assert seen == {0: (2, 4.0), 1: (1, 2.0)}
