"""Small autoencoders as table jobs: specify, fit, apply, augment.

A model is one row: its name, layer widths, weights, and the range of each
feature.  Fitting is data parallel and trains every point of the parameter grid in
the same pass over the rows; only weights and losses leave the tasks.
"""

from __future__ import annotations

import base64
import math
import os
import re
import sys
import tempfile
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark import BarrierTaskContext, StorageLevel, cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from measureframe.functions.scalar import from_db, to_db
from measureframe.operators.learning import group_split
from measureframe.plans.ordering import task_rows
from measureframe.roles import as_category, categories, q, with_columns

# Hidden widths of the four networks, and which of them is the code.
NETWORKS: dict[str, tuple[tuple[int, ...], int]] = {
    "AE Simulator 1-6": ((6,), 0),
    "AE Simulator 1-3": ((3,), 0),
    "AE Dimensionality Reduction 2-10": ((10, 1, 10), 1),
    "AE Dimensionality Reduction 2-5": ((5, 1, 5), 1),
}
#: Turns of an epoch, at most; tasks hand weights on after each.
_TURNS = 64
#: Held-back rows that are scored at once.
_SCORED = 100_000
#: Equal rows that are numbered at once.
_RUN = 1000
# RMSprop constants.
_ALPHA, _EPS = 0.99, 1e-8

MODEL_SCHEMA = (
    "model_file string, network string, features array<string>, epoch int, batch_size int, "
    "learning_rate double, weight_decay double, weights array<double>, low array<double>, high array<double>"
)


@dataclass(frozen=True)
class Shape:
    """Layer widths from input to output; ``code`` is the layer that is the encoding."""

    widths: tuple[int, ...]
    code: int

    @property
    def size(self) -> int:
        return sum((a + 1) * b for a, b in zip(self.widths, self.widths[1:]))


def ae_spec(network: str, n_features: int) -> Shape:
    hidden, code = NETWORKS[network]
    return Shape((n_features, *hidden, n_features), code + 1)


def layers(shape: Shape, flat: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Views of the weight vector: per layer an (in, out) matrix, then the bias."""
    out, at = [], 0
    for a, b in zip(shape.widths, shape.widths[1:]):
        out.append((flat[at:at + a * b].reshape(a, b), flat[at + a * b:at + (a + 1) * b]))
        at += (a + 1) * b
    return out


def initial_weights(shape: Shape, seed: int) -> np.ndarray:
    """Uniform within 1/sqrt(inputs) of zero."""
    rng = np.random.default_rng(seed)
    parts = []
    for a, b in zip(shape.widths, shape.widths[1:]):
        bound = 1 / np.sqrt(a)
        parts += [rng.uniform(-bound, bound, a * b), rng.uniform(-bound, bound, b)]
    return np.concatenate(parts)


def forward(shape: Shape, flat: np.ndarray, x: np.ndarray) -> list[np.ndarray]:
    """Values of every layer; rectified except for the last."""
    values = [x]
    stack = layers(shape, flat)
    for i, (w, b) in enumerate(stack):
        z = values[-1] @ w + b
        values.append(z if i == len(stack) - 1 else np.maximum(z, 0.0))
    return values


def loss_and_gradient(shape: Shape, flat: np.ndarray, x: np.ndarray) -> tuple[float, np.ndarray]:
    """Mean squared reconstruction error and its gradient."""
    values = forward(shape, flat, x)
    diff = values[-1] - x
    loss = float(np.mean(diff**2))
    grad = np.empty_like(flat)
    slots, stack = layers(shape, grad), layers(shape, flat)
    back = 2.0 * diff / diff.size
    for i in range(len(stack) - 1, -1, -1):
        gw, gb = slots[i]
        gw[:] = values[i].T @ back
        gb[:] = back.sum(axis=0)
        if i:
            back = (back @ stack[i][0].T) * (values[i] > 0)
    return loss, grad


def matrix(column, width: int) -> np.ndarray:
    """Arrow lists of equal length as rows of a matrix, without a Python object per row."""
    return np.asarray(column.flatten(), dtype=np.float64).reshape(-1, width)


# Workers get these helpers by value, so they need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def parameter_grid(
    batch_sizes: Sequence[int], learning_rates: Sequence[float], weight_decays: Sequence[float]
) -> list[tuple[int, float, float]]:
    return list(product(batch_sizes, learning_rates, weight_decays))


def _together(values: np.ndarray, tasks: int) -> np.ndarray:
    """The sum of every task's values, known to all of them."""
    if tasks == 1:
        return values
    gathered = BarrierTaskContext.get().allGather(base64.b64encode(values.tobytes()).decode())
    return np.sum([np.frombuffer(base64.b64decode(g)) for g in gathered], axis=0).reshape(values.shape)


class _Blocks:
    """The rows of one task in files of its own, a block in memory at a time."""

    def __init__(self, folder: str, batches, width: int):
        self.folder, self.width, self.n_held, self.known = folder, width, 0, set()
        for t in batches:
            block, fits, h = t.column(0).to_numpy(), t.column(2).to_numpy(zero_copy_only=False), t.column(1).to_numpy()
            x = matrix(t.column(3), width)
            self.n_held += int((~fits).sum())
            self._append("held", x[~fits])
            rows = np.column_stack([h.view(np.float64), x])
            for k in np.unique(block[fits]).tolist():
                self.known.add(k)
                self._append(k, rows[fits & (block == k)])
        for k in self.known:
            rows = np.fromfile(self._path(k)).reshape(-1, 1 + width)
            h, x = np.ascontiguousarray(rows[:, 0]).view(np.int64), rows[:, 1:]
            x[np.lexsort((*x.T[::-1], h))].tofile(self._path(k))

    def _path(self, name) -> str:
        return os.path.join(self.folder, str(name))

    def _append(self, name, rows: np.ndarray) -> None:
        with open(self._path(name), "ab") as file:
            file.write(rows.tobytes())

    def rows(self, k: int) -> np.ndarray:
        return np.fromfile(self._path(k)).reshape(-1, self.width)

    def held(self):
        if self.n_held:
            with open(self._path("held"), "rb") as file:
                while len(part := np.fromfile(file, count=_SCORED * self.width)):
                    yield part.reshape(-1, self.width)


def _training(shape, grid, weights, squares, seed, first, last, blocks, turns, tasks):
    """A function of one task: its part in epochs ``first`` to ``last`` of mini-batch RMSprop.

    Rows are dealt into blocks by their hash, blocks into turns, and a task has whole turns, in files.  An epoch visits the
    turns, the blocks of a turn, and the rows of a block, in orders drawn from the seed, so each point of the grid takes
    the steps of one sequential run on any number of tasks.  In a stage a turn's task trains on it and hands weights on to all;
    the points of the grid follow each other through the turns, one turn apart, so as many tasks work as the grid has
    points.  The weights of a finished epoch are scored on the held-back rows of all tasks in the stage that
    begins the next epoch.
    """
    width, size, epochs = shape.widths[0], shape.size, last - first + 1

    def run(batches):
        with tempfile.TemporaryDirectory() as folder:
            yield from trained(_Blocks(folder, batches, width))

    def trained(own):
        n_held = int(_together(np.array([float(own.n_held)]), tasks)[0])
        orders = [np.random.default_rng([seed, e]).permutation(turns) for e in range(first, last + 1)]
        state = [(w.copy(), v.copy()) for w, v in zip(weights, squares)]
        # By point of the grid and epoch: summed loss, mini-batches, summed squares on the held-back rows, and the weights.
        done = {(c, e): [0.0, 0.0, 0.0, None] for c in range(len(grid)) for e in range(epochs)}
        for stage in range(epochs * turns + len(grid)):
            sent = np.zeros((len(grid), 2 * size + 4))
            for c, (batch, rate, decay) in enumerate(grid):
                epoch, i = divmod(stage - c, turns)
                if epoch >= 1 and i == 0 and epoch <= epochs:
                    sent[c, 0] = sum(np.sum((forward(shape, state[c][0], part)[-1] - part) ** 2) for part in own.held())
                if not 0 <= epoch < epochs:
                    continue
                turn = int(orders[epoch][i])
                visited = np.random.default_rng([seed, first + epoch, turn, 1]).permutation(range(turn, blocks, turns)).tolist()
                if visited := [k for k in visited if k in own.known]:
                    w, v = state[c][0].copy(), state[c][1].copy()
                    for k in visited:
                        rows = own.rows(k)
                        rows = rows[np.random.default_rng([seed, first + epoch, k]).permutation(len(rows))]
                        for start in range(0, len(rows), batch):
                            loss, gradient = loss_and_gradient(shape, w, rows[start:start + batch])
                            descend(w, v, gradient, rate, decay)
                            sent[c, 1:3] += loss, 1
                    sent[c, 3], sent[c, 4:4 + size], sent[c, 4 + size:] = 1, w, v
            known = _together(sent, tasks)
            for c in range(len(grid)):
                epoch, i = divmod(stage - c, turns)
                if epoch >= 1 and i == 0 and epoch <= epochs:
                    done[c, epoch - 1][2] = known[c, 0]
                if 0 <= epoch < epochs:
                    if known[c, 3]:
                        state[c] = known[c, 4:4 + size].copy(), known[c, 4 + size:].copy()
                    done[c, epoch][0] += known[c, 1]
                    done[c, epoch][1] += known[c, 2]
                    done[c, epoch][3] = state[c]
        if tasks == 1 or BarrierTaskContext.get().partitionId() == 0:
            keys = sorted(done)
            yield pa.RecordBatch.from_arrays([
                pa.array([first + e for _, e in keys], pa.int32()), pa.array([c for c, _ in keys], pa.int32()),
                pa.array([done[k][0] / done[k][1] if done[k][1] else None for k in keys], pa.float64()),
                pa.array([done[k][2] / (n_held * width) if n_held else None for k in keys], pa.float64()),
                *(pa.array([done[k][3][part] for k in keys], pa.list_(pa.float64())) for part in (0, 1))],
                names=["epoch", "config", "fitted", "checked", "weights", "squares"])

    return run


def descend(w: np.ndarray, v: np.ndarray, gradient: np.ndarray, rate: float, decay: float) -> None:
    """One RMSprop step, in place."""
    g = gradient + decay * w
    v *= _ALPHA
    v += (1 - _ALPHA) * g * g
    w -= rate * g / (np.sqrt(v) + _EPS)


_EPOCH_SCHEMA = "epoch int, config int, fitted double, checked double, weights array<double>, squares array<double>"


def ae_fit(
    df: DataFrame,
    features: Sequence[str],
    grouping: str | Sequence[str] = ("FOV", "Cell"),
    series: str | None = "Treatment",
    network: str = "AE Dimensionality Reduction 2-10",
    epochs: int = 20,
    batch_sizes: Sequence[int] = (128,),
    learning_rates: Sequence[float] = (1e-4,),
    weight_decays: Sequence[float] = (1e-8,),
    train_share: float = 0.7,
    checkpoint_interval: int = 20,
    rescale: bool = False,
    model_name: str = "AEModel",
    seed: int = 0,
    tasks: int | None = None,
) -> dict[str, DataFrame]:
    """Train the grid; returns ``loss``, ``models``, ``decoded`` and ``encoded`` tables.

    One job trains ``checkpoint_interval`` epochs.  Losses and weights are those of one sequential run, however the
    rows are dealt: rows form blocks of ``spark.measureframe.taskRows`` rows, a task keeps them in files and one in memory, and with more
    than one the tasks are a barrier stage that passes the weights on from turn to turn (``_training``); a turn is one block, or
    more when there are many.  ``tasks`` are as many as turns, at most as many as run at once.  A lost executor costs the epochs since
    the last job.  The training loss is the mean over the mini-batches, the validation loss that over the held-back rows.
    """
    spark = df.sparkSession
    feats = list(features)
    shape = ae_spec(network, len(feats))
    grid = parameter_grid(batch_sizes, learning_rates, weight_decays)
    split = group_split(df, grouping, train_share, seed, series, name="_train")
    bounds = split.agg(
        F.count(F.lit(1)).alias("n"), *[f(F.when(F.col("_train"), q(c))).cast("double") for f in (F.min, F.max) for c in feats]).first()
    low, high = list(bounds[1:len(feats) + 1]), list(bounds[len(feats) + 1:])
    scaled = _unit_scaled(split, feats, low, high)
    blocks = max(1, -(-bounds["n"] // task_rows(df)))
    turns = min(blocks, _TURNS)
    tasks = max(1, min(turns, tasks or spark.sparkContext.defaultParallelism))
    rows = scaled.select("_train", F.array(*[q(f) for f in feats]).alias("_x")).withColumn("_h", F.xxhash64(F.lit(seed), "_x"))
    rows = rows.select(F.pmod("_h", F.lit(blocks)).cast("int").alias("_block"), "_h", "_train", "_x")
    rows = rows.repartition(tasks, F.pmod("_block", F.lit(turns))) if tasks > 1 else rows.coalesce(1)
    several = epochs > checkpoint_interval
    rows = rows.persist(StorageLevel.MEMORY_AND_DISK) if several else rows
    weights = [initial_weights(shape, seed) for _ in grid]
    squares = [np.zeros(shape.size) for _ in grid]
    losses, models = [], []
    try:
        for first in range(1, epochs + 1, checkpoint_interval):
            last = min(epochs, first + checkpoint_interval - 1)
            train = _training(shape, grid, weights, squares, seed, first, last, blocks, turns, tasks)
            # One row for each epoch and point of the grid.
            for r in sorted(rows.mapInArrow(train, _EPOCH_SCHEMA, barrier=tasks > 1).collect(), key=lambda r: (r.epoch, r.config)):
                batch, rate, decay = grid[r.config]
                keep = r.epoch == epochs or r.epoch % checkpoint_interval == 0
                file = f"{model_name}_{batch}_{rate}_{decay}_epoch{r.epoch:04d}.model" if keep else "---"
                losses.append((str(r.epoch), str(batch), str(rate), str(decay), r.fitted, r.checked, file))
                weights[r.config], squares[r.config] = np.array(r.weights), np.array(r.squares)
                if keep:
                    models.append((file, network, feats, r.epoch, int(batch), float(rate), float(decay), list(r.weights), low, high))
    finally:
        if several:
            rows.unpersist()
    loss = spark.createDataFrame(losses, (
        "Epoch string, `Batch Size` string, `Learning Rate` string, `Weight Decay` string, "
        "`Training Loss` double, `Validation Loss` double, `Model File` string"
    ))
    table = spark.createDataFrame(models, MODEL_SCHEMA)
    final = [m for m in models if m[3] == epochs]
    applied = _run_models(scaled, final, feats)
    label = as_category(F.when(F.col("_train"), "training").otherwise("validation"), "Autoencoder")
    cats = [q(c) for c in categories(df)]

    def decoded(i: int):
        value = F.get("_recon", F.lit(i))
        if rescale:
            value = value * F.lit((high[i] - low[i]) or 1.0) + F.lit(low[i])
        return value.cast("float").alias(f"AE Recon {feats[i]}")

    return {
        "loss": loss,
        "models": table,
        "decoded": applied.select("model_file", *cats, label, *[decoded(i) for i in range(len(feats))]),
        "encoded": applied.select("model_file", *cats, label, *[
            F.get("_code", F.lit(i)).cast("float").alias(f"AE Encoded {i}")
            for i in range(shape.widths[shape.code])
        ]),
    }


def _unit_scaled(df: DataFrame, feats: Sequence[str], low: Sequence[float], high: Sequence[float]) -> DataFrame:
    """Features on the training rows' ranges, which are known; missing becomes 0."""
    return with_columns(df, {
        f: F.coalesce((q(f) - F.lit(low[i])) / F.lit((high[i] - low[i]) or 1.0) if low[i] is not None else F.lit(None), F.lit(0.0))
        for i, f in enumerate(feats)
    })


def _run_models(df: DataFrame, models: Sequence, feats: Sequence[str]) -> DataFrame:
    """Rows x models with ``_code`` and ``_recon``; one scan for all models.

    Only the feature values go to Python; the other columns stay in the JVM.
    """
    nets = [(ae_spec(m[1], len(feats)), np.asarray(m[7])) for m in models]

    @F.arrow_udf("array<double>")
    def run(x: pa.Array) -> pa.Array:
        rows = matrix(x, len(feats))
        # Per model its code, then its reconstruction, side by side.
        parts = []
        for shape, flat in nets:
            values = forward(shape, flat, rows)
            parts += [values[shape.code], values[-1]]
        out = np.concatenate(parts, axis=1)
        ends = np.arange(len(out) + 1, dtype=np.int32) * out.shape[1]
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(out.ravel()))

    # A missing feature counts as 0.
    vector = F.array(*[F.coalesce(q(f).cast("double"), F.lit(0.0)) for f in feats])
    models_out, at = [], 1
    for m, (shape, _) in zip(models, nets):
        code = shape.widths[shape.code]
        models_out.append(F.struct(
            F.lit(m[0]).alias("model_file"), F.slice("_y", at, code).alias("_code"),
            F.slice("_y", at + code, len(feats)).alias("_recon"),
        ))
        at += code + len(feats)
    out = df.withColumn("_y", run(vector))
    return out.select(*[q(c) for c in df.columns], F.inline(F.array(*models_out)))


def _collect_models(models: DataFrame) -> list:
    """Model rows on the driver: a few hundred numbers each."""
    return [tuple(r) for r in models.select(*[c.split(" ")[0] for c in MODEL_SCHEMA.split(", ")]).collect()]


def _scaled_input(df: DataFrame, model: Sequence, feats: Sequence[str]) -> DataFrame:
    """Missing becomes 0, then the model's own ranges."""
    low, high = model[8], model[9]
    return with_columns(df, {
        f: (F.coalesce(q(f).cast("double"), F.lit(0.0)) - F.lit(low[i])) / F.lit((high[i] - low[i]) or 1.0)
        for i, f in enumerate(feats)
    })


def ae_apply(
    df: DataFrame, models: DataFrame, features: Sequence[str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """(reconstructed, encoded) tables of every model: categories, ``Recon Feature i`` / ``Feature i``."""
    rows = _collect_models(models)
    feats = list(features or rows[0][2])
    cats = [q(c) for c in categories(df)]
    recon, coded = None, None
    # Models that share their ranges share one scan.
    groups: dict[tuple, list] = {}
    for m in rows:
        groups.setdefault((tuple(m[8]), tuple(m[9])), []).append(m)
    width = max(ae_spec(m[1], len(feats)).widths[ae_spec(m[1], len(feats)).code] for m in rows)
    for members in groups.values():
        base = df.select(*cats, *[q(f) for f in feats if f not in categories(df)])
        out = _run_models(_scaled_input(base, members[0], feats), members, feats)
        a = out.select("model_file", *cats, *[
            F.get("_recon", F.lit(i)).alias(f"Recon Feature {i + 1}") for i in range(len(feats))
        ])
        b = out.select("model_file", *cats, *[
            F.get("_code", F.lit(i)).alias(f"Feature {i + 1}") for i in range(width)
        ])
        recon = a if recon is None else recon.unionByName(a)
        coded = b if coded is None else coded.unionByName(b)
    return recon, coded


def amplitude_columns(features: Sequence[str]) -> dict[str, list[str]]:
    """Per signal (first word of the name), its columns ``<signal> a<digit>``."""
    signals = sorted({f.split()[0] for f in features if f.split()})
    return {
        s: [f for f in features if re.fullmatch(rf"{re.escape(s)}\sa\d", f, re.IGNORECASE)]
        for s in signals
    }


def ae_augment(
    df: DataFrame,
    features: Sequence[str],
    grouping: Sequence[str],
    sets: int = 4,
    models: DataFrame | None = None,
    add_noise: bool = False,
    snr_db: float = 20.0,
    amplitudes: Mapping[str, Sequence[str]] | None = None,
    seed: int = 0,
) -> DataFrame:
    """``sets`` simulated copies of the rows.

    Noise (optional) has a per-feature variance of mean(x^2) / 10^(snr/10).  A model
    (optional) rebuilds the features.  The last grouping column is renumbered per
    copy; amplitudes are recomputed as percent of their signal's sum.
    """
    feats, cats = list(features), categories(df)
    last = list(grouping)[-1]
    number = F.try_to_number(q(last).cast("string"), F.lit("999999999999999999")).cast("long")
    span = df.agg(F.struct(
        F.max(number).alias("top"), F.count_if(number.isNull()).alias("text"),
        *[F.avg(q(f) * q(f)).alias(f"p{i}") for i, f in enumerate(feats)],
    )).scalar()
    rows = df.select(*[q(c) for c in cats], *[q(f).cast("double").alias(f) for f in feats])
    if add_noise:
        # Rows that repeat are numbered from their count, so each gets noise of its own.
        content = [q(c) for c in rows.columns]
        counted = rows.groupBy(*content).agg(F.count(F.lit(1)).alias("_rows"))
        # Counts are small, what comes of them is not: runs of a count are dealt out, by their number of rows.
        runs = counted.withColumn("_run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_rows") - 1) / F.lit(_RUN)))))
        parts = max(df.sparkSession.sparkContext.defaultParallelism, -(-rows.count() * sets // task_rows(df)))
        dealt = runs.repartition(parts, *content, "_run")
        nth = F.sequence(F.col("_run") * _RUN + 1, F.least((F.col("_run") + 1) * _RUN, F.col("_rows")))
        rows = dealt.withColumn("_nth", F.explode(nth)).drop("_rows", "_run")
    copies = rows.withColumn("_set", F.explode(F.sequence(F.lit(0), F.lit(sets - 1))))
    renumbered = F.when(
        span["text"] == 0, (number + span["top"] * F.col("_set")).cast("string")
    ).otherwise(F.concat(q(last).cast("string"), F.lit("."), F.col("_set").cast("string")))
    changed = {last: as_category(renumbered, last)}
    if add_noise:
        # Normal draws from a hash of the row, the copy and the feature: the same however the rows lie.
        content = [q(c) for c in [*cats, *feats]]
        for i, f in enumerate(feats):
            sigma = F.sqrt(from_db(to_db(span[f"p{i}"]) - F.lit(float(snr_db))))
            changed[f] = q(f) + _normal_draw(F.xxhash64(*content, F.col("_nth"), F.col("_set"), F.lit(seed), F.lit(i))) * sigma
    copies = copies.select(*[
        changed[c].alias(c, metadata={"role": "category"}) if c == last else changed[c].alias(c) if c in changed else q(c)
        for c in copies.columns if c not in ("_set", "_nth")
    ])
    head: list = []
    if models is not None:
        rows = _collect_models(models)
        parts = []
        for m in rows:
            out = _run_models(_scaled_input(copies, m, feats), [m], feats)
            back = [
                (F.get("_recon", F.lit(i)) * F.lit((m[9][i] - m[8][i]) or 1.0) + F.lit(m[8][i])).alias(f)
                for i, f in enumerate(feats)
            ]
            parts.append(out.select("model_file", *[q(c) for c in cats], *back))
        copies, head = parts[0], [F.col("model_file")]
        for part in parts[1:]:
            copies = copies.unionByName(part)
    made = {}
    for amps in (amplitudes if amplitudes is not None else amplitude_columns(feats)).values():
        total = sum((F.coalesce(q(a), F.lit(0.0)) for a in amps), F.lit(0.0))
        for a in amps:
            target = next((c for c in df.columns if a in c and "%" in c and "/" not in c), f"{a}%")
            made[target] = F.try_divide(q(a), total) * F.lit(100.0)
    outfeats = sorted({*feats, *made})
    return copies.select(*head, *[q(c) for c in cats], *[
        made[c].alias(c) if c in made else q(c) for c in outfeats
    ])


def _normal_draw(key: Column) -> Column:
    """A standard normal number from a 64-bit hash, by its two uniform halves."""
    unit = lambda bits: (bits + F.lit(0.5)) / F.lit(float(2**31))
    low, high = key.bitwiseAND(F.lit(2**31 - 1)), F.shiftrightunsigned(key, 33)
    return F.sqrt(F.lit(-2.0) * F.log(unit(low))) * F.cos(F.lit(2 * math.pi) * unit(high))


def save_models(models: DataFrame, path: str, mode: str = "append") -> None:
    models.write.mode(mode).partitionBy("model_file").parquet(path)

