"""Language of a text: averaged hashed subword embeddings with a linear softmax, trained in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from measureframe.llm.store import short

#: Lengths in bytes of the subwords, and buckets they are hashed into.
LENGTHS, BUCKETS = (2, 3, 4, 5), 1 << 16
#: Bytes of text that are hashed at once.
CHUNK = 1 << 18
_LETTER = np.zeros(256, bool)
_LETTER[[*range(ord("a"), ord("z") + 1), *range(128, 256)]] = True


def subwords(text: str) -> list[np.ndarray]:
    """Bucket numbers of all subwords of a text, in chunks of bounded size.

    Runs of bytes that are no letters are one word border.  A subword is a run of bytes inside one word
    with its borders, so the last bytes of a chunk are seen again by the next one.
    """
    raw = np.frombuffer(text.lower().encode(), np.uint8)
    letter = _LETTER[raw]
    codes = np.concatenate([[0], np.where(letter, raw, 0), [0]]).astype(np.uint32)
    inner = codes > 0
    keep = np.concatenate([[True], inner[1:] | inner[:-1]])
    codes, inner = codes[keep], inner[keep]
    out = []
    for begin in range(0, len(codes), CHUNK):
        part, inside = codes[begin : begin + CHUNK + max(LENGTHS) - 1], inner[begin : begin + CHUNK + max(LENGTHS) - 1]
        for n in LENGTHS:
            size = min(CHUNK, len(part) - n + 1)
            if size <= 0:
                continue
            total = np.full(size, n, np.uint32)
            whole = np.ones(size, bool)
            for i in range(n):
                total = total * np.uint32(0x01000193) ^ part[i : i + size]
                if 0 < i < n - 1:
                    whole &= inside[i : i + size]
            if n == 2:
                whole = inside[:size] | inside[1 : size + 1]
            total ^= total >> np.uint32(15)
            out.append((total * np.uint32(0x2C1B3C6D) >> np.uint32(16))[whole] & np.uint32(BUCKETS - 1))
    return out


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


@dataclass
class LanguageModel:
    """Embeddings times output weights, a row of logits for each bucket, and the calibration."""

    names: list[str]
    logits: np.ndarray
    bias: np.ndarray
    temperature: float
    least: float

    def raw(self, text: str) -> np.ndarray:
        total, n = np.zeros(len(self.names)), 0
        for part in subwords(text):
            total += np.bincount(part, minlength=BUCKETS) @ self.logits if len(part) > BUCKETS // 4 else self.logits[part].sum(axis=0)
            n += len(part)
        return total / max(n, 1) + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        """Label and calibrated probability; ``und`` and 0 without a letter."""
        if not has_letter(text):
            return "und", 0.0
        p = softmax(self.raw(text) / self.temperature)
        best = int(np.argmax(p))
        return self.names[best], float(p[best])


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max())
    return e / e.sum()


def train(rows: list[tuple[str, np.ndarray, np.ndarray]], dim: int = 16, epochs: int = 12, rate: float = 8.0, reject: float = 0.001, most: float = 0.4, seed: int = 7) -> LanguageModel:
    """Fit by stochastic gradient descent on (label, buckets, counts) rows.

    Every fifth row is held back.  On those the temperature is chosen by the likelihood, and the
    least accepted probability as that which ``reject`` of the rightly labelled rows stay below, ``most`` at most.
    """
    rng = np.random.default_rng(seed)
    names = sorted({label for label, _, _ in rows})
    at = {s: i for i, s in enumerate(names)}
    order = rng.permutation(len(rows))
    held, used = [rows[i] for i in order[::5]], [rows[i] for k, i in enumerate(order) if k % 5]
    if len(used) < 2 * len(names):
        used = rows
    embed = rng.normal(0, 0.1, (BUCKETS, dim))
    weights, bias = np.zeros((dim, len(names))), np.zeros(len(names))
    steps, total = 0, epochs * max(1, len(used))
    for _ in range(epochs):
        for i in rng.permutation(len(used)):
            label, buckets, counts = used[i]
            share = counts / max(1, counts.sum())
            mean = share @ embed[buckets]
            error = softmax(mean @ weights + bias)
            error[at[label]] -= 1
            step = rate * (1 - steps / total)
            steps += 1
            embed[buckets] -= step * share[:, None] * (weights @ error)[None, :]
            weights -= 0.1 * step * np.outer(mean, error)
            bias -= 0.01 * step * error
    table = embed @ weights
    raw = [(at[label], (counts / max(1, counts.sum())) @ table[buckets] + bias) for label, buckets, counts in held]
    loss = lambda t: -sum(np.log(max(softmax(x / t)[y], 1e-300)) for y, x in raw)
    temperature = min((0.05 * 1.25**k for k in range(28)), key=loss) if raw else 1.0
    sure = [softmax(x / temperature).max() for y, x in raw if int(np.argmax(x)) == y]
    least = min(most, float(np.quantile(sure, reject))) if sure else 0.0
    return LanguageModel(names, table.astype(np.float32), bias, temperature, least)


def sampled(docs: DataFrame, per_label: int, id_col: str, text_col: str, label_col: str) -> list[tuple[str, np.ndarray, np.ndarray]]:
    """Bags of subwords of about ``per_label`` rows of each label, chosen by hash; whole texts."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(label_col).alias("label")).filter("label is not null and text is not null")
    sizes = {r.label: r.n for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return []
    share = F.create_map(*[F.lit(x) for s, n in sizes.items() for x in (s, min(1.0, per_label / n))])[F.col("label")]
    lot = F.pmod(F.xxhash64("id", "text"), F.lit(1 << 30)) / float(1 << 30)

    def bags(batches):
        for batch in short(batches):
            found = [np.unique(np.concatenate(p), return_counts=True) if (p := subwords(t)) else (np.zeros(0), np.zeros(0)) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), *(pa.array([x[i].astype(k).tobytes() for x in found], pa.binary()) for i, k in enumerate(("<u2", "<u4")))], ["label", "buckets", "counts"])

    chosen = rows.filter(lot < share).select("text", "label").mapInArrow(bags, "label string, buckets binary, counts binary").toArrow()
    labels, buckets, counts = (chosen.column(i) for i in range(3))
    # Views of what was received, in an order that does not depend on how it came.
    bags_ = [(label.as_py(), np.frombuffer(b.as_buffer(), "<u2"), np.frombuffer(n.as_buffer(), "<u4")) for label, b, n in zip(labels, buckets, counts)]
    return sorted((x for x in bags_ if len(x[1])), key=lambda x: (x[0], len(x[1]), xxhash.xxh3_64_intdigest(x[1]), xxhash.xxh3_64_intdigest(x[2])))


def fit(docs: DataFrame, training: Column, per_label: int = 1500, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> LanguageModel:
    """A model from the rows where ``training`` holds, about ``per_label`` of each label.

    That bound and the number of labels bound what the driver receives and fits.
    """
    rows = sampled(docs.filter(training), per_label, id_col, text_col, label_col)
    return train(rows) if rows else LanguageModel(["und"], np.zeros((BUCKETS, 1), np.float32), np.zeros(1), 1.0, 0.0)


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """Every row, in ``row``, with lang_pred, score and rejected.

    Only the text is looked at, the whole of it.  A text that is null or has no letter is ``und``
    with score 0 and is rejected; so is one whose score lies below the model's least.  Rows
    that repeat get the same answer; other columns pass through under any name.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        own = sent.value
        for batch in short(batches):
            found = [own.predict(t) for t in batch.column(0).field(text_col).to_pylist()]
            score = np.array([s for _, s in found])
            label = [name for name, _ in found]
            rejected = (score < own.least) | np.array([x == "und" for x in label], bool)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(label, pa.string()), pa.array(score), pa.array(rejected)], ["row", "lang_pred", "score", "rejected"])

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    schema = T.StructType([*rows.schema, *(T.StructField(n, k) for n, k in (("lang_pred", T.StringType()), ("score", T.DoubleType()), ("rejected", T.BooleanType())))])
    return rows.mapInArrow(run, schema)
