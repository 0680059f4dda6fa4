"""Quality classifier: attention-based multiple-instance learning over a document's passages."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wrenchlake.llm.common import bounded_batches, id_crc, stored, text_of

#: Bytes of a passage; the last of a text may be shorter.
PASSAGE = 512
#: Bytes encoded at a time.
BLOCK = 1 << 20
#: Labelled documents the model is fitted on at most, chosen by a hash of the id.
FIT_DOCUMENTS = 3000
#: Characters of a text that the fit takes at most, so that the sample is bounded in bytes, too (scores take all).
FIT_CHARS = 20_000
HIDDEN, ATTENTION = 16, 8
EPOCHS, BATCH, RATE, DECAY = 14, 32, 0.01, 1e-4
SEED = 7

#: Character classes by first fitting set of bytes; the last is that of all other bytes.
_CLASSES = [b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n\r", b".,;:", b"!?", b"'\"()[]{}<>", b"-_/\\|", b"#$%&*@+=~^", bytes(range(128, 256))]
N_CLASSES = len(_CLASSES) + 1
N_FEATURES = N_CLASSES * N_CLASSES + 2


def _class_table() -> np.ndarray:
    table = np.full(256, N_CLASSES - 1, np.int64)
    for i, chars in enumerate(_CLASSES):
        table[list(chars)] = i
    return table


_TABLE = _class_table()


def _encode_block(data: bytes, pieces: np.ndarray) -> np.ndarray:
    """Features of passages of the given lengths that make up ``data``: square roots of the shares of pairs of
    character classes, how far the passage can be compressed (repetition), and its length."""
    classes = _TABLE[np.frombuffer(data, np.uint8)]
    pairs = classes * N_CLASSES
    pairs[:-1] += classes[1:]
    last = np.cumsum(pieces) - 1  # a passage's last byte is paired with none, whatever stands beside it
    pairs[last] = classes[last] * N_CLASSES + N_CLASSES - 1
    owner = np.repeat(np.arange(len(pieces)) * (N_CLASSES * N_CLASSES), pieces)
    counts = np.bincount(owner + pairs, minlength=len(pieces) * N_CLASSES * N_CLASSES).reshape(len(pieces), -1)
    ends = np.cumsum(pieces)
    packed = np.array([len(zlib.compress(data[e - n : e], 1)) for n, e in zip(pieces.tolist(), ends.tolist())])
    return np.hstack([np.sqrt(counts / pieces[:, None]), 2 * (packed / (pieces + 11))[:, None], (pieces / PASSAGE)[:, None]]).astype(np.float32)


def encode_passages(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Features of every passage and the passages' text numbers, about ``BLOCK`` bytes at a time; an empty text has one
    passage of zeros. Passages of a long text may come in several blocks."""
    held, lengths, owners, size = [], [], [], 0
    for k, text in enumerate(texts):
        data = text.encode("utf-8", "replace")
        if not data:
            yield np.zeros((1, N_FEATURES), np.float32), np.array([k])
        for at in range(0, len(data), BLOCK):
            part = data[at : at + BLOCK]
            whole, rest = divmod(len(part), PASSAGE)
            cut = [PASSAGE] * whole + [rest] * bool(rest)
            held.append(part)
            lengths += cut
            owners += [k] * len(cut)
            size += len(part)
            if size >= BLOCK:
                yield _encode_block(b"".join(held), np.array(lengths)), np.array(owners)
                held, lengths, owners, size = [], [], [], 0
    if held:
        yield _encode_block(b"".join(held), np.array(lengths)), np.array(owners)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Model:
    """Encoder W, gated attention (V, U, w) and classifier (c, b)."""

    W: np.ndarray
    V: np.ndarray
    U: np.ndarray
    w: np.ndarray
    c: np.ndarray
    b: np.ndarray

    @staticmethod
    def start(rng: np.random.Generator) -> Model:
        normal = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s)
        return Model(normal(N_FEATURES, HIDDEN), normal(HIDDEN, ATTENTION), normal(HIDDEN, ATTENTION), normal(ATTENTION), normal(HIDDEN), np.zeros(1))

    def attend(self, x: np.ndarray):
        """Encoded passages, the two halves of the gate, and the unnormalised log weights (bounded by the sum of |w|)."""
        h = np.tanh(x @ self.W)
        t, g = np.tanh(h @ self.V), _sigmoid(h @ self.U)
        return h, t, g, (t * g) @ self.w

    def scores(self, texts: list[str]) -> np.ndarray:
        """Probability of label 1 by text. Weighted sums are kept per text, so long texts need no more memory."""
        top, bottom = np.zeros((len(texts), HIDDEN)), np.zeros(len(texts))
        for x, owner in encode_passages(texts):
            h, _, _, e = self.attend(x)
            a = np.exp(e)
            np.add.at(bottom, owner, a)
            np.add.at(top, owner, a[:, None] * h)
        return _sigmoid((top / np.maximum(bottom, 1e-300)[:, None]) @ self.c + self.b)


def gradients(model: Model, bags: list[np.ndarray], y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
    """Slopes of the mean weighted log loss over bags of passages, by the model's parts."""
    x = np.vstack(bags)
    n = np.array([len(b) for b in bags])
    first, owner = np.cumsum(n) - n, np.repeat(np.arange(len(bags)), n)
    h, t, g, e = model.attend(x)
    a = np.exp(e - np.maximum.reduceat(e, first)[owner])
    a /= np.add.reduceat(a, first)[owner]
    z = np.add.reduceat(a[:, None] * h, first)
    dlogit = (_sigmoid(z @ model.c + model.b) - y) * weight / len(bags)
    dz = dlogit[:, None] * model.c
    da = (dz[owner] * h).sum(1)
    de = a * (da - np.add.reduceat(a * da, first)[owner])
    dt, dg = de[:, None] * g * model.w * (1 - t * t), de[:, None] * t * model.w * g * (1 - g)
    dh = a[:, None] * dz[owner] + dt @ model.V.T + dg @ model.U.T
    return {"W": x.T @ (dh * (1 - h * h)), "V": h.T @ dt, "U": h.T @ dg, "w": (de[:, None] * t * g).sum(0), "c": z.T @ dlogit, "b": np.array([dlogit.sum()])}


def fit_model(texts: list[str], labels: list[int], seed: int = SEED) -> Model:
    """Adam on the log loss of the attention-weighted passage representation. Classes weigh by
    the root of their shares, so that the rarer is not drowned. One class only: a constant score near it."""
    rng = np.random.default_rng(seed)
    model, y = Model.start(rng), np.array(labels, float)
    if not len(y) or y.min() == y.max():
        model.c[:] = 0
        model.b[:] = 0 if not len(y) else 4 * (2 * y[0] - 1)
        return model
    bags: list[list[np.ndarray]] = [[] for _ in texts]
    for x, owner in encode_passages(texts):
        for k in np.unique(owner):
            bags[k].append(x[owner == k])
    xs = [np.vstack(b) for b in bags]
    weight = np.where(y == 1, 1 / np.sqrt(y.mean()), 1 / np.sqrt(1 - y.mean()))
    weight /= weight.mean()
    names = ["W", "V", "U", "w", "c", "b"]
    m1, m2, step = {n: 0.0 for n in names}, {n: 0.0 for n in names}, 0
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        order = rng.permutation(len(y))
        for at in range(0, len(y), BATCH):
            pick = order[at : at + BATCH]
            grads = gradients(model, [xs[k] for k in pick], y[pick], weight[pick])
            step += 1
            for name in names:
                p, d = getattr(model, name), grads[name]
                d = d + DECAY * p
                m1[name] = 0.9 * m1[name] + 0.1 * d
                m2[name] = 0.999 * m2[name] + 0.001 * d * d
                p -= rate * (m1[name] / (1 - 0.9**step)) / (np.sqrt(m2[name] / (1 - 0.999**step)) + 1e-8)
    return model


def fit_on(docs: DataFrame, labels: DataFrame, limit: int = FIT_DOCUMENTS, id_col: str = "doc_id", text_col: str = "text", learn: Column | None = None) -> Model:
    """Fit on at most ``limit`` labelled documents for which ``learn`` holds: those of least hash of the id.

    Labels other than 0 and 1 and null ids are passed over; of an id labelled twice the larger label counts. Of rows that repeat an
    id one counts, that of least hash of its text; of a text longer than ``FIT_CHARS`` so many characters. Only ids are
    sorted; the chosen texts alone go to the driver.
    """
    ids = labels.where("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("quality").cast("int").alias("__label"))
    ids = ids.where(learn) if learn is not None else ids
    known = ids.join(docs.select(F.col(id_col).alias("__have")).distinct(), F.col("doc_id") == F.col("__have"), "left_semi")
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit).withColumnRenamed("doc_id", "__id")
    chosen = F.broadcast(stored(chosen, "quality-sample"))  # limit narrow rows
    own = docs.select(F.col(id_col).alias("__own"), text_of(text_col).alias("__text"))
    own = own.join(chosen, F.col("__own") == F.col("__id")).select("__id", F.substring("__text", 1, FIT_CHARS).alias("__text"), "__label", F.xxhash64("__text").alias("__key"))
    rows = own.groupBy("__id").agg(F.min_by("__text", "__key"), F.first("__label")).collect()
    rows.sort(key=lambda r: (r[0], r[1]))
    return fit_model([r[1] for r in rows], [r[2] for r in rows])


def score(text: Column, model: Model) -> Column:
    """Probability of label 1 of a text that isn't null; the small model goes to the tasks with the function."""

    bounded_batches()

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(model.scores(batch.tolist()))

    return run(text)


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.pmod(id_crc(id_col), F.lit(3)) == 1, F.lit(False))


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = FIT_DOCUMENTS) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` per row of ``docs``; scores use the text alone.

    Null texts count as empty; empty texts have one passage of zeros. Null ids are scored and not held out. Repeated
    rows are each returned. Without labels every score is 0.5. No text is shuffled.
    """
    model = fit_on(docs, labels, limit, id_col, text_col, learn=~held_out("doc_id"))
    scored = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), score(text_of(text_col), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = FIT_DOCUMENTS) -> DataFrame:
    """``docs`` without the rows that the classifier rejects; columns as they are."""
    model = fit_on(docs, labels, limit, id_col, text_col, learn=~held_out("doc_id"))
    return docs.where(score(text_of(text_col), model) >= 0.5)
