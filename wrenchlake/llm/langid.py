"""Language identification by the nearest of several centroids per language."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wrenchlake.llm.common import bounded_batches, id_crc, stored, text_of

#: Dimensions of the hashed n-gram vectors.
DIMS = 4096
BLOCK = 1 << 20
#: Documents of each language the centroids are fitted on at most, chosen by a hash of the id.
FIT_PER_LANGUAGE = 600
#: Characters of a text that the fit takes at most, so that the sample is bounded in bytes, too.
FIT_BYTES = 20_000
CENTROIDS, ROUNDS = 4, 12
#: A text is marked as rejected if it is less similar to its centroid than this quantile of what the centroid was fitted on.
REJECT_QUANTILE = 0.01
SEED = 11
UNKNOWN = "und"

_SPACES = re.compile(rb"  +")
_LETTERS = bytes(b if b > 127 or chr(b).isalpha() else 32 for b in range(256))

PREDICTED = "struct<lang_pred: string, score: double, rejected: boolean>"


def _add_grams(out: np.ndarray, held: list[bytes], owners: list[int], skip: list[int]) -> None:
    """Add the n-grams of the pieces to their texts' counts. No gram reaches over the border of two pieces; the first ``skip`` bytes of a piece
    were the last of the one before in the same text, so grams that lie within them are not counted twice."""
    lengths = np.array([len(h) for h in held])
    data = np.frombuffer(b"".join(held), np.uint8).astype(np.uint32)
    rows, place = np.unique(owners, return_inverse=True)
    owner = np.repeat(place.astype(np.uint32), lengths)
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(data))  # bytes from here to the piece's end
    at = np.repeat(lengths, lengths) - left  # and from its begin
    told = np.repeat(np.array(skip), lengths)
    total = np.zeros(len(rows) * DIMS)
    gram = data
    for n in (2, 3):
        gram = gram[:-1] << np.uint32(8) | data[n - 1 :]
        counts = (left >= n) & (at + n > told)
        slot = (gram[counts[: len(gram)]] * np.uint32(2654435761) + np.uint32(n * 40503)) >> np.uint32(20)
        total += np.bincount(owner[: len(gram)][counts[: len(gram)]] * np.uint32(DIMS) + slot, minlength=len(total))
    out[rows] += total.reshape(len(rows), DIMS)


def ngram_counts(texts: list[str]) -> np.ndarray:
    """Counts of hashed n-grams of two and three bytes of the lower-cased text, a row a text; BLOCK bytes at a time.
    ASCII characters other than letters count as one space a run: digits and signs say little of a language. A row is a
    function of its text alone, whatever stands beside it and however it is cut into blocks."""
    out = np.zeros((len(texts), DIMS))
    held, owners, skip, size = [], [], [], 0
    for k, text in enumerate(texts):
        data = _SPACES.sub(b" ", b" " + text.lower().encode("utf-8", "replace").translate(_LETTERS) + b" ")
        for at in range(0, len(data), BLOCK):
            back = min(at, 2)
            held.append(data[at - back : at + BLOCK])
            owners.append(k)
            skip.append(back)
            size += len(held[-1])
            if size >= BLOCK or len(held) >= 2000:
                _add_grams(out, held, owners, skip)
                held, owners, skip, size = [], [], [], 0
    if held:
        _add_grams(out, held, owners, skip)
    return out.astype(np.float32)


@dataclass
class Model:
    """Languages, IDF weights, and the unit centroids with their languages and rejection bounds."""

    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray
    language_of: np.ndarray
    bound: np.ndarray

    def vectors(self, texts: list[str]) -> np.ndarray:
        """TF-IDF vectors of unit length; term frequencies count by their square roots."""
        x = np.sqrt(ngram_counts(texts)) * self.idf
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        out = []
        for at in range(0, len(texts), 500):
            part = texts[at : at + 500]
            if not len(self.centroids):
                out += [(UNKNOWN, 0.0, True)] * len(part)
                continue
            cosine = np.round(self.vectors([t or "" for t in part]).astype(float) @ self.centroids.T.astype(float), 9)
            best = cosine.argmax(1)
            for text, k, c in zip(part, best.tolist(), cosine.max(1).tolist()):
                letters = text is not None and any(map(str.isalpha, text))
                out.append((self.languages[self.language_of[k]], min(1.0, max(0.0, c)), c < self.bound[k]) if letters else (UNKNOWN, 0.0, True))
        return out


def _cluster(x: np.ndarray, k: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means from distant starts: unit centroids and each row's centroid."""
    picks = [int(rng.integers(len(x)))]
    for _ in range(min(k, len(x)) - 1):
        picks.append(int((x @ x[picks].T).max(1).argmin()))
    centers = x[picks]
    for _ in range(ROUNDS):
        near = (x @ centers.T).argmax(1)
        centers = np.vstack([x[near == i].mean(0) if (near == i).any() else centers[i] for i in range(len(centers))])
        centers /= np.maximum(np.linalg.norm(centers, axis=1, keepdims=True), 1e-12)
    return centers, (x @ centers.T).argmax(1)


def fit_model(texts: list[str], langs: list[str], seed: int = SEED) -> Model:
    rng, languages = np.random.default_rng(seed), sorted(set(langs))
    if not texts:
        return Model([], np.ones(DIMS, np.float32), np.zeros((0, DIMS), np.float32), np.zeros(0, int), np.zeros(0))
    counts = ngram_counts(texts)
    idf = np.log((1 + len(texts)) / (1 + (counts > 0).sum(0))).astype(np.float32) + 1
    x = np.sqrt(counts) * idf
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    centers, owner, bounds, which = [], [], [], np.array([languages.index(g) for g in langs])
    for i in range(len(languages)):
        own = x[which == i]
        c, near = _cluster(own, CENTROIDS, rng)
        similar = (own * c[near]).sum(1)
        for j in range(len(c)):
            centers.append(c[j])
            owner.append(i)
            bounds.append(np.quantile(similar[near == j], REJECT_QUANTILE) if (near == j).any() else 0.0)
    return Model(languages, idf, np.array(centers, np.float32), np.array(owner), np.array(bounds))


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.pmod(id_crc(id_col), F.lit(5)) == 0, F.lit(False))


def fit_on(docs: DataFrame, per_language: int = FIT_PER_LANGUAGE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fit on at most ``per_language`` documents of each language that aren't held out: those of least hash of the id.

    One row counts of those that repeat an id, that of least hash of its text, so the sample is bounded whatever is repeated; of a text
    longer than ``FIT_BYTES`` characters the sample takes so many (predictions take all). Rows whose hash is beyond what
    a few times the sample needs are cut before the ranking, unless a language then has too few. Null languages, ids and
    texts are passed over. The chosen texts alone go to the driver, ``per_language`` for each of a few languages.
    """
    usable = docs.where(~held_out(id_col) & F.col(lang_col).isNotNull() & F.col(id_col).isNotNull() & F.col(text_col).isNotNull())
    rows = usable.select(F.col(lang_col).cast("string").alias("__lang"), F.xxhash64(F.col(id_col)).alias("__hash"), F.xxhash64(F.col(text_col)).alias("__key"))
    sizes = {r[0]: r[1] for r in rows.groupBy("__lang").agg(F.count("*")).collect()}  # a row a language
    if not sizes:
        return fit_model([], [])
    share = lambda n: min(1 << 62, 4 * per_language * (1 << 62) // n)
    wide = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, share(n))])
    some = F.shiftrightunsigned("__hash", 2) <= F.element_at(wide, F.col("__lang"))
    rank = Window.partitionBy("__lang").orderBy("__hash")

    def least(of: DataFrame) -> DataFrame:
        once = of.groupBy("__lang", "__hash").agg(F.min("__key").alias("__key"))
        return once.withColumn("__n", F.row_number().over(rank)).where(F.col("__n") <= per_language).drop("__n")

    chosen = stored(least(rows.where(some)), "langid-sample")
    few = [r[0] for r in chosen.groupBy("__lang").agg(F.count("*").alias("n")).collect() if r[1] < min(per_language, sizes[r[0]])]
    if few:  # a language of many repeated ids
        chosen = stored(chosen.where(~F.col("__lang").isin(few)).unionByName(least(rows.where(F.col("__lang").isin(few)))), "langid-sample")
    texts = usable.select(F.col(lang_col).cast("string").alias("__lang"), F.xxhash64(F.col(id_col)).alias("__hash"), F.xxhash64(F.col(text_col)).alias("__key"), F.substring(F.col(text_col), 1, FIT_BYTES).alias("__text"))
    own = texts.join(F.broadcast(chosen), ["__lang", "__hash", "__key"]).dropDuplicates(["__lang", "__hash", "__key"])
    sample = sorted((r[0], r[1], r[2]) for r in own.select("__lang", "__hash", "__text").collect())
    return fit_model([r[2] for r in sample], [r[0] for r in sample])


def predict(text: Column, model: Model) -> Column:
    bounded_batches()

    @F.pandas_udf(PREDICTED)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame(model.predict(batch.tolist()), columns=["lang_pred", "score", "rejected"])

    return run(text)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = FIT_PER_LANGUAGE) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score, rejected)`` per row: the language of the centroid of greatest cosine.

    ``score`` is that cosine. ``und`` with score 0 where the text is null or has no letter, or if no row has
    a language. A text farther from its centroid than all but the farthest hundredth of what the
    centroid was fitted on is marked ``rejected``; it still gets the nearest language. Predictions use the text
    alone; null ids are predicted and not held out; repeated rows are each returned. No text is shuffled.
    """
    model = fit_on(docs, per_language, id_col, text_col, lang_col)
    said = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), predict(F.coalesce(F.col(text_col), F.lit("")), model).alias("p"))
    return said.select("doc_id", "held_out", "p.*")
