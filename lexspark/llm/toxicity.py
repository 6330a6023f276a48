"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts and a sample of all texts are enough: with the class prior p, the risk of a
classifier g is p E+[l(g)] + max(0, E*[l(-g)] - p E+[l(-g)]), where E+ averages over confirmed
texts and E* over unlabelled ones. The second term estimates the risk on clean texts; where a
batch makes it negative (overfitting), the step goes the other way. The model is linear in the
presence of words and their prefixes and suffixes, with logistic loss, trained in NumPy.

The prior is a parameter. Without one it is estimated from the same two samples: no feature is in less than
p times its share of confirmed texts among all texts, so the least ratio of the two shares bounds p
from above, and reaches it if some feature is in no clean text. No text that is labelled clean is read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept, materialize, ragged, small_batches, string_bytes, text_slices
from .tokens import CACHE_BYTES, ChunkTable

BITS = 22
LETTER = np.zeros(256, bool)
LETTER[[*range(ord("a"), ord("z") + 1), *range(0x80, 0x100)]] = True


@dataclass(frozen=True)
class Settings:
    """``most_positive`` and ``most_unlabelled`` bound the texts that a model is fitted on, and
    ``most_pairs`` their features in all (four bytes each); those with the smallest hash of their id
    are taken. ``features`` bounds the model. ``prior`` is the share of toxic texts, if it is known."""

    most_positive: int = 3000
    most_unlabelled: int = 6000
    most_pairs: int = 16_000_000
    prior: float | None = None
    features: int = 1024
    least_positive: int = 3
    folds: int = 5
    epochs: int = 500
    rate: float = 0.05
    decay: float = 1e-5
    beta: float = 0.0
    gamma: float = 1.0


@dataclass(frozen=True)
class Model:
    weights: dict[int, float] = field(default_factory=dict)
    bias: float = -20.0


def word_features(word: str) -> list[int]:
    """Numbers of a word's features: itself, its beginnings of four to six letters, its last four."""
    names = {f"w{word}", *(f"p{word[:n]}" for n in (4, 5, 6) if len(word) >= n), f"s{word[-4:]}"}
    return [xxhash.xxh32_intdigest(x) & ((1 << BITS) - 1) for x in sorted(names)]


class Words:
    """Features of the words of texts; a worker works out each different word once."""

    def __init__(self, only: dict[int, int] | None = None, most: int = 1_000_000):
        self.table, self.only, self.most = ChunkTable(), only, most
        self._clear()

    def _clear(self) -> None:
        self.table.clear()
        self.flat = np.zeros(1 << 14, np.int32)
        self.end = np.zeros(1 << 14, np.int64)

    def _learn(self, new: list[bytes], base: int) -> None:
        found = [word_features(w.decode("utf-8", "replace")) for w in new]
        if self.only is not None:
            found = [[self.only[x] for x in f if x in self.only] for f in found]
        ends = np.cumsum([len(f) for f in found]) + self.end[base]
        while base + len(new) + 1 > len(self.end):
            self.end = np.concatenate([self.end, np.zeros_like(self.end)])
        while ends[-1] > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.end[base + 1 : base + 1 + len(new)] = ends
        self.flat[self.end[base] : ends[-1]] = [x for f in found for x in f]

    def of(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(text, feature) pairs, each once, ordered by text."""
        if self.table.n > self.most or self.table.long_bytes + self.flat.nbytes > CACHE_BYTES:
            self._clear()
        lower = pa.array([t.lower() if t else "" for t in column.to_pylist()], pa.string())
        raw, off = string_bytes(lower)
        edge = np.zeros(len(raw) + 1, bool)
        edge[off] = True
        letter = LETTER[raw]
        before, after = np.concatenate([[False], letter[:-1]])[: len(raw)], np.concatenate([letter[1:], [False]])[: len(raw)]
        starts, ends = np.flatnonzero(letter & (~before | edge[:-1])), np.flatnonzero(letter & (~after | edge[1:])) + 1
        base = self.table.n
        which, new = self.table.numbers(raw, starts, ends)
        if new:
            self._learn(new, base)
        first = self.end[which]
        size = self.end[which + 1] - first
        some = size > 0
        text = np.repeat(np.searchsorted(off, starts[some], side="right") - 1, size[some])
        pairs = np.unique(text << BITS | self.flat[ragged(first[some], size[some])])
        return pairs >> BITS, pairs & ((1 << BITS) - 1)


def select_features(p: np.ndarray, u: np.ndarray, positive: int, unlabelled: int, prior: float, settings: Settings) -> np.ndarray:
    """The features that tell confirmed texts from the clean part of the unlabelled ones best.

    ``p`` and ``u`` count the texts of both kinds that have a feature, of ``positive`` and ``unlabelled`` texts.
    """
    a, b = p / max(1, positive), u / max(1, unlabelled)
    clean = np.clip((b - prior * a) / (1 - prior), 0, 1)
    spread = np.sqrt((a * (1 - a) + 1e-9) / max(1, positive) + (clean * (1 - clean) + 1.0 / max(1, unlabelled)) / max(1, unlabelled))
    score = np.where((p >= settings.least_positive) & (a > 2 * clean), (a - clean) / spread, 0)
    best = np.argsort(-score, kind="stable")[: settings.features]
    return best[score[best] > 3]


@dataclass(frozen=True)
class Rows:
    """The features of n texts, as (text, feature) pairs: most texts have few of them."""

    n: int
    text: np.ndarray
    feature: np.ndarray

    def times(self, theta: np.ndarray) -> np.ndarray:
        return np.bincount(self.text, theta[self.feature], self.n)

    def back(self, weights: np.ndarray, k: int) -> np.ndarray:
        return np.bincount(self.feature, weights[self.text], k)


def estimate_prior(p: np.ndarray, u: np.ndarray, positive: int, unlabelled: int, least: float = 0.1) -> float:
    """The share of positive texts among the unlabelled ones, from the features' counts in both (see ``select_features``).

    That is the least upper confidence bound (two standard errors) of the ratio of a feature's shares, over
    the features of at least a ``least`` share of positive texts, and three of them (or all, of fewer).
    """
    some = np.flatnonzero(p >= max(min(3, positive), least * positive, 1))
    if not len(some):
        return 0.5
    a, b = p[some] / positive, (u[some] + 1) / (unlabelled + 1)
    ratio = b / a
    error = ratio * np.sqrt((1 - b) / (b * unlabelled) + (1 - a) / (a * positive))
    return float(np.clip((ratio + 2 * error).min(), 1e-4, 0.95))


def risk(theta: np.ndarray, positive: Rows, unlabelled: Rows, prior: float) -> tuple[float, float, np.ndarray, np.ndarray]:
    """Of weights and bias: risk on positive texts, estimated risk on clean texts, and the gradients of both."""
    k = len(theta) - 1
    up = lambda x: 1 / (1 + np.exp(-np.clip(x, -30, 30)))
    gp, gu = positive.times(theta) + theta[k], unlabelled.times(theta) + theta[k]
    clean = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
    dp, du = prior * up(gp) / positive.n, up(gu) / unlabelled.n  # of l(-g)
    d = prior * (up(gp) - 1) / positive.n  # of l(g)
    return (
        float(prior * np.logaddexp(0, -gp).mean()),
        float(clean),
        np.append(positive.back(d, k), d.sum()),
        np.append(unlabelled.back(du, k) - positive.back(dp, k), du.sum() - dp.sum()),
    )


def fit(positive: Rows, unlabelled: Rows, k: int, prior: float, settings: Settings) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative risk with Adam.

    Every step takes all texts: the number of hidden toxic ones in a small batch varies so much
    that its estimate of the risk on clean texts is often negative by chance.
    """
    theta, m, v = np.zeros(k + 1), np.zeros(k + 1), np.zeros(k + 1)
    theta[k] = np.log(prior / (1 - prior))
    for t in range(settings.epochs):
        _, clean_risk, toxic, clean = risk(theta, positive, unlabelled, prior)
        gradient = -settings.gamma * clean if clean_risk < -settings.beta else toxic + clean
        gradient[:k] += settings.decay * theta[:k]
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        theta -= settings.rate * (m / (1 - 0.9 ** (t + 1))) / (np.sqrt(v / (1 - 0.999 ** (t + 1))) + 1e-8)
    return theta[:k], float(theta[k])


def held_out(folds: int, key: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % folds == 0, F.lit(False))


def _smallest(ids: DataFrame, n: int) -> DataFrame:
    """The n different doc_ids with the smallest hashes.

    Only hashes below a bound that some four times as many meet are told apart and sorted; if that
    leaves fewer than n, as where ids repeat, all are.
    """
    hashed = ids.select("doc_id", F.xxhash64("doc_id").alias("hash"))
    share = min(1.0, 4 * n / max(1, ids.count()))
    first = lambda rows: rows.distinct().orderBy("hash", "doc_id").limit(n).select("doc_id")
    some = first(hashed.where(F.col("hash") <= F.lit(min(2**63 - 1, -(2**63) + int(share * 2**64)))))
    return some if share == 1 or some.count() == n else first(hashed)


def train(docs: DataFrame, labels: DataFrame, settings: Settings | None = None) -> Model:
    """Fit a model on texts of ``docs`` (doc_id, text) that ``labels`` (doc_id, toxic) confirms as toxic.

    Rows whose crc32(doc_id) mod folds is 0 are never used, and of the labels only those that say toxic. Without a
    confirmed text the model scores every text near 0. Only feature numbers come to the driver, of
    at most most_positive + most_unlabelled texts, and most_pairs of them.
    """
    settings = settings or Settings()
    spark = docs.sparkSession
    small_batches(spark)
    toxic = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id IS NOT NULL AND toxic = 1").where(~held_out(settings.folds))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id IS NOT NULL").where(~held_out(settings.folds))
    chosen = _smallest(rows.select("doc_id").join(toxic, "doc_id", "left_semi"), settings.most_positive).withColumn("kind", F.lit(1))
    chosen = chosen.union(_smallest(rows.select("doc_id"), settings.most_unlabelled).withColumn("kind", F.lit(0)))
    texts = rows.join(F.broadcast(chosen), "doc_id").select("kind", F.xxhash64("doc_id").alias("hash"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = kept("words", Words)
        for part in text_slices(batches, "text", 2 << 20):
            text, feature = words.of(part.column("text"))
            ends = np.searchsorted(text, np.arange(part.num_rows + 1))
            yield pa.RecordBatch.from_arrays([part.column("kind"), part.column("hash"), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(feature.astype(np.int32)))], ["kind", "hash", "features"])

    sample = materialize(texts.mapInArrow(run, "kind int, hash long, features array<int>"), "sample")
    # Repeated ids bring all their rows, and texts may be long: what comes to the driver is cut by hash.
    sizes = sample.groupBy("kind", "hash").agg(F.sum(F.size("features")).alias("n"))
    upto = {}
    for kind in (0, 1):
        own, total, upto[kind] = sizes.where(F.col("kind") == kind).orderBy("hash").limit(settings.most_unlabelled + settings.most_positive).collect(), 0, None
        for r in own:
            if (total := total + r["n"]) > settings.most_pairs // 2:
                break
            upto[kind] = r["hash"]
    if None in upto.values():
        return Model()
    bounded = sample.where(" OR ".join(f"(kind = {k} AND hash <= {h})" for k, h in upto.items())).orderBy("kind", "hash").select("kind", "features")
    table = bounded.toArrow().combine_chunks()
    kind, lists = table.column("kind").to_numpy(), table.column("features").combine_chunks()
    flat, ends, cut = lists.flatten().to_numpy(), lists.offsets.to_numpy(), int(np.searchsorted(kind, 1))
    middle = ends[cut]  # features of unlabelled texts come before it
    # Only features of several confirmed texts matter: the others' counts are never held.
    p = np.bincount(flat[middle:], minlength=1 << BITS)
    able = np.flatnonzero(p >= settings.least_positive)
    column = np.full(1 << BITS, -1, np.int32)
    column[able] = np.arange(len(able))
    p, known = p[able], column[flat]
    u = np.bincount(known[:middle][known[:middle] >= 0], minlength=len(able))
    sizes = (len(kind) - cut, cut)
    prior = settings.prior or estimate_prior(p, u, *sizes)
    best = select_features(p, u, *sizes, prior, settings)
    if not len(best):
        return Model()
    place = np.full(len(able) + 1, -1, np.int32)
    place[best] = np.arange(len(best))
    rows_of = []
    for first, last in ((cut, len(kind)), (0, cut)):
        c = place[known[ends[first] : ends[last]]]  # -1 stays -1: the last place
        text = np.repeat(np.arange(last - first), np.diff(ends[first : last + 1]))
        rows_of.append(Rows(last - first, text[c >= 0], c[c >= 0]))
    weights, bias = fit(*rows_of, len(best), prior, settings)
    return Model(dict(zip(able[best].tolist(), weights.tolist(), strict=True)), bias)


def score(docs: DataFrame, model: Model, folds: int = 5, key: str = "doc_id") -> DataFrame:
    """(key, held_out, score, predicted) of every row of docs (key, text).

    A null or empty text has no features, so its score is the bias alone. Equal and null keys stay
    as rows (a null one is not held out); further columns are ignored; no rows give no rows.
    """
    small_batches(docs.sparkSession)
    number = {f: i for i, f in enumerate(model.weights)}
    weight = np.array([*model.weights.values(), 0.0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = kept(("words", tuple(number)), lambda: Words(number))
        for part in text_slices(batches, "text", 2 << 20):
            text, feature = words.of(part.column("text"))
            g = np.bincount(text, weight[feature], part.num_rows) + model.bias
            value = 1 / (1 + np.exp(-np.clip(g, -500, 500)))
            yield pa.RecordBatch.from_arrays([part.column(key), part.column("held_out"), pa.array(value), pa.array((value >= 0.5).astype(np.int32))], [key, "held_out", "score", "predicted"])

    rows = docs.select(F.col(key).cast("long").alias(key), F.col("text").cast("string").alias("text")).withColumn("held_out", held_out(folds, key))
    return rows.mapInArrow(run, f"{key} long, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs whose text scores below 0.5, with all their columns, without a shuffle.

    A null or empty text scores by the bias alone, so it stays if the model calls texts without features clean.
    """
    small_batches(docs.sparkSession)
    number = {f: i for i, f in enumerate(model.weights)}
    weight = np.array([*model.weights.values(), 0.0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = kept(("words", tuple(number)), lambda: Words(number))
        for part in text_slices(batches, "text", 2 << 20):
            text, feature = words.of(part.column("text"))
            yield part.filter(pa.array(np.bincount(text, weight[feature], part.num_rows) + model.bias < 0))

    return docs.mapInArrow(run, docs.schema)
