"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Each word is clean or toxic. A word's features are its own hash and those of its first four and five bytes;
a transition score joins neighbours. Labels of documents become labels of words so: in documents that are
labelled toxic, the words whose features stand in toxic documents far more often than chance allows are
toxic, all other words are clean. The field is trained on those sequences by gradient ascent of the
conditional likelihood. Forward and backward sums give each word's marginal; the highest marginal and the
expected number of toxic words of a document give its score, by a logistic function fitted on the same
training documents. Words without any trained feature all have the same potential, so a run of them is one
power of a matrix and scoring takes time by the words that matter.

Training takes a bounded sample: of the SAMPLE labelled documents that come first by a hash of doc_id, those whose
whole texts have SAMPLE_CHARS code points together.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notewright.llm.shared import arrow, give_back, parts, text_bytes, with_texts
from notewright.llm.vectext import mix, ranges_hash, slices, word_ranges

SAMPLE, SAMPLE_CHARS = 4000, 24_000_000  #: labelled documents that the field is trained on at most, and their code points
WINDOW = 64  #: words of a training sequence
ROUNDS, RATE, PENALTY = 60, 0.25, 1e-4  #: of the gradient ascent
CHANCE, PURITY = 1.0, 0.8  #: of features of toxic words: how many may be there by chance, share of their documents that are toxic
LONGEST_POWER = 256  #: matrix powers beyond this are equal to it

#: What separates words: all of ASCII but letters and digits.
_APART = np.array([x < 128 and not chr(x).isalnum() for x in range(256)])


def _features(texts: list[bytes]):
    """(data, begins, owner, start, end, features of shape (words, 3))."""
    data, begins, owner, start, end = word_ranges(texts, _APART)
    kinds = [ranges_hash(data, start, end)] + [ranges_hash(data, start, np.minimum(start + k, end)) for k in (4, 5)]
    return data, begins, owner, start, end, np.stack([mix(h + np.uint64(i)) for i, h in enumerate(kinds)], axis=1)


@dataclass
class Field:
    """A trained field: weights of known features in favour of toxic, a bias, transition scores, and the logistic function of documents."""

    known: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    weight: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = -8.0
    transition: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    logistic: tuple[float, float, float] = (0.0, 0.0, -2.0)  # of the highest marginal's logit, of the expected number, constant

    def potentials(self, features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(score for toxic, whether any feature is known) of each word."""
        if not len(self.known):
            return np.full(len(features), self.bias), np.zeros(len(features), bool)
        at = np.minimum(np.searchsorted(self.known, features), len(self.known) - 1)
        hit = self.known[at] == features
        return self.bias + np.where(hit, self.weight[at], 0.0).sum(axis=1), hit.any(axis=1)

    def _powers(self) -> list[np.ndarray]:
        step = np.exp(self.transition) * np.exp([0.0, self.bias])
        step /= np.abs(np.linalg.eigvals(step)).max()
        out = [np.eye(2)]
        for _ in range(LONGEST_POWER):
            out.append(out[-1] @ step)
        return out

    def marginals(self, score: np.ndarray, place: np.ndarray, n: int, powers: list[np.ndarray]) -> np.ndarray:
        """P(toxic) of the words at `place` among n words; all others have the common potential."""
        transition = np.exp(self.transition)
        gap = np.diff(np.concatenate([[-1], place, [n]])) - 1
        ahead = [None] * len(place)
        state = np.ones(2) / 2
        first = True
        for i, g in enumerate(gap[:-1].tolist()):
            if g:
                steps = g - first  # the first word of all has no transition before it
                state = (np.exp([0.0, self.bias]) if first else state) @ powers[min(steps, LONGEST_POWER)]
                first = False
            state = (state if first else state @ transition) * np.exp([0.0, min(score[i], 60.0)])
            first = False
            state = state / state.sum()
            ahead[i] = state
        back = np.ones(2)
        out = np.empty(len(place))
        for i in range(len(place) - 1, -1, -1):
            back = powers[min(int(gap[i + 1]), LONGEST_POWER)] @ back
            p = ahead[i] * back
            out[i] = p[1] / p.sum()
            back = transition @ (np.exp([0.0, min(score[i], 60.0)]) * back)
            back = back / back.sum()
        return out

    def score_texts(self, texts: list[bytes]):
        """For each text (highest marginal, expected number of toxic words, [(start byte, end byte, marginal)])."""
        out = [(0.0, 0.0, [])] * len(texts)
        powers = self._powers()
        for i, j in slices(texts):
            _, begins, owner, start, end, features = _features(texts[i:j])
            score, hit = self.potentials(features)
            n = np.bincount(owner, minlength=j - i)
            first = np.concatenate([[0], np.cumsum(n)])
            hits = np.flatnonzero(hit)
            for run in np.split(hits, np.flatnonzero(np.diff(owner[hits])) + 1) if len(hits) else []:
                k = int(owner[run[0]])
                p = self.marginals(score[run], run - first[k], int(n[k]), powers)
                spans = [(int(start[w] - begins[k]), int(end[w] - begins[k]), float(x)) for w, x in zip(run, p) if x >= 0.5]
                out[i + k] = (float(p.max()), float(p.sum()), spans)
        return out

    def document_score(self, most: np.ndarray, expected: np.ndarray) -> np.ndarray:
        a, b, c = self.logistic
        return 1 / (1 + np.exp(-np.clip(a * _logit(most) + b * np.log1p(expected) + c, -30, 30)))


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p)) / 9.21


def _toxic_features(owner: np.ndarray, features: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Features that tell toxic documents from others, by the log-likelihood ratio of their document counts."""
    found = []
    for k in range(features.shape[1]):
        order = np.lexsort((owner, features[:, k]))
        f, doc = features[order, k], owner[order]
        once = np.concatenate([[True], (f[1:] != f[:-1]) | (doc[1:] != doc[:-1])])
        f, doc = f[once], doc[once]
        first = np.concatenate([[True], f[1:] != f[:-1]])
        names, at = f[first], np.cumsum(first) - 1
        t = np.bincount(at, toxic[doc], len(names))
        n = np.bincount(at, minlength=len(names)) - t
        share = (t + n) / len(toxic)
        et, en = share * toxic.sum(), share * (len(toxic) - toxic.sum())
        ratio = 2 * (t * np.log(np.maximum(t, 1e-9) / et) + n * np.log(np.maximum(n, 1e-9) / np.maximum(en, 1e-9)))
        least = 2 * np.log(max(2, np.count_nonzero(t + n >= 3) / CHANCE))  # exp(-ratio / 2) bounds the chance of each
        found.append(names[(ratio >= least) & (t >= PURITY * (t + n))])
    return np.unique(np.concatenate(found))


def train(texts: list[bytes], toxic: np.ndarray) -> Field:
    """Fit a field on labelled documents; with one class only, a constant score."""
    toxic = np.asarray(toxic, float)
    model = Field()
    rate = (toxic.sum() + 0.5) / (len(toxic) + 1)
    model.logistic = (0.0, 0.0, float(min(np.log(rate / (1 - rate)), -0.1)))
    if not 0 < toxic.sum() < len(toxic):
        return model
    owner, features = [], []
    for i, j in slices(texts, 1 << 20):
        found = _features(texts[i:j])
        owner.append((found[2] + i).astype(np.int32))
        features.append(found[5])
        del found
    owner, features = np.concatenate(owner), np.concatenate(features)
    if not len(owner):
        return model
    seeds = _toxic_features(owner, features, toxic)
    label = np.zeros(len(owner), bool)
    for k in range(features.shape[1] if len(seeds) else 0):  # column by column, by search: less memory than a sort of all
        label |= seeds[np.minimum(np.searchsorted(seeds, features[:, k]), len(seeds) - 1)] == features[:, k]
    label &= toxic[owner] > 0
    if not label.any():
        return model
    model.known = np.unique(features[label])

    # Sequences of WINDOW words inside documents: all with toxic words, and as many others, evenly taken.
    n = np.bincount(owner, minlength=len(texts))
    first = np.concatenate([[0], np.cumsum(n)])[:-1]
    window = (np.arange(len(owner)) - first[owner]) // WINDOW
    begins = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (window[1:] != window[:-1])]))
    ends = np.concatenate([begins[1:], [len(owner)]])
    has = np.add.reduceat(label.astype(np.int64), begins) > 0
    others = np.flatnonzero(~has)
    chosen = np.concatenate([np.flatnonzero(has), others[np.linspace(0, len(others) - 1, min(len(others), 2 * int(has.sum()) + 50)).astype(int)] if len(others) else others])
    at = np.full((len(chosen), WINDOW), -1)
    for row, c in enumerate(chosen):
        at[row, : ends[c] - begins[c]] = np.arange(begins[c], ends[c])
    model.weight = np.zeros(len(model.known))
    model.bias = -4.0
    model.transition = np.zeros((2, 2))
    _ascend(model, features[np.maximum(at, 0)], label[np.maximum(at, 0)] & (at >= 0), at >= 0)

    found = model.score_texts(texts)
    _fit_logistic(model, np.array([x[0] for x in found]), np.array([x[1] for x in found]), toxic)
    return model


def _ascend(model: Field, features: np.ndarray, label: np.ndarray, real: np.ndarray) -> None:
    """Adam on the conditional log-likelihood of all sequences together."""
    rows, length = label.shape
    at = np.minimum(np.searchsorted(model.known, features), len(model.known) - 1)
    hit = (model.known[at] == features) & real[:, :, None]
    y = label.astype(np.int64)
    first, second = 0.0, 0.0
    for t in range(1, ROUNDS + 1):
        emit = np.stack([np.zeros((rows, length)), model.bias + np.where(hit, model.weight[at], 0.0).sum(axis=2)], axis=2)
        emit = np.exp(np.clip(emit, -40, 40))
        trans = np.exp(model.transition)
        ahead, back = np.empty((length, rows, 2)), np.ones((length, rows, 2))
        ahead[0] = emit[:, 0] / emit[:, 0].sum(axis=1, keepdims=True)
        for i in range(1, length):
            a = np.where(real[:, i, None], (ahead[i - 1] @ trans) * emit[:, i], ahead[i - 1])
            ahead[i] = a / a.sum(axis=1, keepdims=True)
        for i in range(length - 2, -1, -1):
            b = np.where(real[:, i + 1, None], (emit[:, i + 1] * back[i + 1]) @ trans.T, back[i + 1])
            back[i] = b / b.sum(axis=1, keepdims=True)
        p = ahead * back
        p = (p[:, :, 1] / p.sum(axis=2)).T
        error = np.where(real, y - p, 0.0)
        g_weight = np.bincount(at[hit], np.broadcast_to(error[:, :, None], hit.shape)[hit], len(model.known))
        g_trans = np.zeros((2, 2))
        for i in range(1, length):
            r = real[:, i]
            pair = ahead[i - 1][r][:, :, None] * trans[None] * (emit[r, i] * back[i][r])[:, None, :]
            g_trans -= (pair / pair.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
            np.add.at(g_trans, (y[r, i - 1], y[r, i]), 1.0)
        g = np.concatenate([g_weight, [error.sum()], g_trans.ravel()]) / rows
        now = np.concatenate([model.weight, [model.bias], model.transition.ravel()])
        g -= PENALTY * now
        first, second = 0.9 * first + 0.1 * g, 0.99 * second + 0.01 * g * g
        now = now + RATE * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-8)
        model.weight, model.bias, model.transition = now[:-5], float(now[-5]), now[-4:].reshape(2, 2)


def _fit_logistic(model: Field, most: np.ndarray, expected: np.ndarray, toxic: np.ndarray) -> None:
    """Newton's method with a small penalty."""
    x = np.stack([_logit(most), np.log1p(expected), np.ones(len(most))], axis=1)
    w = np.zeros(3)
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag([0.05, 0.05, 0.001])
        w = w + np.linalg.solve(h, x.T @ (toxic - p) - np.array([0.05, 0.05, 0.001]) * w)
    model.logistic = tuple(float(v) for v in w)


def held_out(column: str = "doc_id") -> F.Column:
    """Whether a row is kept from training: crc32 of doc_id as text, modulo 5, is 0. A null doc_id is not in training either."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def train_on_sample(docs: DataFrame, labels: DataFrame) -> Field:
    """A field from the labelled documents that are not held out; labels: doc_id, toxic (nulls are left out).

    The driver gets SAMPLE whole documents at most, in the order of a hash of doc_id, and of these the ones that fit into
    SAMPLE_CHARS code points together. Of texts that have one doc_id the one with the least hash is taken."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)").where(~held_out())
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE).collect()  # SAMPLE rows at most
    spark = docs.sparkSession
    toxic = {r.doc_id: r.toxic for r in sample}
    rows = with_texts(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("hash", F.xxhash64("text"))
    chosen = F.broadcast(spark.createDataFrame([(k,) for k in toxic], "doc_id long"))
    sizes = rows.join(chosen, "doc_id").groupBy("doc_id").agg(F.min(F.struct("hash", F.length("text").alias("n"))).alias("pick")).collect()
    sizes = {r.doc_id: r.pick for r in sizes}
    picked, left = [], SAMPLE_CHARS
    for k in toxic:
        if k in sizes and sizes[k].n <= left:
            picked.append((k, sizes[k].hash))
            left -= sizes[k].n
    chosen = F.broadcast(spark.createDataFrame(picked, "doc_id long, hash long"))
    taken = rows.join(chosen, ["doc_id", "hash"]).groupBy("doc_id").agg(F.min("text").alias("text")).toArrow().sort_by("doc_id")
    try:
        return train(taken.column("text").cast(pa.binary()).to_pylist(), np.array([toxic[k] for k in taken.column("doc_id").to_pylist()]))
    finally:
        del taken
        give_back()  # the driver's memory too


def _scores(model: Field):
    def run(batches):
        for batch in parts(batches):
            texts = text_bytes(batch.column("text"))
            found = model.score_texts(texts)
            score = model.document_score(np.array([x[0] for x in found]), np.array([x[1] for x in found])) if found else np.zeros(0)
            spans = []
            for text, (_, _, marked) in zip(texts, found):
                spans.append([{"start": len(text[:a].decode("utf-8", "replace")), "end": len(text[:b].decode("utf-8", "replace")), "p": p} for a, b, p in marked])
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score, pa.float64()), pa.array(spans, kind)], ["doc_id", "score", "spans"])

    return run


def toxicity(docs: DataFrame, labels: DataFrame, model: Field | None = None) -> DataFrame:
    """One row for each of docs (doc_id, text): doc_id, held_out, score (0 to 1), predicted (1 from 0.5), spans in code points.

    A null or empty text scores as one without any telling word. Repeated rows each give a row; a null doc_id
    stays null; without labels of both kinds the score is a constant under 0.5; other columns are no input."""
    model = model or train_on_sample(docs, labels)
    scored = arrow(with_texts(docs), _scores(model), "doc_id long, score double, spans array<struct<start: long, end: long, p: double>>")
    return scored.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), "spans")


def _clean(model: Field):
    def run(batches):
        for batch in parts(batches):
            found = model.score_texts(text_bytes(batch.column("text")))
            score = model.document_score(np.array([x[0] for x in found]), np.array([x[1] for x in found])) if found else np.zeros(0)
            yield batch.filter(pa.array(score < 0.5))

    return run


def drop_toxic(docs: DataFrame, labels: DataFrame, model: Field | None = None) -> DataFrame:
    """The rows of docs, with all their columns, that are not predicted to be toxic."""
    return arrow(docs, _clean(model or train_on_sample(docs, labels)), docs.schema)
