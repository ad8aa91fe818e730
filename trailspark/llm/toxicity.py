"""Toxicity scoring with subword-bag embeddings averaged into a linear softmax.

A word is the bag of its character n-grams, hashed into embedding buckets; a window of words is the average of their
vectors; a softmax layer reads the average. Embeddings and layer are trained together in numpy on a bounded sample of
labelled texts. A text's label says only that some part of it is toxic, so training alternates between choosing each
text's most toxic window and fitting the windows, after a start on whole-text averages; windows of clean texts that look
toxic are kept over the turns. Of the words of toxic windows only a random part of the n-grams is shown in each step, so
a word's value spreads over all of its n-grams and survives an unseen spelling. A fifth of the sample is left out and
sets scale and shift of the logits, so that scores are probabilities. A text scores as its most toxic window, at any
length; a word that follows itself counts once, and a text shorter than a window is filled up with words of no weight. A run of more than LONGEST characters without white space (an unspaced script, words joined by
slashes or markup) is read as several words: cut at punctuation, and what is still longer into pieces that overlap by
MOST - 1 characters, so that every n-gram of it is in a window.

Because the layer is linear, a trained model folds into one number a bucket, and a word's contribution is the mean of
its buckets' numbers: an unseen spelling takes its value from the n-grams that it shares.

Edge cases: a null or empty text, or one without words, scores 0. Without labels of both kinds nothing can be learned
and every text scores 0. Labels whose document is missing, null labels and null ids are ignored; a document labelled
twice counts as toxic if one label says so. Of rows that repeat a labelled id, the text that sorts first teaches, so a
rerun learns the same. Repeated rows score alike. Other columns of the input are left alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailspark.operators.scratch import small, written

from .common import first_by_hash, fitted, held_out, in_steps, parts

THRESHOLD = 0.3
LEAST, MOST = 3, 6
_EDGES = ".,;:|()[]{}\"!?*&%$#'`~_-+="
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Characters of the longest run that is one word, and of the pieces of a longer one.
LONGEST, PIECE = 40, 12
_JOINTS = re.compile(r"[!-/:-@\[-`{-~、。，；：！？「」（）・…]+")


def words_of(text: str | None) -> list[str]:
    words = [w for w, _ in groupby((text or "").lower().split())]
    if max(map(len, words), default=0) <= LONGEST:
        return words
    return [p for w in words for p in (pieces(w) if len(w) > LONGEST else [w])]


def pieces(run: str) -> list[str]:
    """The words of a run without white space that is too long for one word."""
    core = run.strip(_EDGES) or run
    if len(core) <= LONGEST:
        return [core]
    found = [p for p in _JOINTS.split(core) if p] or [core]
    out: list[str] = []
    for part in found:
        out += [part] if len(part) <= LONGEST else [part[i : i + PIECE] for i in range(0, len(part) - MOST + 1, PIECE - MOST + 1)]
    return out


def ngrams(words: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed character n-grams of every word between < and >: flat, and each word's number. A mark alone is its one n-gram."""
    marked = [f"<{w.strip(_EDGES) or w}>" for w in words]
    length = np.fromiter(map(len, marked), np.int64, len(marked))
    last = np.repeat(np.cumsum(length), length)
    word = np.repeat(np.arange(len(marked)), length)
    points = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    place = np.arange(len(points))
    hashes, owner = [], []
    rolling = np.zeros(len(points), np.uint64)
    for n in range(1, MOST + 1):
        inside = place + n <= last
        rolling = rolling * _BASE + np.where(inside, points[np.minimum(place + n - 1, len(points) - 1)], np.uint64(0))
        if n >= LEAST:
            hashes.append(rolling[inside] * np.uint64(2 * n + 1))
            owner.append(word[inside])
    mixed = np.concatenate(hashes)
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    owner = np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return ((mixed >> np.uint64(33)) % np.uint64(buckets)).astype(np.int32)[order], np.bincount(owner, minlength=len(marked))


@dataclass(frozen=True)
class ToxicityModel:
    """bucket_logits: the softmax's logit of `toxic` against `clean` for each embedding bucket; bias: the same of no word."""

    bucket_logits: np.ndarray
    bias: float
    window: int = 2
    #: Words whose value a task remembers at most, and their characters.
    known_words: int = 100_000
    known_chars: int = 2_000_000
    _memo: dict = field(default_factory=dict, repr=False, compare=False)

    def __getstate__(self):
        return self.__dict__ | {"_memo": {}}

    def __setstate__(self, state):
        self.__dict__.update(state)

    def word_logits(self, words: list[str]) -> list[float]:
        flat, size = ngrams(words, len(self.bucket_logits))
        return (np.add.reduceat(self.bucket_logits[flat], np.cumsum(size) - size) / size).tolist()

    def scores(self, texts: list[str | None]) -> np.ndarray:
        out, memo = np.zeros(len(texts)), self._memo
        if not len(self.bucket_logits):
            return out
        for start, end in in_steps([t or "" for t in texts], 1 << 20):
            split = [words_of(t) for t in texts[start:end]]
            if new := list(set().union(*split).difference(memo)):
                if len(memo) + len(new) > self.known_words or sum(map(len, memo)) > self.known_chars:
                    memo.clear()
                    new = list(set().union(*split))
                for at in range(0, len(new), 20_000):
                    memo.update(zip(new[at : at + 20_000], self.word_logits(new[at : at + 20_000]), strict=True))
            for i, words in enumerate(split, start):
                if words:
                    wide = min(self.window, len(words))
                    sums = np.cumsum(np.fromiter(map(memo.__getitem__, words), np.float64, len(words)))
                    most = max(sums[wide - 1], (sums[wide:] - sums[:-wide]).max(initial=-np.inf))
                    out[i] = 1.0 / (1.0 + np.exp(-np.clip(most / self.window + self.bias, -50.0, 50.0)))
        return out


class _Bags:
    """The n-grams of a vocabulary, flat: gram, and the first of each word."""

    def __init__(self, vocabulary: list[str], buckets: int):
        parts = [ngrams(vocabulary[i : i + 10_000], buckets) for i in range(0, len(vocabulary), 10_000)]
        self.flat, self.size = (np.concatenate(x) for x in zip(*parts, strict=True))
        self.first = np.concatenate(([0], np.cumsum(self.size)))
        self.shown = None

    def means(self, rows: np.ndarray) -> np.ndarray:
        """The average of a vector or matrix over the grams of every word; grams that aren't shown count as zero."""
        size, grams = (self.size, rows[self.flat]) if rows.ndim == 1 else (self.size[:, None], rows[self.flat])
        if self.shown is not None:
            grams = grams * (self.shown if rows.ndim == 1 else self.shown[:, None])
        return np.add.reduceat(grams, self.first[:-1], axis=0) / size

    def show(self, share: float, words: int, rng: np.random.Generator) -> None:
        """Show a random part of the grams of the first words, so that their value can't rest on a few grams."""
        self.shown = np.ones(len(self.flat))
        self.shown[: self.first[words]] = rng.random(self.first[words]) < share

    def part(self, words: np.ndarray) -> _Bags:
        out = object.__new__(_Bags)
        out.size = self.size[words]
        out.first, out.shown = np.concatenate(([0], np.cumsum(out.size))), None
        out.flat = self.flat[np.repeat(self.first[words] - out.first[:-1], out.size) + np.arange(out.first[-1])]
        return out


def _scatter(index: np.ndarray, rows: np.ndarray, size: int) -> np.ndarray:
    return np.stack([np.bincount(index, weights=column, minlength=size) for column in rows.T], axis=1)


#: A coordinate with little gradient moves as if it had this part of the largest one, so rare n-grams don't run ahead.
FLOOR = 0.1
#: The logit of words without value lies between these while the model is trained.
BIAS = (-8.0, -3.0)
#: Windows of clean texts with a lower logit are forgotten until they are the text's most toxic again.
EASY = -4.0


class _Softmax:
    """Embeddings and a two-class layer. A step is the gradient's running mean over its running size, coordinate by
    coordinate; embeddings and layer decay, and a bounded bias keeps words without value clean."""

    def __init__(self, buckets: int, width: int, rng: np.random.Generator, decay: float):
        self.table = rng.normal(0.0, 0.01, (buckets, width))
        self.layer, self.bias = rng.normal(0.0, 1.0, (width, 2)), np.zeros(2)
        self.seen = [np.zeros_like(x) for x in (self.table, self.layer, self.bias)]
        self.squares, self.steps, self.decay = [np.zeros_like(x) for x in self.seen], 0, decay

    def logits(self) -> np.ndarray:
        return self.table @ (self.layer[:, 1] - self.layer[:, 0])

    def step(self, bags: _Bags, words: np.ndarray, group: np.ndarray, label: np.ndarray, weight: np.ndarray, rate: float, size: int = 0) -> None:
        """words: places in bags, group: the example that each belongs to, label and weight: by example. An average is over
        `size` words, as if a shorter example were filled up with words of no weight, or over the example's own."""
        n = len(label)
        count = np.full((n, 1), float(size)) if size else np.bincount(group, minlength=n).astype(float)[:, None]
        vectors = bags.means(self.table)
        pooled = _scatter(group, vectors[words], n) / count
        z = pooled @ self.layer + self.bias
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(n), label] -= 1.0
        d = p * (weight / weight.sum())[:, None]
        to_words = _scatter(words, ((d @ self.layer.T) / count)[group], len(bags.size)) / bags.size[:, None]
        to_grams = np.repeat(to_words, bags.size, axis=0)
        to_table = _scatter(bags.flat, to_grams if bags.shown is None else to_grams * bags.shown[:, None], len(self.table))
        self.steps += 1
        for value, seen, square, grad in zip((self.table, self.layer, self.bias), self.seen, self.squares, (to_table, pooled.T @ d, d.sum(axis=0)), strict=True):
            seen += 0.2 * (grad - seen)
            square += 0.05 * (grad * grad - square)
            size = np.sqrt(square / (1.0 - 0.95**self.steps))
            value *= 1.0 - rate * self.decay
            value -= rate * (seen / (1.0 - 0.8**self.steps)) / (size + FLOOR * size.max() + 1e-9)
        self.bias[:] = np.array([-0.5, 0.5]) * np.clip(self.bias[1] - self.bias[0], *BIAS)


def _fit(texts: list[str], labels: list[int], buckets: int = 1 << 16, width: int = 6, window: int = 2, warm_steps: int = 60, turns: int = 30, steps: int = 8, seed: int = 7, warm_rate: float = 0.1, rate: float = 0.3, decay: float = 1e-3, shown: float = 0.4) -> ToxicityModel:
    """Embeddings and layer of labelled texts, folded; an empty model without both labels. shown: the part of n-grams."""
    label = np.array(labels, np.int64)
    # A text becomes numbers at once: lists of all words of all texts would take ten times the texts' size.
    place: dict[str, int] = {}
    ids = [np.array([place.setdefault(w, len(place)) for w in words_of(t)], np.int32) for t in texts]
    keep = [i for i, d in enumerate(ids) if len(d)]
    ids, label = [ids[i] for i in keep], label[keep]
    if len(set(label.tolist())) < 2:
        return ToxicityModel(np.zeros(0), 0.0, window)
    bags, rng = _Bags(list(place), buckets), np.random.default_rng(seed)
    del place
    net = _Softmax(buckets, width, rng, decay)
    balance = np.where(label == 1, len(label) / (2.0 * (label == 1).sum()), len(label) / (2.0 * (label == 0).sum()))
    unique = [np.unique(d) for d in ids]
    used, words = np.unique(np.concatenate(unique), return_inverse=True)
    frequent = np.bincount(words) > 1
    group = np.repeat(np.arange(len(unique)), [len(u) for u in unique])
    if frequent.any() and len(np.unique(group[frequent[words]])) > 1:
        kept = frequent[words]
        small, inner = np.unique(used[words[kept]], return_inverse=True)
        present, inner_group = np.unique(group[kept], return_inverse=True)
        part = bags.part(small)
        for _ in range(warm_steps):
            net.step(part, inner, inner_group, label[present], balance[present], warm_rate)
    flat, first = np.concatenate(ids), np.concatenate(([0], np.cumsum([len(d) for d in ids])))
    hard: list[set[int]] = [set() for _ in ids]
    for turn in range(turns):
        values = bags.means(net.logits())[flat]
        sums = np.concatenate(([0.0], np.cumsum(values)))
        lean = float(net.bias[1] - net.bias[0])
        chosen, owner, target = [], [], []
        for i, doc in enumerate(ids):
            wide = min(window, len(doc))
            run = sums[first[i] + wide : first[i + 1] + 1] - sums[first[i] : first[i + 1] + 1 - wide]
            top = int(run.argmax())
            if label[i]:
                starts = [top]
            else:
                # A clean text shows its most toxic window, those of earlier turns that still look toxic, and another place.
                hard[i] = {s for s in hard[i] if run[s] / window + lean > EASY} | {top}
                starts = [*sorted(hard[i]), int(rng.integers(len(run)))]
            for start in starts:
                chosen.append(doc[start : start + wide])
                owner.append(np.full(wide, len(target)))
                target.append(int(label[i]))
        kind = np.array(target)
        weight = np.where(kind == 1, 0.5 / max(1, (kind == 1).sum()), 0.5 / max(1, (kind == 0).sum()))
        # Words of toxic windows stand apart from the same words of clean ones, since only they are shown in part.
        of = np.repeat(kind, [len(c) for c in chosen])
        small, inner = np.unique(np.concatenate(chosen) + np.where(of == 1, 0, len(bags.size)), return_inverse=True)
        part, group, toxic_words = bags.part(small % len(bags.size)), np.concatenate(owner), int((small < len(bags.size)).sum())
        for _ in range(steps):
            part.show(shown, toxic_words, rng)
            net.step(part, inner, group, kind, weight, rate * (1.0 - turn / turns) + 0.002, window)
    return ToxicityModel(net.logits().astype(np.float32), float(net.bias[1] - net.bias[0]), window)


def calibrated(model: ToxicityModel, texts: list[str], labels: list[int], shares: dict[int, float] | None = None) -> ToxicityModel:
    """The model with logits scaled and shifted so that scores are probabilities on texts that it wasn't fitted on. Priors
    keep the scale near one and the shift near zero where these texts say little. shares: how frequent each label is."""
    label = np.array(labels)
    some = [i for i, t in enumerate(texts) if words_of(t)]
    label, p = label[some], model.scores([texts[i] for i in some])
    if len(set(label.tolist())) < 2:
        return model
    z = np.log(np.maximum(p, 1e-300)) - np.log(np.maximum(1.0 - p, 1e-300))
    part = {k: float((label == k).mean()) for k in (0, 1)}
    weight = np.where(label == 1, (shares or part)[1] / part[1], (shares or part)[0] / part[0])
    sign = np.where(label == 1, -1.0, 1.0)

    def loss(scale: float, shift: float) -> float:
        return float((weight * np.logaddexp(0.0, sign * (scale * z + shift))).sum() + 2.0 * np.log(scale) ** 2 + shift * shift / 18.0)

    scale, shift = min(((a, b) for a in np.geomspace(0.05, 2.0, 60) for b in np.linspace(-12.0, 6.0, 91)), key=lambda x: loss(*x))
    return ToxicityModel((model.bucket_logits * scale).astype(np.float32), float(model.bias * scale + shift), model.window)


def fit(texts: list[str], labels: list[int], shares: dict[int, float] | None = None, folds: int = 5, **options) -> ToxicityModel:
    """Train on all folds of the texts but the last and calibrate on that one. Without both labels, score everything 0."""
    fitted, rest = ([i for i in range(len(texts)) if (i % folds == folds - 1) == apart] for apart in (False, True))
    model = _fit([texts[i] for i in fitted], [labels[i] for i in fitted], **options)
    if not len(model.bucket_logits):
        return _fit(texts, labels, **options)
    return calibrated(model, [texts[i] for i in rest], [labels[i] for i in rest], shares)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", documents_per_label: int = 1500, longest: int = 12_000, **options) -> ToxicityModel:
    """Fit on at most documents_per_label texts of each label, the first by a hash of the id, of up to longest characters.

    Held-out rows are never read. The driver gets the model alone. Only ids with such a text are ranked, so longer texts don't thin the sample out.
    """
    marked = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where(F.col("id").isNotNull() & F.col("label").isin(0, 1))
    marked = marked.where(~held_out(F.col("id"))).groupBy("id").agg(F.max("label").alias("label"))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.length("text").between(1, longest))
    marked = marked.join(texts.select("id"), "id", "left_semi").withColumn("h", F.xxhash64(F.col("id").cast("string")))
    marked = written(marked, "marked")
    total = {r.label: r["count"] for r in marked.groupBy("label").count().collect()}
    chosen = written(first_by_hash(marked, "label", documents_per_label).select("id", "label"), "chosen")
    shares = {k: n / sum(total.values()) for k, n in total.items()} if len(total) == 2 else None

    def learned(rows: list[dict]) -> ToxicityModel:
        rows.sort(key=lambda r: r["id"])
        return fit([r["text"] for r in rows], [r["label"] for r in rows], shares, **options)

    return fitted(texts.join(small(chosen), "id").groupBy("id", "label").agg(F.min("text").alias("text")), learned)


def predict(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches):
            scores = model.scores(part.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def keep_clean(docs: DataFrame, model: ToxicityModel, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all columns, that score below the threshold. Nothing is shuffled."""
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches):
            yield part.filter(pa.array(model.scores(part.column(place).to_pylist()) < threshold))

    return docs.mapInArrow(run, docs.schema)
