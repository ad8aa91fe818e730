"""Mixing towards target weights with soft domain membership.

A softmax classifier over hashed byte trigrams, trained in numpy on a bounded sample of a labelled table, gives every
document a posterior over domains. Document rates r >= 0 are then fitted so that the expected tokens of each domain,
sum of r * tokens * posterior, meet the targets: least squares by projected gradient, where each step is one distributed
sum over all documents. The squares are weighted by the inverse of sum of tokens * posterior * posterior', in which
norm the gradient is Lipschitz with constant 1, so unit steps converge; without a rate at zero the first one lands.
A step moves a document's rate by a linear function of its posterior, so the steps' vectors are all the state there is.

Edge cases: a null or empty text has no tokens and the posterior of the labelled shares. Labels of missing documents,
null domains and null ids teach nothing; a document labelled twice counts with the domain that sorts first; of rows that
repeat a labelled id, the text that sorts first teaches. A target for a domain that was never learned can't be met: it is
left out with a warning, and the others keep their proportions. With no label, or no positive target of a learned domain,
every rate is 1. A learned domain without a target has target 0; a target that is negative or not finite is an error.
Repeated rows get equal rates. Other columns are left alone.
"""

from __future__ import annotations

import warnings
import zlib
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailspark.operators.scratch import small, written

from .common import first_by_hash, fitted, parts

FEATURES = 2048
_PART = 1 << 20


def features(text: bytes | None, size: int = FEATURES) -> np.ndarray:
    """Square roots of the shares of hashed byte trigrams, over the whole text."""
    raw, counts = np.frombuffer(text or b"", np.uint8), np.zeros(size)
    for at in range(0, max(len(raw) - 2, 0), _PART):
        part = raw[at : at + _PART + 2].astype(np.uint32)
        mixed = part[:-2] * np.uint32(0x9E3779B1) + part[1:-1] * np.uint32(0x85EBCA6B) + part[2:] * np.uint32(0xC2B2AE35)
        counts += np.bincount((mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(32 - size.bit_length() + 1), minlength=size)
    return np.sqrt(counts / max(counts.sum(), 1.0)).astype(np.float32)


@dataclass(frozen=True)
class DomainModel:
    domains: tuple[str, ...]
    layer: np.ndarray
    bias: np.ndarray

    def posteriors(self, texts: list[bytes | None]) -> np.ndarray:
        if not self.domains:
            return np.zeros((len(texts), 0))
        out = np.zeros((len(texts), len(self.domains)))
        for at in range(0, len(texts), 256):
            x = np.stack([features(t) for t in texts[at : at + 256]])
            z = x @ self.layer + np.where(x.any(axis=1)[:, None], self.bias, self.bias_alone)
            p = np.exp(z - z.max(axis=1, keepdims=True))
            out[at : at + 256] = p / p.sum(axis=1, keepdims=True)
        return out

    #: The logits of an empty text.
    bias_alone: np.ndarray = field(default_factory=lambda: np.zeros(0))


def fit_softmax(x: np.ndarray, label: np.ndarray, shares: np.ndarray, steps: int = 400, rate: float = 20.0, decay: float = 1e-5) -> tuple[np.ndarray, np.ndarray]:
    """Layer and bias; classes weigh alike in training, and their shares enter through the bias."""
    k = len(shares)
    layer, bias, moved, moved_bias = np.zeros((x.shape[1], k)), np.zeros(k), 0.0, 0.0
    weight = (1.0 / np.bincount(label, minlength=k).clip(1))[label] / k
    for _ in range(steps):
        z = x @ layer + bias
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(len(x)), label] -= 1.0
        p *= weight[:, None]
        moved = 0.9 * moved - 0.1 * rate * (x.T @ p + decay * layer)
        moved_bias = 0.9 * moved_bias - 0.1 * rate * p.sum(axis=0)
        layer, bias = layer + moved, bias + moved_bias
    return layer.astype(np.float32), bias + np.log(shares)


def train(docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", domain_col: str = "domain", documents_per_domain: int = 600) -> DomainModel:
    """Fit on at most documents_per_domain labelled documents of each domain, the first by a hash of the id."""
    marked = labelled.select(F.col(id_col).alias("id"), F.col(domain_col).cast("string").alias("domain")).where("id is not null and domain is not null").groupBy("id").agg(F.min("domain").alias("domain"))
    present = written(marked.join(docs.select(F.col(id_col).alias("id")), "id", "left_semi"), "labelled")
    counts = {r.domain: r["count"] for r in present.groupBy("domain").count().collect()}
    domains = tuple(sorted(counts))
    if not domains:
        return DomainModel((), np.zeros((FEATURES, 0), np.float32), np.zeros(0))
    present = present.withColumn("h", F.xxhash64(F.col("id").cast("string")))
    chosen = written(first_by_hash(present, "domain", documents_per_domain).select("id", "domain"), "chosen")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = [features(t.as_py()).tobytes() for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string()), batch.column(1), pa.array(vectors, pa.binary())], ["id", "domain", "x"])

    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("text"))
    # Of rows that repeat an id the text that sorts first, so that the sample stays as small as it was chosen.
    sample = texts.join(small(chosen), "id").groupBy("id", "domain").agg(F.min("text").alias("text"))
    shares = np.array([counts[d] for d in domains], float)
    shares /= shares.sum()

    def learned(rows: list[dict]) -> DomainModel:
        rows.sort(key=lambda r: (r["id"], r["x"]))
        x = np.stack([np.frombuffer(r["x"], np.float32) for r in rows])
        layer, bias = fit_softmax(x, np.array([domains.index(r["domain"]) for r in rows]), shares)
        return DomainModel(domains, layer, bias, np.log(shares))

    return fitted(sample.mapInArrow(run, "id string, domain string, x binary"), learned)


def memberships(docs: DataFrame, model: DomainModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, posterior): tokens are runs between white space, the posterior is in the order of domains."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            texts = batch.column(1).to_pylist()
            tokens = [len((t or b"").split()) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tokens, pa.int64()), pa.array(model.posteriors(texts).tolist(), pa.list_(pa.float64()))], ["doc_id", "n_tokens", "posterior"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, "doc_id long, n_tokens long, posterior array<double>")


@dataclass(frozen=True)
class Rates:
    """The fitted rates as a function of the posterior: the vectors of the projected-gradient steps."""

    domains: tuple[str, ...]
    steps: tuple[tuple[float, ...], ...]

    def of(self, posteriors: np.ndarray) -> np.ndarray:
        rates = np.ones(len(posteriors))
        for step in self.steps:
            rates = np.maximum(0.0, rates - posteriors @ np.array(step))
        return rates


def _dense(column: pa.Array, n: int, k: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, k)


def fit_rates(members: DataFrame, domains: tuple[str, ...], targets: Mapping[str, float], most_steps: int = 60, tolerance: float = 1e-6) -> Rates:
    """Projected gradient from rates of 1. Every step sums over all rows of members; only domain totals reach the driver."""
    if bad := sorted(d for d, w in targets.items() if not 0 <= w < np.inf):
        raise ValueError(f"targets of {bad} are no weights")
    if missing := sorted(d for d, w in targets.items() if w and d not in domains):
        warnings.warn(f"no labelled document of {missing}: their targets are left out", stacklevel=2)
    if not any(targets.get(d) for d in domains):
        return Rates(domains, ())
    k, steps = len(domains), []

    def sums(with_products: bool) -> np.ndarray:
        rates, width = Rates(domains, tuple(steps)), k * k if with_products else 0

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(k + width)
            for batch in batches:
                p, t = _dense(batch.column(1), batch.num_rows, k), batch.column(0).to_numpy().astype(float)
                total[:k] += p.T @ (t * rates.of(p))
                if with_products:
                    total[k:] += (p.T @ (t[:, None] * p)).ravel()
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], ["sums"])

        found = members.select("n_tokens", "posterior").mapInArrow(run, "sums array<double>")
        return np.array(found.agg(*[F.sum(F.col("sums")[i]) for i in range(k + width)]).first(), float)

    found = np.nan_to_num(sums(True)) if k else np.zeros(0)
    have, inverse = found[:k], np.linalg.pinv(found[k:].reshape(k, k)) if k else None
    total = have.sum()
    if not total:
        return Rates(domains, ())
    wanted = np.array([targets.get(d, 0.0) for d in domains], float)
    wanted *= total / wanted.sum()
    last = np.inf
    while len(steps) < most_steps:
        gap = have - wanted
        error = float(gap @ inverse @ gap)
        if np.abs(gap).max() <= tolerance * total or last - error <= 1e-9 * max(error, 1e-12):
            break
        last = error
        steps.append(tuple((inverse @ gap).tolist()))
        have = sums(False)
    return Rates(domains, tuple(steps))


def _copies(ids: list, rates: np.ndarray) -> np.ndarray:
    """Whole copies with the rate as mean: the fraction is rounded by a hash of the id."""
    luck = np.array([zlib.crc32(f"mix {i}".encode()) / 2**32 for i in ids])
    return np.floor(rates + luck).astype(np.int64)


def rated(members: DataFrame, rates: Rates) -> DataFrame:
    """(doc_id, n_tokens, domain, posterior, rate, copies) for every row of members; domain: the likeliest."""
    k, names = len(rates.domains), np.array(rates.domains, object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = _dense(batch.column(2), batch.num_rows, k)
            r = rates.of(p)
            likeliest = names[p.argmax(axis=1)].tolist() if k else [None] * len(p)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(likeliest, pa.string()), batch.column(2), pa.array(r), pa.array(_copies(batch.column(0).to_pylist(), r))], ["doc_id", "n_tokens", "domain", "posterior", "rate", "copies"])

    return members.mapInArrow(run, "doc_id long, n_tokens long, domain string, posterior array<double>, rate double, copies long")


def mix(docs: DataFrame, labelled: DataFrame, targets: Mapping[str, float], **columns) -> DataFrame:
    """Fit the classifier and the rates and return rated() for every row of docs."""
    model = train(docs, labelled, **columns)
    members = written(memberships(docs, model), "memberships")
    return rated(members, fit_rates(members, model.domains, targets))


def resampled(docs: DataFrame, model: DomainModel, rates: Rates, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, each as many times as its copies. Posteriors are computed anew instead of joined,
    so nothing is shuffled."""
    at_id, at_text = docs.columns.index(id_col), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            texts = [None if t is None else t.encode() for t in batch.column(at_text).to_pylist()]
            copies = _copies(batch.column(at_id).to_pylist(), rates.of(model.posteriors(texts)))
            yield batch.take(pa.array(np.repeat(np.arange(batch.num_rows), copies)))

    return docs.mapInArrow(run, docs.schema)
