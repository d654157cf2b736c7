"""Toxicity by a classifier chain.

The categories are predicted in a fixed order by linear (logistic) models.  Each later
model gets, besides the text's features, the log-odds of the earlier categories.  It is
trained with out-of-fold predictions of them: an earlier model's prediction for a
training document comes from a model fitted without that document's fold, so that a
later model sees earlier predictions as good as those that it gets at scoring time.

Features are the distinct words of a text (lower case, cut at ASCII characters other
than letters and digits) and their first 4 and 6 bytes, hashed to ``1 << BITS`` places.
A model keeps the places whose rates differ most between its two classes (at most
``MOST``, of at least ``LEAST_DOCS`` documents, by at least ``LEAST_Z`` standard errors).

The models are fitted on a bounded sample: the ``sample`` labelled documents with the
smallest hashes of their ids.  Spark counts places by category, fold and label; only
counts and the chosen places of the sample reach the driver.  Folds go by a hash of a
document's features, so that copies are in one fold and no prediction called out-of-fold
comes from a model that has seen the document.  All documents are scored, over their
whole texts.

Null and empty texts get the probabilities of a text without features.  Repeated rows
are scored each, null ids stay null, extra columns are ignored, an empty table gives no
rows.  Labels that are null or of unknown documents are ignored; of several labels of
one document the largest counts.  Without both classes in the sample a category's
probability is the share of its labels (0 without any).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.llm.store import arrow_rows, forget, written
from larkspur.llm.textblock import PUNCT, Block, Words, mix, release, slices, span_hashes, text_bytes

BITS = 18
FOLDS = 3
#: Of each model: the most places, the fewest documents of a place, and the least standard errors between its two rates.
MOST, LEAST_DOCS, LEAST_Z = 4000, 5, 4.0
#: Tasks that count the sample's places, and so tables of counts that the driver adds up one after the other.
COUNTERS = 4
#: Categories in chain order, as expressions over the labels.
CHAIN = {"low_quality": "1 - quality", "toxic": "toxic"}


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, place) pairs, ordered by document."""
    words = Words(Block(texts), PUNCT)
    places = [span_hashes(words.block, words.start, words.length)]
    for n in (4, 6):
        places.append(mix(span_hashes(words.block, words.start, np.minimum(words.length, n)) + np.uint64(n)))
    shift = np.uint64(64 - BITS)
    pairs = np.concatenate([(words.doc.astype(np.uint64) << np.uint64(BITS)) | (h >> shift) for h in places])
    doc, place = np.divmod(np.unique(pairs), np.uint64(1 << BITS))
    return doc.astype(np.int64), place.astype(np.int64)


def featured(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """labels, the places of the text's features, and a hash of them."""
    for part in slices(batches, "text"):
        doc, place = features(text_bytes(part.column("text"), lower=True))
        offsets = np.zeros(part.num_rows + 1, np.int32)
        np.cumsum(np.bincount(doc, minlength=part.num_rows), out=offsets[1:])
        sums = np.zeros(len(place) + 1, np.uint64)
        np.cumsum(mix(place.astype(np.uint64) + np.uint64(1)), out=sums[1:])
        content = mix(sums[offsets[1:]] - sums[offsets[:-1]]).view(np.int64)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(place.astype(np.int32)))
        yield pa.RecordBatch.from_arrays([part.column("labels"), lists, pa.array(content)], ["labels", "places", "content"])


def place_counts(n: int):
    """Of a task's documents the counts by category, fold and label, of all (place -1) and of runs of places."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, in_all = np.zeros((n * FOLDS * 2, 1 << BITS), np.int32), np.zeros(n * FOLDS * 2, np.int64)
        for batch in batches:
            lists = batch.column("places")
            place = lists.flatten().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
            fold = batch.column("content").to_numpy() % FOLDS
            labels = np.array([[np.nan if x is None else x for x in r] for r in batch.column("labels").to_pylist()], float).reshape(-1, n)
            for k in range(n):
                cell = np.where(np.isnan(labels[:, k]), -1, (k * FOLDS + fold) * 2 + (labels[:, k] > 0))
                for c in np.unique(cell[cell >= 0]).tolist():
                    in_all[c] += int((cell == c).sum())
                    table[c] += np.bincount(place[cell[row] == c], minlength=1 << BITS).astype(np.int32)
        if in_all.any():
            yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([in_all.astype("<i4").tobytes()], pa.binary())], ["place", "counts"])
            for a in range(0, 1 << BITS, 1 << 14):
                raw = np.ascontiguousarray(table[:, a : a + (1 << 14)].T).astype("<i4").tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([a], pa.int32()), pa.array([raw], pa.binary())], ["place", "counts"])

    return run


def narrowed(chosen):
    """The places of ``chosen`` only, by their numbers in it."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = np.full(1 << BITS, -1, np.int32)
        number[chosen] = np.arange(len(chosen), dtype=np.int32)
        for batch in batches:
            lists = batch.column("places")
            got = number[lists.flatten().to_numpy(zero_copy_only=False)]
            row = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
            offsets = np.zeros(batch.num_rows + 1, np.int32)
            np.cumsum(np.bincount(row[got >= 0], minlength=batch.num_rows), out=offsets[1:])
            kept = pa.ListArray.from_arrays(pa.array(offsets), pa.array(got[got >= 0]))
            yield pa.RecordBatch.from_arrays([batch.column("labels"), kept, batch.column("content")], ["labels", "places", "content"])

    return run


@dataclass
class Model:
    weights: np.ndarray  # of places
    bias: float
    earlier: np.ndarray  # weights of the log-odds of earlier categories

    def logit(self, sums: np.ndarray, before: np.ndarray) -> np.ndarray:
        return np.clip(sums + self.bias + (before @ self.earlier if len(self.earlier) else 0), -12, 12)


class Counts:
    """Documents of the sample with a label 1 and with a label 0, by category and fold: of all and of each place."""

    def __init__(self, n: np.ndarray, of_place: np.ndarray):
        self.n, self.of_place = n, of_place  # (category, fold, label) and (place, category, fold, label)

    def telling(self, k: int, without: int | None) -> np.ndarray:
        """The places whose rates differ most between the classes of category ``k``, outside one fold.

        At most ``MOST`` places, of at least ``LEAST_DOCS`` documents, whose rates differ by at least ``LEAST_Z``
        standard errors.
        """
        folds = [f for f in range(self.n.shape[1]) if f != without]
        n0, n1 = (float(self.n[k, folds, label].sum()) for label in (0, 1))
        if not n0 or not n1:
            return np.zeros(0, np.int64)
        b, a = (self.of_place[:, k, folds, label].sum(1, dtype=np.int64) for label in (0, 1))
        p = (a + b + 1) / (n1 + n0 + 2)
        z = np.abs(a / n1 - b / n0) / np.sqrt(p * (1 - p) * (1 / n1 + 1 / n0))
        z[a + b < LEAST_DOCS] = 0
        chosen = np.argsort(-z, kind="stable")[:MOST]
        return chosen[z[chosen] >= LEAST_Z]


class Sample:
    """Labelled documents as a sparse binary matrix over the chosen places."""

    def __init__(self, chosen: np.ndarray, ptr: np.ndarray, place: np.ndarray):
        self.n, self.chosen, self.place = len(ptr) - 1, chosen, place
        self.doc = np.repeat(np.arange(self.n, dtype=np.int32), np.diff(ptr))

    def sums(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.doc, weights[self.place], self.n)

    def fit(self, telling: np.ndarray, mine: np.ndarray, y: np.ndarray, before: np.ndarray, steps: int = 150, penalty: float = 1e-4) -> tuple[np.ndarray, float, np.ndarray]:
        """Weights (by number in ``chosen``), bias and weights of ``before`` of a logistic model of ``y``, on the rows ``mine``."""
        n1, n0 = float(y[mine].sum()), float((1 - y[mine]).sum())
        weights, extra = np.zeros(len(self.chosen)), np.zeros(before.shape[1])
        if not n1 or not n0:
            share = n1 / max(n1 + n0, 1)
            return weights, float(np.log((share + 1e-9) / (1 - share + 1e-9))), extra
        index = np.full(len(self.chosen), -1, np.int32)
        index[np.searchsorted(self.chosen, telling)] = np.arange(len(telling), dtype=np.int32)
        at = mine[self.doc]
        at &= index[self.place] >= 0
        col, row = index[self.place[at]], self.doc[at]
        del at
        w, bias = np.zeros(len(telling)), float(np.log(n1 / n0))
        g2w, g2e, g2b = np.full(len(telling), 1e-8), np.full(len(extra), 1e-8), 1e-8
        for _ in range(steps):  # full-batch AdaGrad
            raw = np.bincount(row, w[col], self.n) + bias + before @ extra
            error = np.where(mine, 1 / (1 + np.exp(-np.clip(raw, -30, 30))) - y, 0.0) / (n1 + n0)
            gw = np.bincount(col, error[row], len(telling)) + penalty * w
            ge = before.T @ error + penalty * extra
            gb = error.sum()
            g2w, g2e, g2b = g2w + gw**2, g2e + ge**2, g2b + gb**2
            w, extra, bias = w - 0.5 * gw / np.sqrt(g2w), extra - 0.1 * ge / np.sqrt(g2e), bias - 0.1 * gb / np.sqrt(g2b)
        weights[np.searchsorted(self.chosen, telling)] = w
        return weights, bias, extra


def fit_chain(counts: Counts, sample: Sample, labels: np.ndarray, fold: np.ndarray) -> list[Model]:
    """One model for each column of ``labels`` (NaN: unknown), in order."""
    before, chain = np.zeros((sample.n, 0)), []
    for k in range(labels.shape[1]):
        known = ~np.isnan(labels[:, k])
        y = np.where(known, labels[:, k], 0.0)
        outside = np.zeros(sample.n)
        if k + 1 < labels.shape[1]:  # nothing reads the last category's predictions
            for f in range(FOLDS):
                weights, bias, extra = sample.fit(counts.telling(k, f), known & (fold != f), y, before)
                outside[fold == f] = Model(weights, bias, extra).logit(sample.sums(weights), before)[fold == f]
        weights, bias, extra = sample.fit(counts.telling(k, None), known, y, before)
        dense = np.zeros(1 << BITS)
        dense[sample.chosen] = weights
        chain.append(Model(dense, bias, extra))
        before = np.column_stack([before, outside])
    return chain


def train(docs: DataFrame, labels: DataFrame, categories: dict[str, str] = CHAIN, sample: int = 10_000, id_col: str = "doc_id", text_col: str = "text") -> list[Model]:
    """The chain of models, fitted on a bounded sample of the labelled documents."""
    n = len(categories)
    arrow_rows(docs.sparkSession)
    known = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("bigint").alias("id")).agg(F.array(*[F.max(F.expr(e)).cast("double") for e in categories.values()]).alias("labels"))
    # `sample` rows of an id and a few numbers: small enough to be sent to every task
    drawn = F.broadcast(known.orderBy(F.xxhash64("id"), "id").limit(sample))
    texts = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    rows = written(texts.join(drawn, "id").select("labels", "text").mapInArrow(featured, "labels array<double>, places array<int>, content bigint"), "toxicity-sample")
    # counts by place, category, fold and label: no more than the sample's places reach the driver
    of_place, in_all = np.zeros((1 << BITS, n, FOLDS, 2), np.int32), np.zeros((n, FOLDS, 2), np.int64)
    for row in rows.coalesce(COUNTERS).mapInArrow(place_counts(n), "place int, counts binary").toLocalIterator():
        part = np.frombuffer(bytes(row.counts), "<i4").reshape(-1, n, FOLDS, 2)
        if row.place < 0:
            in_all += part[0]
        else:
            of_place[row.place : row.place + len(part)] += part
    counts = Counts(in_all, of_place)
    chosen = np.unique(np.concatenate([counts.telling(k, f) for k in range(n) for f in (None, *range(FOLDS))]))

    got = rows.mapInArrow(narrowed(chosen), "labels array<double>, places array<int>, content bigint").toArrow()
    # the order in which rows arrive must not matter
    order_keys = list(zip(got.column("content").to_pylist(), map(str, got.column("labels").to_pylist())))
    got = got.take(pa.array(sorted(range(len(order_keys)), key=order_keys.__getitem__), pa.int64()))
    known_labels = np.array([[np.nan if x is None else x for x in r] for r in got.column("labels").to_pylist()], float).reshape(-1, n)
    lists = got.column("places").combine_chunks()
    if got.num_rows:
        ptr, place = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
        ptr, place = ptr - ptr[0], place[ptr[0] : ptr[-1]]
    else:
        ptr, place = np.zeros(1, np.int32), np.zeros(0, np.int32)
    fold = np.array(got.column("content").to_pylist(), np.int64) % FOLDS
    forget(rows)
    order_keys = got = lists = of_place = None
    chain = fit_chain(counts, Sample(chosen, ptr.copy(), place.copy()), known_labels, fold)
    del counts, ptr, place
    release()
    return chain


def scorer(shared, n: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain: list[Model] = shared.value
        for part in slices(batches, "text"):
            doc, place = features(text_bytes(part.column("text"), lower=True))
            before = np.zeros((part.num_rows, 0))
            out = []
            for model in chain:
                w = model.weights[place]
                at = w != 0
                logit = model.logit(np.bincount(doc[at], w[at], part.num_rows), before[:, : len(model.earlier)])
                before = np.column_stack([before, logit])
                out.append(pa.array(1 / (1 + np.exp(-logit))))
            rest = [c for c in part.schema.names]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in rest), *out], [*rest, *(f"_p{i}" for i in range(n))])

    return run


def probabilities(docs: DataFrame, chain: list[Model], text: Column, keep: list[Column]) -> DataFrame:
    """The kept columns, the text and a probability ``_p0``, ``_p1``, ... for each category."""
    arrow_rows(docs.sparkSession)
    rows = docs.select(*keep, text.alias("text"))
    schema = T.StructType([*rows.schema, *(T.StructField(f"_p{i}", T.DoubleType()) for i in range(len(chain)))])
    return rows.mapInArrow(scorer(docs.sparkSession.sparkContext.broadcast(chain), len(chain)), schema)


def score(docs: DataFrame, labels: DataFrame, categories: dict[str, str] = CHAIN, threshold: float = 0.5, sample: int = 10_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, p_<category> for every category, and rejected (the last category reaches the threshold)."""
    chain = train(docs, labels, categories, sample, id_col, text_col)
    scored = probabilities(docs, chain, F.col(text_col), [F.col(id_col).alias("_id")])
    names = [F.col(f"_p{i}").alias(f"p_{name}") for i, name in enumerate(categories)]
    return scored.select(F.col("_id").alias(id_col), *names, (F.col(f"_p{len(chain) - 1}") >= threshold).alias("rejected"))


def clean(docs: DataFrame, labels: DataFrame, categories: dict[str, str] = CHAIN, threshold: float = 0.5, sample: int = 10_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, with all their columns, whose last category stays below the threshold."""
    names = docs.columns
    chain = train(docs, labels, categories, sample, id_col, text_col)
    scored = probabilities(docs, chain, F.col(f"`{text_col}`"), [F.struct(*[F.col(f"`{c}`") for c in names if c != text_col]).alias("_rest")])
    kept = scored.where(F.col(f"_p{len(chain) - 1}") < threshold)
    return kept.select(*[F.col("text").alias(c) if c == text_col else F.col("_rest")[c].alias(c) for c in names])
