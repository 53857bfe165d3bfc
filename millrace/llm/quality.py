"""Quality classifier by co-training.

Two logistic classifiers see a document through different views: its text (statistics of
characters, words and repetition, and a hashed bag of words) and its metadata (source,
language, length). Starting from the labelled rows, each round fits both, and each hands
the other the unlabelled documents it is most sure of, as pseudo-labels. Both are then
calibrated on labelled rows they were not fitted on, and their log-odds are added.

Fitting uses at most ``max_labelled`` labelled documents, chosen by a hash of their ids, and
scores all others each round; only the features of labelled and pseudo-labelled documents
reach the driver. Scoring is one pass over all documents, without a shuffle.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import slices
from .shingles import _BASE, mix, words_of

_U = np.uint64
BAG, SOURCES, LANGS, SIZES = 256, 64, 8, 24
_CLASSES = 9


def _byte_classes() -> np.ndarray:
    c = np.zeros(256, np.int64)  # 0: other signs
    c[ord("a") : ord("z") + 1], c[ord("A") : ord("Z") + 1], c[ord("0") : ord("9") + 1], c[128:] = 1, 2, 3, 4
    c[[0x20, 0x09, 0x0D]], c[0x0A], c[[ord(x) for x in ".,;:?'\"()-"]], c[[ord(x) for x in "!"]] = 5, 6, 7, 8
    return c


_CLASS = _byte_classes()


def text_features(column: pa.Array) -> np.ndarray:
    """Rows by features; an empty text's are zeros."""
    column = column.fill_null("") if column.null_count else column
    w, rows = words_of(column), len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + rows + 1].astype(np.int64)
    raw = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    size = np.diff(offsets)
    owner = np.repeat(np.arange(rows), size)
    chars = np.bincount(owner * _CLASSES + _CLASS[raw], minlength=rows * _CLASSES).reshape(rows, _CLASSES) / np.maximum(size, 1)[:, None]
    n = np.bincount(w.doc, minlength=rows)

    def distinct(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Share of distinct values and of the most frequent, by row."""
        order = np.argsort(h)
        order = order[np.argsort(doc[order], kind="stable")]
        h, doc = h[order], doc[order]
        start = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])]) if len(h) else np.zeros(0, np.int64)
        times, most = np.diff(np.r_[start, len(h)]), np.zeros(rows)
        np.maximum.at(most, doc[start], times)
        total = np.maximum(np.bincount(doc, minlength=rows), 1)
        return np.bincount(doc[start], minlength=rows) / total, most / total

    inside = w.doc[1:] == w.doc[:-1]
    pairs = mix(w.hash[:-1] * _U(_BASE) + w.hash[1:])[inside] if len(w.hash) else w.hash
    pair_doc = w.doc[1:][inside]
    same = np.bincount(pair_doc, weights=(w.hash[1:] == w.hash[:-1])[inside], minlength=rows) / np.maximum(n, 1)
    d1, m1 = distinct(w.hash, w.doc)
    d2, m2 = distinct(pairs, pair_doc)
    long = np.log1p(n)
    stats = np.column_stack([chars, np.sqrt(chars), same, d1, d1 * long, m1, d2, d2 * long, m2, long, size / np.maximum(n, 1) / 10, n == 0])
    bag = np.bincount(w.doc * BAG + (w.hash >> _U(56)).astype(np.int64), minlength=rows * BAG).reshape(rows, BAG) / np.sqrt(np.maximum(n, 1))[:, None]
    return np.hstack([stats, bag]).astype(np.float32)


def meta_features(sources: list, langs: list, sizes: list) -> np.ndarray:
    """One-hot source and language (hashed; null is a value) and length class."""
    out = np.zeros((len(sources), SOURCES + LANGS + SIZES + 1), np.float32)
    i = np.arange(len(sources))
    slot = lambda x, n: 0 if x is None else 1 + zlib.crc32(str(x).encode()) % (n - 1)
    out[i, [slot(x, SOURCES) for x in sources]] = 1
    out[i, [SOURCES + slot(x, LANGS) for x in langs]] = 1
    n = np.array([max(x or 0, 0) for x in sizes], np.float64)
    out[i, SOURCES + LANGS + np.minimum(np.log2(n + 1), SIZES - 1).astype(np.int64)] = 1
    out[:, -1] = np.log1p(n) / 10
    return out


@dataclass
class Logistic:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # the last is the bias

    @staticmethod
    def fit(x: np.ndarray, y: np.ndarray, l2: float = 3.0, steps: int = 25) -> Logistic:
        """Newton's method on the regularized log-loss."""
        mean, scale = x.mean(0), x.std(0) + 1e-3
        z = np.hstack([(x - mean) / scale, np.ones((len(x), 1))]).astype(np.float64)
        ridge = np.full(z.shape[1], l2)
        ridge[-1] = 1e-6
        return Logistic(mean, scale, _newton(z, y, ridge, steps))

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale @ self.weights[:-1] + self.weights[-1], -30, 30)


def _newton(z: np.ndarray, y: np.ndarray, ridge: np.ndarray, steps: int = 50) -> np.ndarray:
    """Minimizes the regularized log-loss; a step that does not lower it is halved."""
    loss = lambda w: np.logaddexp(0, z @ w).sum() - y @ (z @ w) + 0.5 * ridge @ (w * w)
    w = np.zeros(z.shape[1])
    now = loss(w)
    for _ in range(steps):
        p = _sigmoid(z @ w)
        step = np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + np.diag(ridge), z.T @ (y - p) - ridge * w)
        size = 1.0
        while size > 1e-6 and loss(w + size * step) > now:
            size /= 2
        w = w + size * step
        before, now = now, loss(w)
        if before - now < 1e-7 * max(1.0, abs(before)):
            break
    return w


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class CoTrained:
    """Two views' classifiers, each with its calibration (slope, offset), and the prior log-odds."""

    text: Logistic | None
    meta: Logistic | None
    text_fix: tuple[float, float] = (1.0, 0.0)
    meta_fix: tuple[float, float] = (1.0, 0.0)
    prior: float = 0.0

    def score(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probabilities of quality: by text, by metadata, by both."""
        if self.text is None:
            p = np.full(len(text), _sigmoid(np.array([self.prior]))[0])
            return p, p, p
        a = self.text_fix[0] * self.text.log_odds(text) + self.text_fix[1]
        b = self.meta_fix[0] * self.meta.log_odds(meta) + self.meta_fix[1]
        return _sigmoid(a), _sigmoid(b), _sigmoid(a + b - self.prior)


def _calibrate(log_odds: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Platt scaling with smoothed targets; a view that tells nothing ends at the prior."""
    high, low = (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2)
    t = np.where(y > 0, high, low)
    mean, scale = log_odds.mean(), log_odds.std() + 1e-9
    w = _newton(np.column_stack([(log_odds - mean) / scale, np.ones(len(y))]), t, np.array([1e-2, 1e-6]))
    slope = max(w[0], 0.0) / scale
    return float(slope), float(w[1] - slope * mean)


def co_train(text: np.ndarray, meta: np.ndarray, label: np.ndarray, rounds: int = 3, take: float = 0.05, sure: float = 0.95) -> CoTrained:
    """``label``: 1, 0, or -1 for unlabelled. A quarter of the labelled rows calibrates.

    Without rows of both labels no classifier can be fitted; every document then gets the
    share of good labels (1 without any)."""
    known = np.flatnonzero(label >= 0)
    held, fitted = known[::4], np.setdiff1d(known, known[::4])
    share = (label[known].sum() + 1) / (len(known) + 2) if len(known) else 1 - 1e-9
    prior = float(np.log(share / (1 - share)))
    if len(set(label[fitted])) < 2 or len(set(label[held])) < 2:
        return CoTrained(None, None, prior=prior)
    free = set(np.flatnonzero(label < 0))
    views = {"text": text, "meta": meta}
    given = {v: (list(fitted), list(label[fitted])) for v in views}
    model: dict[str, Logistic] = {}
    for round_no in range(rounds + 1):
        for v, x in views.items():
            rows, y = given[v]
            model[v] = Logistic.fit(x[rows], np.array(y, np.float64))
        if round_no == rounds or not free:
            break
        for v, other in (("text", "meta"), ("meta", "text")):
            pool = np.array(sorted(free))
            if not len(pool):
                break
            slope, offset = _calibrate(model[v].log_odds(views[v][held]), label[held])
            p = _sigmoid(slope * model[v].log_odds(views[v][pool]) + offset)
            quota = max(1, int(take * len(pool)))
            for y, order, ok in ((1, np.argsort(-p), p >= sure), (0, np.argsort(p), p <= 1 - sure)):
                for i in order[: max(1, int(quota * (share if y else 1 - share)))]:
                    if ok[i] and pool[i] in free:
                        free.remove(pool[i])
                        given[other][0].append(pool[i])
                        given[other][1].append(y)
    return CoTrained(model["text"], model["meta"], *(_calibrate(model[v].log_odds(views[v][held]), label[held]) for v in ("text", "meta")), prior)


def _features(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    cols = {c: batch.column(c) for c in ("text", "source", "lang", "n_chars")}
    return text_features(cols["text"]), meta_features(*(cols[c].to_pylist() for c in ("source", "lang", "n_chars")))


def _wanted(docs: DataFrame, doc_id: str) -> DataFrame:
    """The columns the views read; those that a table lacks count as null."""
    col = lambda c, kind: (F.col(c) if c in docs.columns else F.lit(None)).cast(kind).alias(c)
    return docs.select(F.col(doc_id).alias("doc_id"), col("text", "string"), col("source", "string"), col("lang", "string"), col("n_chars", "long"))


def _collected(wanted: DataFrame, sample: DataFrame) -> tuple[list, np.ndarray, np.ndarray, np.ndarray]:
    """Ids, labels and both views' features of the documents that a small (doc_id, y) names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2048, 1 << 19):
                text, meta = _features(part)
                pack = lambda m: pa.array([r.tobytes() for r in m], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), part.column("y"), pack(text), pack(meta)], names=["doc_id", "y", "text", "meta"])

    # documents repeated under one id are repeated here; one row each keeps the sample bounded
    rows = wanted.join(F.broadcast(sample), "doc_id").dropDuplicates(["doc_id"])
    got = rows.mapInArrow(run, "doc_id long, y int, text binary, meta binary").toPandas().sort_values("doc_id")
    unpack = lambda c: np.stack([np.frombuffer(b, np.float32) for b in got[c]]) if len(got) else np.zeros((0, 1), np.float32)
    return got["doc_id"].tolist(), got["y"].to_numpy(), unpack("text"), unpack("meta")


def _surest(wanted: DataFrame, known: DataFrame, used: DataFrame, model: CoTrained, many: tuple[int, int], sure: float) -> list:
    """(doc_id, view, y) of the unlabelled documents that each view is most sure of: at most
    ``many[y]`` of each class from each source (as the metadata view tells sources apart).

    All documents are scored; only ids and probabilities of sure ones are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2048, 1 << 19):
                text, meta = _features(part)
                origin, ids = meta[:, :SOURCES].argmax(1).astype(np.int32), part.column("doc_id").cast(pa.int64())
                for view, p in enumerate(model.score(text, meta)[:2]):
                    at = np.flatnonzero((p >= sure) | (p <= 1 - sure))
                    y = (p[at] >= sure).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(at)), pa.array(origin[at]), pa.array(np.full(len(at), view, np.int32)), pa.array(y), pa.array(np.abs(p[at] - 0.5))], names=["doc_id", "origin", "view", "y", "far"])

    found = wanted.where("doc_id is not null").mapInArrow(run, "doc_id long, origin int, view int, y int, far double")
    free = found.join(known, "doc_id", "left_anti").join(F.broadcast(used), "doc_id", "left_anti")
    order = Window.partitionBy("origin", "view", "y").orderBy(F.desc("far"), F.xxhash64("doc_id"), "doc_id")
    # with a literal limit each task keeps the first few of every group before the shuffle
    best = free.withColumn("no", F.row_number().over(order)).where((F.col("no") <= max(many)) & (F.col("no") <= F.when(F.col("y") == 1, many[1]).otherwise(many[0])))
    return best.select("view", "y", "origin", "no", "doc_id").orderBy("view", F.desc("y"), "origin", "no").collect()


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = 6000, rounds: int = 3, doc_id: str = "doc_id", label: str = "quality", each: int = 10, sure: float = 0.95) -> CoTrained:
    """Fit on a bounded sample of labelled documents and pseudo-labels for any of the others.

    Each round scores all unlabelled documents, and each view hands the other the ``each`` of
    every source that it is most sure of. A document labelled several times counts by its mean
    label, ties as good; null labels and ids drop out; labels of documents not there, too. Of rows
    repeated under one id one teaches. Null and empty texts count as texts without words. Without
    documents, or labels of both kinds, the model gives the share of good labels. Columns other
    than the views' are ignored, whatever their names."""
    mean = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg((F.avg(label) >= 0.5).cast("int").alias("y"))
    wanted, spark = _wanted(docs, doc_id), docs.sparkSession
    known = mean.join(wanted.select("doc_id").distinct(), "doc_id", "left_semi").orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id").limit(max_labelled)
    sample = lambda rows: spark.createDataFrame(rows, "doc_id long, y int")
    _, y, *features = _collected(wanted, sample([tuple(r) for r in known.collect()]))
    views = dict(zip(("text", "meta"), features, strict=True))
    held = np.arange(len(y))[::4]
    fitted = np.setdiff1d(np.arange(len(y)), held)
    if len(set(y[fitted])) < 2 or len(set(y[held])) < 2:
        return co_train(*features, y)
    given = {v: (x[fitted], y[fitted]) for v, x in views.items()}
    share, used = (y.sum() + 1) / (len(y) + 2), []
    for round_no in range(rounds + 1):
        fits = {v: Logistic.fit(x, t.astype(np.float64)) for v, (x, t) in given.items()}
        fixes = [_calibrate(fits[v].log_odds(x[held]), y[held]) for v, x in views.items()]
        model = CoTrained(fits["text"], fits["meta"], *fixes, float(np.log(share / (1 - share))))
        if round_no == rounds:
            break
        chosen: dict[int, tuple[int, int]] = {}
        for r in _surest(wanted, mean.select("doc_id"), sample([(i, 0) for i in used]).select("doc_id"), model, (max(1, int(each * (1 - share))), max(1, int(each * share))), sure):
            chosen.setdefault(r["doc_id"], (r["view"], r["y"]))
        if not chosen:
            break
        used += list(chosen)
        ids, new, *more = _collected(wanted, sample([(i, t) for i, (_, t) in chosen.items()]))
        by = np.array([chosen[i][0] for i in ids])
        for to, (v, x) in enumerate(zip(("text", "meta"), more, strict=True)):
            taught = by != to
            given[v] = (np.vstack([given[v][0], x[taught]]), np.r_[given[v][1], new[taught]])
    return model


def score(docs: DataFrame, model: CoTrained, keep_at: float = 0.5, doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, text_score, meta_score, score, keep) of every row.

    Null and empty texts are scored like any other, from their length. Repeated rows get
    equal scores. An empty table gives no rows."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2048, 1 << 19):
                a, b, both = model.score(*_features(part))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(x.astype(np.float64)) for x in (a, b, both)), pa.array(both >= keep_at)], names=["doc_id", "text_score", "meta_score", "score", "keep"])

    return _wanted(docs, doc_id).mapInArrow(run, f"doc_id {kind}, text_score double, meta_score double, score double, keep boolean")


def kept(docs: DataFrame, model: CoTrained, keep_at: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject, whole, with all their columns.

    Columns that the views read travel twice only where they are missing or of another type."""
    names, p = docs.columns, "_view_"
    while any(c.lower().startswith(p) for c in names):
        p += "_"
    wanted = {"text": "string", "source": "string", "lang": "string", "n_chars": "bigint"}
    here = {f.name: f.dataType.simpleString() for f in docs.schema}
    place = {c: c if here.get(c) == kind else p + c for c, kind in wanted.items()}
    view = [(F.col(c) if c in names else F.lit(None)).cast(kind).alias(p + c) for c, kind in wanted.items() if place[c] != c]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2048, 1 << 20):
                seen = pa.RecordBatch.from_arrays([part.column(place[c]) for c in wanted], names=list(wanted))
                yield part.select(names).filter(pa.array(model.score(*_features(seen))[2] >= keep_at))

    return docs.select("*", *view).mapInArrow(run, docs.schema)
