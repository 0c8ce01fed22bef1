"""Quality classifier by co-training of two views: the text's content and the page's metadata."""

from __future__ import annotations

import copy
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import in_arrow, materialize, only, release

#: Buckets of the hashed metadata; shares of the text view, and buckets of its hashed words and word pairs.
LANGS, SOURCES, SIZES = 16, 64, 12
SHARES, GRAMS = 16, 112
META_FEATURES = LANGS + SOURCES + SIZES

_CLASS = np.zeros(256, np.int64)  # 0 letter or part of one, 1 capital, 2 digit, 3 space, 4 line end, 5 common mark, 6 other mark
_CLASS[ord("A") : ord("Z") + 1] = 1
_CLASS[ord("0") : ord("9") + 1] = 2
_CLASS[[9, 11, 12, 13, 32]] = 3
_CLASS[10] = 4
_CLASS[[c for c in range(33, 127) if not chr(c).isalnum()]] = 6
_CLASS[[ord(c) for c in ".,;:'\"?-()"]] = 5


def word_grams(text: str) -> np.ndarray:
    """Hashed words and pairs of neighbouring words: each adds or takes one in its bucket; of length 1, or 0 without words."""
    h = np.array(list(map(zlib.crc32, text.lower().encode("utf-8", "surrogatepass").split())), np.uint64)
    both = np.concatenate([h, h[:-1] * np.uint64(0x9E3779B1) + h[1:]]) * np.uint64(0x9FB21C651E98DF25)
    sums = np.bincount((both >> np.uint64(33)).astype(np.int64) % GRAMS, weights=1.0 - 2.0 * (both >> np.uint64(63)).astype(float), minlength=GRAMS)
    return sums / max(float(np.sqrt((sums**2).sum())), 1e-9)


def text_view(text: str) -> list[float]:
    """Shares and rates of characters, words and lines, and then word_grams()."""
    counts = np.bincount(_CLASS[np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)], minlength=7)
    words, lines = text.split(), text.split("\n")
    n, w = max(int(counts.sum()), 1), max(len(words), 1)
    letters = max(int(counts[0] + counts[1]), 1)
    marked = sum(1 for x in words if not x[-1].isalnum() and x[-1] not in ".,;:?!'\")»”")
    shouted = sum(1 for x in words if len(x) > 1 and x.isupper())
    return [
        float(np.log1p(n)), counts[1] / letters, counts[2] / n, counts[5] / n, counts[6] / n, (counts[3] + counts[4]) / n,
        marked / w, shouted / w, len(set(words)) / w, len(set(words)) / float(w) ** 0.8, sum(map(len, words)) / w / 10,
        float(np.log1p(len(lines))), len(set(lines)) / len(lines), text.count("!") / w, text.count(" | ") / w, (len(words) == 0) * 1.0, *word_grams(text).tolist(),
    ]


def meta_view(lang: str | None, source: str | None, n_chars: int | None) -> list[int]:
    """Positions of the three features that are set."""
    size = min(SIZES - 1, int(np.log2(max(n_chars or 0, 0) + 1) * 0.7))
    return [zlib.crc32(f"l{lang}".encode()) % LANGS, LANGS + zlib.crc32(f"s{source}".encode()) % SOURCES, LANGS + SOURCES + size]


class Logistic:
    """Ridge logistic regression on standardised features, by Newton steps; and a second one that calibrates its margins."""

    def fit(self, x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> Logistic:
        floor = np.where(np.arange(x.shape[1]) < SHARES, 1e-9, 0.01)
        self.mean, self.scale = x.mean(0), np.maximum(x.std(0), floor)
        self.keep = np.append(np.full(x.shape[1], ridge), 1e-6)
        self.w = np.zeros(x.shape[1] + 1)
        for _ in range(25):
            if self.step(*self.sums(x, y)) < 1e-6:
                break
        self.slope, self.shift = 1.0, 0.0
        return self

    def sums(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradient and curvature of the loss over these rows; those of several sets of rows add up."""
        z = np.column_stack([np.clip((x - self.mean) / self.scale, -20, 20), np.ones(len(x))])
        p = chance(z @ self.w)
        return z.T @ (p - y), (z.T * (p * (1 - p) + 1e-9)) @ z

    def step(self, slope: np.ndarray, curve: np.ndarray) -> float:
        """One Newton step for such sums; the greatest change of a weight."""
        change = np.linalg.solve(curve + np.diag(self.keep), slope + self.keep * self.w)
        self.w = self.w - np.clip(change, -5, 5)
        return float(np.abs(change).max())

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.slope * (np.clip((x - self.mean) / self.scale, -20, 20) @ self.w[:-1] + self.w[-1]) + self.shift

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        self.slope, self.shift = 1.0, 0.0
        if len(set(y)) == 2:
            line = Logistic().fit(self.margin(x)[:, None], y)
            slope = line.w[0] / line.scale[0]
            self.slope, self.shift = slope, line.w[1] - line.w[0] * line.mean[0] / line.scale[0]


def chance(margin: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))


def flat(column: pa.Array) -> np.ndarray:
    """A column of arrays of one size as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def one_hot(meta: list[list[int]] | np.ndarray) -> np.ndarray:
    out = np.zeros((len(meta), META_FEATURES))
    out[np.arange(len(meta))[:, None], np.array(meta, np.int64).reshape(len(meta), 3)] = 1
    return out


def pseudo_sums(features: DataFrame, models: list[Logistic], teachers: list[Logistic], own: set, sure: float) -> list[list[tuple[float, np.ndarray, np.ndarray]]]:
    """For each view and label (0, 1): how many rows the other view's teacher is sure of, and the sums of the Newton step on them.

    Every row of features counts but those of ids in `own` (the labelled sample, of bounded size). A task sends one small array,
    about the square root of the tasks' number of arrays is added up together, and as many reach the driver.
    """
    sizes = [len(m.w) for m in models]
    width = sum(2 * (1 + d + d * d) for d in sizes)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        from pyspark import TaskContext

        total = np.zeros(width)
        for batch in batches:
            free = np.array([i not in own for i in batch.column(0).to_pylist()], bool)
            if not free.any():
                continue
            views = [flat(batch.column(1)).astype(float)[free], one_hot(flat(batch.column(2)))[free]]
            at = 0
            for k, model in enumerate(models):
                belief = chance(teachers[1 - k].margin(views[1 - k]))
                for label, taught in enumerate((belief <= 1 - sure, belief >= sure)):
                    slope, curve = model.sums(views[k][taught], np.full(taught.sum(), label))
                    part = np.concatenate([[taught.sum()], slope, curve.ravel()])
                    total[at : at + len(part)] += part
                    at += len(part)
        yield {"task": [TaskContext.get().partitionId()], "sums": [total]}

    def join(group: pa.Table) -> pa.Table:
        rows = sorted(zip(group.column("task").to_pylist(), group.column("sums").to_pylist(), strict=True))
        return pa.table({"task": [rows[0][0]], "sums": [np.sum([r[1] for r in rows], axis=0)]}, pa.schema([("task", pa.int32()), ("sums", pa.list_(pa.float64()))]))

    schema = "task int, sums array<double>"
    per_task = in_arrow(features, add, schema)
    groups = max(1, int(features.rdd.getNumPartitions() ** 0.5))
    parts = per_task.groupBy(F.col("task") % groups).applyInArrow(join, schema).orderBy("task").collect()
    total = np.sum([p["sums"] for p in parts], axis=0) if parts else np.zeros(width)
    out, at = [], 0
    for d in sizes:
        out.append([])
        for _ in range(2):
            out[-1].append((float(total[at]), total[at + 1 : at + 1 + d], total[at + 1 + d : at + 1 + d + d * d].reshape(d, d)))
            at += 1 + d + d * d
    return out


def co_train(text: np.ndarray, meta: np.ndarray, y: np.ndarray, pseudo: Callable[[list[Logistic], list[Logistic]], list[list[tuple[float, np.ndarray, np.ndarray]]]], rounds: int = 3, steps: int = 2) -> tuple[Logistic, Logistic, np.ndarray]:
    """Both views' classifiers after `rounds` of teaching each other, and the weights that join their calibrated margins.

    Both start from the labelled rows. In each round either view labels all rows without labels that it is sure of, and the
    other learns from them by `steps` Newton steps on the sums that pseudo() brings together. They count as much as the labelled
    rows at most, in the labelled rows' proportion of good and poor; a view that is sure of one kind only teaches nothing. A fifth of the labelled rows is held out to calibrate the views, anew in each round, and to join them.
    """
    held = np.arange(len(y)) % 5 == 4
    views = (text, meta)
    models = [Logistic().fit(x[~held], y[~held]) for x in views]
    for model, x in zip(models, views, strict=True):
        model.calibrate(x[held], y[held])
    for _ in range(rounds):
        teachers = [copy.copy(m) for m in models]
        for _ in range(steps):
            for model, x, taught in zip(models, views, pseudo(models, teachers), strict=True):
                known = [float((y[~held] == label).sum()) for label in (0, 1)]
                share = min(1.0, *(t[0] / n for t, n in zip(taught, known, strict=True)))
                slope, curve = model.sums(x[~held], y[~held])
                for (n, more_slope, more_curve), own in zip(taught, known, strict=True):
                    if share:
                        slope, curve = slope + share * own / n * more_slope, curve + share * own / n * more_curve
                model.step(slope, curve)
        for model, x in zip(models, views, strict=True):
            model.calibrate(x[held], y[held])
    margins = np.column_stack([m.margin(x[held]) for m, x in zip(models, views, strict=True)])
    if len(set(y[held])) == 2:
        joined = Logistic().fit(margins, y[held])
        weights = joined.w[:-1] / joined.scale
        return models[0], models[1], np.append(weights, joined.w[-1] - weights @ joined.mean)
    return models[0], models[1], np.array([1.0, 1.0, -float(np.log(max(y.mean(), 1e-3) / max(1 - y.mean(), 1e-3)))])


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, labelled: int = 6000, rounds: int = 3, sure: float = 0.95) -> DataFrame:
    """docs with four more columns: p_text and p_meta (each view's calibrated chance of good quality), score (of both) and keep.

    Reads doc_id, text, lang, source and n_chars of docs, and doc_id and quality (0 or 1) of labels. The classifiers start from
    at most `labelled` labelled rows, those of the smallest hash of their id; co-training then goes over all other rows. Every
    document is scored, by its whole text. keep: score >= `threshold`.

    Labels of null id or quality don't count; of contradicting labels the more frequent counts, of ties none. Of rows that repeat a
    labelled id the one of the smallest hash of its text is the labelled one. Null texts are empty, null languages and sources are
    values of their own. Without labels of both kinds nothing can be judged: the chances are null and keep is true. Rows of null or
    repeated ids are scored like others; an empty table gives no rows. Columns of docs with the new names are replaced.
    """
    spark = docs.sparkSession
    marked = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.avg("quality").alias("q")).where("q <> 0.5").select("doc_id", F.round("q").alias("quality"))
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    sample = marked.join(docs.select("doc_id").distinct(), "doc_id", "left_semi").orderBy(*order).limit(labelled)
    chosen = {r["doc_id"]: r["quality"] for r in sample.collect()}
    kind = dict(docs.dtypes)["doc_id"]

    def views(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(1, 5)]
            yield {"doc_id": batch.column(0), "text_view": [text_view(t or "") for t in columns[0]], "meta_view": [meta_view(*m) for m in zip(*columns[1:], strict=True)], "text_hash": batch.column(5)}

    model = None
    if len(set(chosen.values())) == 2:
        used = only(docs, "doc_id", "text", "lang", "source", "n_chars").withColumn("n_chars", F.col("n_chars").cast("long")).withColumn("text_hash", F.xxhash64("text"))
        features = materialize(in_arrow(used, views, f"doc_id {kind}, text_view array<float>, meta_view array<int>, text_hash long"))
        # at most `labelled` ids
        wanted = spark.createDataFrame([(k,) for k in chosen], f"doc_id {kind}")
        seen = features.join(F.broadcast(wanted), "doc_id").groupBy("doc_id").agg(F.min(F.struct("text_hash", "text_view", "meta_view")).alias("v")).orderBy(*order).select("doc_id", "v.text_view", "v.meta_view").collect()
        y = np.array([chosen[r["doc_id"]] for r in seen])
        if len(set(y[np.arange(len(y)) % 5 != 4])) == 2:
            text, meta, own = np.array([r["text_view"] for r in seen]), one_hot([r["meta_view"] for r in seen]), set(chosen)
            model = co_train(text, meta, y, lambda models, teachers: pseudo_sums(features, models, teachers, own, sure), rounds)
        release(spark, features)

    names = [c for c in docs.columns if c not in ("p_text", "p_meta", "score", "keep")]
    place = {n: i for i, n in enumerate(names)}

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            n = batch.num_rows
            out: dict = {c: batch.column(i) for c, i in place.items()}
            if model is None or not n:
                yield out | {"p_text": [None] * n, "p_meta": [None] * n, "score": [None] * n, "keep": [True] * n}
                continue
            first = model[0].margin(np.array([text_view(t or "") for t in batch.column(place["text"]).to_pylist()], np.float32).astype(float))
            second = model[1].margin(one_hot([meta_view(*m) for m in zip(*(batch.column(place[c]).to_pylist() for c in ("lang", "source", "n_chars")), strict=True)]))
            both = chance(first * model[2][0] + second * model[2][1] + model[2][2])
            yield out | {"p_text": chance(first), "p_meta": chance(second), "score": both, "keep": both >= threshold}

    added = [T.StructField(c, T.DoubleType()) for c in ("p_text", "p_meta", "score")]
    schema = T.StructType([*(docs.schema[c] for c in names), *added, T.StructField("keep", T.BooleanType())])
    return in_arrow(docs.select(*[F.col(f"`{c}`") for c in names]), score, schema)
