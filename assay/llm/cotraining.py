"""Quality classifier by co-training on two views of a document: its text and its page metadata.

Each view has a logistic classifier. In every round each classifier labels all unlabelled documents, and the labels it
is sure of, by its calibrated probability, go to the training set of the other one. At the end both views are
calibrated on held-out labels, a logistic model combines them, and all documents are scored in one scan.

Nothing is drawn: features of all documents are stored once, and every Newton step is a pass over them that adds up
gradients and Hessians on the executors. The driver sees sums alone, whose size does not depend on the input.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from assay.llm.tables import columns_of, sliced, stored

SIGNS = re.compile(r"[^\w\s.,;:!?'\"()-]")
LANGS, SOURCES = 16, 64
#: The struct that scoring adds to the columns of a table.
VERDICT = "quality_verdict__"
VIEWS = {"text": "meta", "meta": "text"}  # each view and the one that it labels documents for
MOST_SUMS = 64  # rows of sums that go to the driver in one pass


def text_view(text: str | None) -> list[float]:
    """Features of a whole text; null counts as empty."""
    text = text or ""
    n, words = max(1, len(text)), text.split()
    m, seen, lines = max(1, len(words)), Counter(words), text.split("\n")
    line_count = Counter(lines)
    upper = sum(map(str.isupper, words))
    signs, letters = len(SIGNS.findall(text)), sum(map(len, re.findall(r"[^\W\d_]+", text)))
    same = sum(map(str.__eq__, words, words[1:]))
    stops = sum(text.count(c) for c in ".?!")
    return [
        np.log1p(len(text)),
        np.log1p(len(words)),
        letters / n,
        sum(map(str.isdigit, text)) / n if any(map(text.__contains__, "0123456789")) else 0.0,
        signs / n,
        min(1.0, signs / m),
        text.count("!") / m,
        text.count("|") / m,
        upper / m,
        sum(map(len, words)) / m / 10,
        len(seen) / m,
        max(seen.values(), default=0) / m,
        same / m,
        stops / m,
        (len(lines) - len(line_count)) / len(lines),
        len(lines) / m,
        float(len(words) < 5),
        float(not words),
    ]


def _slot(value, slots: int) -> int:
    return -1 if value is None or value != value else xxhash.xxh64_intdigest(str(value)) % slots


def coded(text, lang, source, n_chars) -> list[float]:
    """A document as numbers: its text view, the slots of language and source, and its size; -1 and nan stand for null."""
    size = np.log1p(max(0.0, float(n_chars))) if n_chars is not None and n_chars == n_chars else np.nan
    return [*text_view(text), _slot(lang, LANGS), _slot(source, SOURCES), size]


def views_of(codes: np.ndarray) -> dict[str, np.ndarray]:
    """Both views of coded documents. That of the metadata has language, source and size; nulls have features of their own."""
    lang, source, size = codes[:, -3:].T
    meta = np.zeros((len(codes), LANGS + SOURCES + 3))
    for slot, start in ((lang, 0), (source, LANGS)):
        at = np.flatnonzero(slot >= 0)
        meta[at, start + slot[at].astype(int)] = 1
    known = np.nan_to_num(size)
    meta[:, -3:] = np.column_stack([known, known * known / 10, np.isnan(size)])
    return {"text": codes[:, :-3], "meta": meta}


@dataclass
class Linear:
    """A logistic model on standardised features, with a calibration of its score."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    slope: float = 1.0
    offset: float = 0.0

    def standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8)

    def of_standard(self, z: np.ndarray) -> np.ndarray:
        return self.slope * (z @ self.weights[1:] + self.weights[0]) + self.offset

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.of_standard(self.standard(x))


def _sigmoid(m: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(m, -30, 30)))


def _constant(x: np.ndarray) -> np.ndarray:
    return np.column_stack([np.ones(len(x)), x])


def total(rows: DataFrame, sums: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray | None:
    """``sums`` of codes and labels (nan where there is none), added up over all rows of ``y, codes``; no rows give None.

    Each task adds up its rows; where there are many tasks, their sums are added up on the executors once more.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        for batch in batches:
            (codes,), y = columns_of(batch, "codes"), batch.column(batch.schema.get_field_index("y"))
            if codes:
                own = sums(np.frombuffer(b"".join(codes)).reshape(len(codes), -1), y.to_numpy(zero_copy_only=False).astype(float))
                out = own if out is None else out + own
        if out is not None:
            slot = TaskContext.get().partitionId() % MOST_SUMS
            yield pa.RecordBatch.from_arrays([pa.array([slot], pa.int32()), pa.array([out.tobytes()], pa.binary())], ["slot", "sums"])

    def merge(table: pa.Table) -> pa.Table:
        out = sum(np.frombuffer(b.as_py()) for b in table.column("sums"))
        return pa.table({"slot": table.column("slot")[:1], "sums": pa.array([out.tobytes()], pa.binary())})

    parts = rows.select("y", "codes").mapInArrow(add, "slot int, sums binary")
    if rows.rdd.getNumPartitions() > MOST_SUMS:
        parts = parts.groupBy("slot").applyInArrow(merge, "slot int, sums binary")
    found = sorted(parts.collect(), key=lambda r: r["slot"])  # at most MOST_SUMS rows
    return sum(np.frombuffer(r["sums"]) for r in found) if found else None


def solve(rows: DataFrame, design: Callable, start: dict[str, np.ndarray], ridge: float, steps: int = 60) -> dict[str, np.ndarray]:
    """Ridge logistic regressions by Newton steps, several in one pass; the first column is constant and is not shrunk.

    ``design`` makes of codes and labels the features and targets of each regression, ``start`` has first weights.
    A step that raises the loss is halved.
    """
    weights, todo = dict(start), list(start)
    best: dict[str, tuple] = {}  # weights, loss and the step that was tried from there
    for _ in range(steps):
        at = {name: weights[name] for name in todo}

        def sums(codes: np.ndarray, y: np.ndarray) -> np.ndarray:
            made, out = design(codes, y), []
            for name, w in at.items():
                x, target = made[name]
                m = x @ w
                p = _sigmoid(m)
                v = np.maximum(p * (1 - p), 1e-9)
                out += [[(np.logaddexp(0, m) - target * m).sum()], x.T @ (target - p), ((x * v[:, None]).T @ x).ravel()]
            return np.concatenate(out)

        got = total(rows, sums)
        for name, w in at.items():
            n = len(w)
            loss, slope, curve, got = got[0], got[1 : n + 1], got[n + 1 : n + 1 + n * n].reshape(n, n), got[n + 1 + n * n :]
            shrink = np.full(n, ridge)
            shrink[0] = 1e-6
            loss = loss + (shrink * w * w).sum() / 2
            if name in best and not loss <= best[name][1] * (1 + 1e-9) + 1e-9:
                w, loss, step = best[name]
                step = step / 2
            else:
                step = np.linalg.solve(curve + np.diag(shrink), slope - shrink * w)
                step *= min(1.0, 4 / max(np.abs(step).max(), 1e-12))
            best[name], weights[name] = (w, loss, step), w + step
            if np.abs(step).max() < 1e-4:  # the error left is of the order of its square
                todo.remove(name)
        if not todo:
            break
    return weights


@dataclass
class CoTrained:
    """Both calibrated views and their combination. Without labels of both classes every score is null."""

    text: Linear | None
    meta: Linear | None
    mix: np.ndarray | None
    exchanged: tuple[int, int] = (0, 0)

    def scores(self, texts: np.ndarray, metas: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b = self.text.margin(texts), self.meta.margin(metas)
        both = self.mix[0] + self.mix[1] * np.clip(a, -12, 12) + self.mix[2] * np.clip(b, -12, 12)
        return _sigmoid(a), _sigmoid(b), _sigmoid(both)


def exchanged_labels(z: dict[str, np.ndarray], history: list[dict[str, Linear]], sure: float) -> dict[str, np.ndarray]:
    """What each view was told of documents by the other one in the rounds so far: 0, 1, or -1 for nothing.

    The first label that is sure counts. It follows from the models of the rounds, so no state of rows is kept.
    """
    told = {v: np.full(len(z[v]), -1.0) for v in VIEWS}
    for models in history:
        for view, other in VIEWS.items():
            p = _sigmoid(models[view].of_standard(z[view]))
            fresh = told[other] < 0
            told[other][fresh & (p >= sure)] = 1
            told[other][fresh & (1 - p >= sure)] = 0
    return told


def co_train(known: DataFrame, held: DataFrame, counts: dict, rounds: int = 5, sure: float = 0.95) -> CoTrained:
    """``known`` and ``held`` have ``y, codes``: all documents but those kept for calibration, and these.

    ``counts`` has the number of rows by (held, label). In a round a view passes on every label that it is sure of.
    """
    if not all(counts.get((h, y)) for h in (False, True) for y in (0, 1)):
        return CoTrained(None, None, None)
    n = sum(c for (h, _), c in counts.items() if not h)
    flat = lambda f: lambda codes, y: np.concatenate([f(v, x).sum(0) for v, x in views_of(codes).items()])
    split = lambda a: dict(zip(VIEWS, np.split(a, [len(a) - LANGS - SOURCES - 3])))
    mean = split(total(known, flat(lambda v, x: x)) / n)
    scale = split(np.sqrt(total(known, flat(lambda v, x: (x - mean[v]) ** 2)) / n))
    models = {v: Linear(mean[v], np.where(scale[v] < 1e-9, 1.0, scale[v]), np.zeros(len(mean[v]) + 1)) for v in VIEWS}
    ones, zeros = counts[True, 1], counts[True, 0]
    platt = {v: np.array([0.0, 1.0]) for v in VIEWS}
    history: list[dict[str, Linear]] = []
    pool = counts.get((False, None), 0)

    def standard(codes: np.ndarray) -> dict[str, np.ndarray]:
        return {v: models[v].standard(x) for v, x in views_of(codes).items()}

    def told(codes: np.ndarray, y: np.ndarray) -> dict:
        z = standard(codes)
        labels, out = exchanged_labels(z, history, sure), {}
        for v in VIEWS:
            target = np.where(np.isnan(y), labels[v], y)
            at = np.flatnonzero(target >= 0)
            out[v] = _constant(z[v][at]), target[at]
        return out

    def margins(codes: np.ndarray, y: np.ndarray) -> dict:
        target = np.where(y == 1, (ones + 1) / (ones + 2), 1 / (zeros + 2))
        return {v: (_constant((z @ models[v].weights[1:] + models[v].weights[0])[:, None]), target) for v, z in standard(codes).items()}

    def both(codes: np.ndarray, y: np.ndarray) -> dict:
        z = standard(codes)
        return {"mix": (_constant(np.column_stack([np.clip(models[v].of_standard(z[v]), -12, 12) for v in VIEWS])), y)}

    for turn in range(rounds + 1):
        weights = solve(known, told, {v: m.weights for v, m in models.items()}, 1.0)
        models = {v: Linear(m.mean, m.scale, weights[v]) for v, m in models.items()}
        platt = solve(held, margins, platt, 1e-3)
        models = {v: Linear(m.mean, m.scale, m.weights, platt[v][1].item(), platt[v][0].item()) for v, m in models.items()}
        if turn == rounds or not pool:
            break
        history = [*history, models]
    mix = solve(held, both, {"mix": np.zeros(3)}, 1e-2)["mix"]
    passed = (0, 0)
    if history:
        given = lambda codes, y: np.array([(a[np.isnan(y)] >= 0).sum() for a in exchanged_labels(standard(codes), history, sure).values()], float)
        passed = tuple(int(c) for c in total(known, given))
    return CoTrained(models["text"], models["meta"], mix, passed)


def train_quality(df: DataFrame, labels: DataFrame, rounds: int = 5, sure: float = 0.95) -> CoTrained:
    """Co-train on all documents, labelled or not; a quarter of the labelled ids, by hash, is held out for calibration.

    Labels are 0 or 1; others and labels of unknown documents are ignored; of several labels of one document the
    smallest counts. Documents without an id have no label.
    """
    kind = T.StructType([df.schema["doc_id"], T.StructField("codes", T.BinaryType())])

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = [np.array(coded(*row)).tobytes() for row in sliced(batch, "text", "lang", "source", "n_chars")]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("doc_id")), pa.array(codes, pa.binary())], ["doc_id", "codes"])

    labels = labels.filter("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy("doc_id").agg(F.min("quality").cast("double").alias("y"))
    rows = stored(df.mapInArrow(code, kind))
    unnamed = rows.filter("doc_id IS NULL").withColumn("y", F.lit(None).cast("double"))  # no join, where they would meet in one task
    rows = rows.filter("doc_id IS NOT NULL").join(labels, "doc_id", "left").unionByName(unnamed)
    chosen = F.pmod(F.xxhash64(F.concat(F.lit("held:"), F.col("doc_id").cast("string"))), F.lit(4)) == 0
    rows = stored(rows.select("y", F.coalesce(F.col("y").isNotNull() & chosen, F.lit(False)).alias("held"), "codes"))
    counts = {(r["held"], None if r["y"] is None else int(r["y"])): r["count"] for r in rows.groupBy("held", "y").count().collect()}
    return co_train(rows.filter("NOT held"), stored(rows.filter("held")), counts, rounds, sure)


def quality_score(model: CoTrained) -> Column:
    """Struct ``p_text, p_meta, score`` of the columns ``text, lang, source, n_chars``: probabilities of good quality."""

    @pandas_udf("struct<p_text: double, p_meta: double, score: double>")
    def score(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for text, lang, source, n_chars in parts:
            if model.text is None or not len(text):
                yield pd.DataFrame({c: [None] * len(text) for c in ("p_text", "p_meta", "score")}, dtype=float)
            else:
                views = views_of(np.array([coded(*row) for row in zip(text, lang, source, n_chars)]))
                yield pd.DataFrame(dict(zip(("p_text", "p_meta", "score"), model.scores(*views.values()))))

    return score("text", "lang", "source", "n_chars")


def score_quality(df: DataFrame, labels: DataFrame, reject_below: float = 0.5, **fit) -> DataFrame:
    """All columns of the input and the struct ``VERDICT`` with ``p_text, p_meta, score, keep``.

    The input has ``doc_id, text, lang, source, n_chars``, any of them null; other columns pass through. A document is
    rejected if its score is below ``reject_below``. Null texts count as empty. Rows are scored each, repeated ones
    alike; where labels of both classes are missing, scores are null and every document is kept.
    """
    model = train_quality(df.select("doc_id", "text", "lang", "source", "n_chars"), labels.select("doc_id", "quality"), **fit)
    scored = df.withColumn(VERDICT, quality_score(model))
    keep = F.coalesce(~(F.col(f"{VERDICT}.score") < reject_below), F.lit(True))
    return scored.withColumn(VERDICT, F.col(VERDICT).withField("keep", keep))
