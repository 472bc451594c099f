"""Quality scores by Bradley-Terry ranking.

A document's features are a fixed, short vector of shares and log counts of its whole text.
The weights are learned from preference pairs (a text of label 1 preferred to one of label 0):
the probability that a beats b is the logistic function of the weighted feature difference, and
the loss is its logarithm, with a small L2 term, minimised by Newton steps.  The threshold is a
quantile of the learned scores: that share of the labelled texts lies below which has label 0.
The score is a logistic function of the distance to the threshold, shifted so that the
threshold is ``cut``.

All distinct labelled texts are learned from, each once for each label that its copies have.  They are
dealt, in order of their hash, into blocks with up to BLOCK texts of each label, and the pairs are all
pairs of a block, so they grow with the texts, and a small table has every pair there is.  Means, Newton
sums and the threshold are taken over all blocks in Spark; the driver has one vector of each task.
Features are computed before labels are joined, so no text is moved.  Scoring is one pass without a shuffle.

Edge cases: null texts are scored as empty; labels other than 0 and 1, and label rows without a
document, are ignored; a text labelled twice alike counts once; without labels of both kinds
every score is ``cut``; repeated rows are scored each; other columns pass through, and columns
of the result's names are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import quoted, stored
from plumbline.plans import ordering

#: Rows of one label in a block; all pairs of a block are learned from.
BLOCK = 512
CUT = 0.3
L2 = 1e-3

_LOWER = bytes(range(0x61, 0x7B))
_UPPER = bytes(range(0x41, 0x5B))
_DIGIT = bytes(range(0x30, 0x3A))
_SPACE = b" \t\n\r\x0b\x0c"
_MARKS = b"#*$%&|<>=_~^@\\{}[]"
_ENDS = b".!?"


def features(text: str | None) -> list[float]:
    """The vector of one text."""
    raw = (text or "").encode()
    n = len(raw)
    count = lambda chars: n - len(raw.translate(None, chars))
    words = raw.split()
    k = len(words)
    per_char, per_word = 1 / max(1, n), 1 / max(1, k)
    distinct = len(set(words))
    repeats = sum(map(bytes.__eq__, words[1:], words[:-1])) if k > 1 else 0
    lines = [x for x in raw.split(b"\n") if x.strip()]
    upper, lower = count(_UPPER), count(_LOWER)
    ends = [w[-1:] for w in words]
    return [
        1.0 if n == 0 else 0.0,
        float(np.log1p(k)),
        upper * per_char,
        upper / max(1, upper + lower),
        count(_DIGIT) * per_char,
        count(_MARKS) * per_char,
        count(_SPACE) * per_char,
        count(_ENDS) * per_word,
        count(b"!") * per_word,
        raw.count(b"|") * per_word,
        count(b",;:") * per_word,
        distinct * per_word,
        distinct / max(1.0, k**0.8),
        repeats * per_word,
        (n - count(_SPACE)) * per_word / 10,
        max(map(len, words), default=0) ** 0.5 / 10,
        sum(map(len, map(bytes.strip, lines))) / max(1, len(lines)) / 1000,
        1 - len(set(lines)) / max(1, len(lines)),
        ends.count(b"!") * per_word,
        sum(len(w) == 1 for w in words) * per_word,
    ]


def _terms(good: np.ndarray, bad: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and Hessian of the loss of all pairs of a good and a bad row."""
    p = 1 / (1 + np.exp(-np.clip((good @ w)[:, None] - bad @ w, -30, 30)))
    off, bend = p - 1, p * (1 - p)
    gradient = off.sum(1) @ good - off.sum(0) @ bad
    cross = good.T @ bend @ bad
    return gradient, good.T @ (good * bend.sum(1)[:, None]) + bad.T @ (bad * bend.sum(0)[:, None]) - cross - cross.T


def _newton(terms, width: int, pairs: int) -> np.ndarray:
    """The weights; ``terms(w)`` is the sum of gradient and Hessian over all pairs."""
    w = np.zeros(width)
    for _ in range(25):
        gradient, hessian = terms(w)
        step = np.linalg.solve(hessian / pairs + L2 * np.eye(width), gradient / pairs + L2 * w)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(x: np.ndarray, y: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """(mean, scale, weights, threshold) from features and labels in memory, as ``learn`` has them from a table."""
    scale = x.std(0)
    scale = np.where(scale > 1e-9, scale, 1.0)
    z = (x - x.mean(0)) / scale
    good, bad = z[y == 1], z[y == 0]
    n = max(1, -(-max(len(good), len(bad)) // block))
    sides = [(good[np.arange(i, max(len(good), i + 1), n) % len(good)], bad[np.arange(i, max(len(bad), i + 1), n) % len(bad)]) for i in range(n)]
    w = _newton(lambda w: [sum(t) for t in zip(*[_terms(a, b, w) for a, b in sides])], x.shape[1], sum(len(a) * len(b) for a, b in sides))
    s = np.sort((z * w).sum(axis=1))
    return x.mean(0), scale, w, float((s[len(bad) - 1] + s[len(bad)]) / 2)


def _marked(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(id, h, f): each row's text hash and features."""
    rows = docs.select(quoted(doc_id).alias("id"), F.xxhash64(quoted(text)).alias("h"), quoted(text).alias("t"))
    schema = T.StructType([rows.schema["id"], T.StructField("h", T.LongType()), T.StructField("f", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = pa.array([features(v.as_py()) for v in b.column(2)], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), f], names=schema.names)

    return rows.mapInArrow(run, schema)


def _blocks(rows: DataFrame, sizes: dict[int, int], block: int) -> DataFrame:
    """(block, m): the rows (h, y, f) dealt into blocks in order of their hash; m is an array of (y, own, f).

    The larger class has at most ``block`` rows in each.  A class of fewer rows than there are
    blocks is gone through again: such rows are not ``own``.
    """
    n = -(-max(sizes.values()) // block)
    laid = ordering.row_numbers(rows, [F.col("h")], "rn", ["y"])
    at, size = F.col("rn") - 1, F.when(F.col("y") == 1, sizes[1]).otherwise(sizes[0])
    to = F.when(size < n, F.sequence(at % n, F.greatest(at % n, F.lit(n - 1)), size)).otherwise(F.array(at % n))
    laid = laid.select("y", "f", at.alias("at"), F.explode(to).alias("block"))
    laid = laid.select("block", F.struct("y", (F.col("at") % n == F.col("block")).alias("own"), "f").alias("m"))
    return stored(laid.groupBy("block").agg(F.sort_array(F.collect_list("m")).alias("m")), "quality-blocks")


def _unpacked(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(y, own, f) of each block."""
    for m in b.column(b.schema.get_field_index("m")):
        m = m.values
        f = m.field("f").flatten().to_numpy(zero_copy_only=False).reshape(len(m), -1)
        yield np.array(m.field("y")), np.array(m.field("own")), f


def _summed(blocks: DataFrame, of) -> np.ndarray:
    """The sum of the vectors ``of(y, own, f)`` over all blocks; a task sends one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, total = None, 0.0
        for b in batches:
            first = b.column(0)[0].as_py() if first is None and b.num_rows else first
            for y, own, f in _unpacked(b):
                total = total + of(y, own, f)
        if first is not None:
            yield pa.RecordBatch.from_arrays([pa.array([first]), pa.array([total.tolist()])], names=["first", "v"])

    return np.sum([r["v"] for r in sorted(blocks.mapInArrow(run, "first bigint, v array<double>").collect())], axis=0)


def learn(
    docs: DataFrame, labels: DataFrame, train: Column, doc_id: str = "doc_id", text: str = "text",
    label: str = "quality", sample_rows: int | None = None, block: int = BLOCK, cut: float = CUT,
) -> tuple:
    """The model, from all labelled rows of ``docs`` where ``train`` holds (``sample_rows`` texts of them, if it is given)."""
    marked = labels.select(quoted(doc_id).alias("id"), quoted(label).cast("int").alias("y")).where("y in (0, 1)").distinct()
    # No text is moved; copies of a text count once for each label that they have.
    rows = _marked(docs.where(train), doc_id, text).join(marked, "id").groupBy("h").agg(F.first("f").alias("f"), F.collect_set("y").alias("y"))
    rows = rows if sample_rows is None else rows.orderBy("h").limit(sample_rows)
    rows = stored(rows.select("h", F.explode("y").alias("y"), "f"), "quality-rows")
    sizes = {0: 0, 1: 0} | {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    width = len(features(""))
    if not all(sizes.values()):
        return np.zeros(width), np.ones(width), np.zeros(width), 0.0, cut
    blocks, n = _blocks(rows, sizes, block), sum(sizes.values())
    mean = _summed(blocks, lambda y, own, f: f[own].sum(0)) / n
    scale = np.sqrt(_summed(blocks, lambda y, own, f: ((f[own] - mean) ** 2).sum(0)) / n)
    scale = np.where(scale > 1e-9, scale, 1.0)
    pairs = int(_summed(blocks, lambda y, own, f: np.array([float((y == 1).sum() * (y == 0).sum())]))[0])

    def terms(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        def of(y: np.ndarray, own: np.ndarray, f: np.ndarray) -> np.ndarray:
            z = (f - mean) / scale
            gradient, hessian = _terms(z[y == 1], z[y == 0], w)
            return np.concatenate([gradient, hessian.ravel()])

        v = _summed(blocks, of)
        return v[:width], v[width:].reshape(width, width)

    w = _newton(terms, width, pairs)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, own, f in _unpacked(b):
                yield pa.RecordBatch.from_arrays([pa.array(((f[own] - mean) / scale * w).sum(axis=1))], names=["s"])

    ranked = ordering.row_numbers(blocks.mapInArrow(scored, "s double"), [F.col("s")])
    low, high = (r["s"] for r in ranked.where(F.col("rn").isin(sizes[0], sizes[0] + 1)).orderBy("rn").collect())
    return mean, scale, w, float((low + high) / 2), cut


def score(docs: DataFrame, model: tuple, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with score (0 to 1) and predicted (1 if score >= the model's cut, else 0)."""
    mean, scale, w, threshold, cut = model
    new = [("score", T.DoubleType()), ("predicted", T.IntegerType())]
    names = {n for n, _ in new}
    kept = [f for f in docs.schema.fields if f.name.lower() not in names and (keep is None or f.name in keep)]
    keep = [f.name for f in kept]
    at = docs.columns.index(text)
    schema = T.StructType([*kept, *[T.StructField(n, kind) for n, kind in new]])
    shift = float(np.log(cut / (1 - cut)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([features(v.as_py()) for v in b.column(at)], float).reshape(b.num_rows, len(w))
            s = ((x - mean) / scale * w).sum(axis=1) - threshold  # row by row, so that a batch's size is not seen
            p = np.where(s == 0, cut, 1 / (1 + np.exp(-np.clip(s + shift, -500, 500))))
            columns = [b.column(i) for i, n in enumerate(b.schema.names) if n in keep]
            columns += [pa.array(p), pa.array((p >= cut).astype("int32"))]
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema.fields])

    return docs.mapInArrow(run, schema)
