"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad. Its potential is linear in features of the line and
of the lines before and after it; neighbouring labels have a transition
potential. Forward-backward gives each line's marginal, and a document's score
is the mean of its lines' marginals of good, weighted by length.

The field is fitted by gradient ascent on a bounded sample of labelled documents
(``SAMPLE`` of them, smallest hash first), whose lines all carry the document's
label. Its parameters are a few dozen numbers. All documents are scored whole.

Defined cases: null text counts as empty and is one empty line; with no labelled
document, or labels of one kind only, every score is that label's share (0.5
without any); a document labelled twice takes the lower label; repeated rows
each get the same score; an empty table gives an empty result; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE = 4000
FOLDS = 5
THRESHOLD = 0.3
OWN = 13

# classes of bytes: 0 lower case or beyond ASCII, 1 upper case, 2 digit, 3 space, 4 bar, 5 sentence mark, 6 other sign
_CLASS = np.full(256, 6, np.uint8)
_CLASS[ord("a") : ord("z") + 1] = 0
_CLASS[128:] = 0
_CLASS[ord("A") : ord("Z") + 1] = 1
_CLASS[ord("0") : ord("9") + 1] = 2
_CLASS[[9, 10, 11, 12, 13, 32]] = 3
_CLASS[ord("|")] = 4
_CLASS[[ord(c) for c in ".,;:'-\"?"]] = 5


def line_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(lines x OWN features, byte lengths) of a text's lines."""
    lines = (text or "").split("\n")
    out = np.zeros((len(lines), OWN), np.float32)
    size = np.zeros(len(lines), np.float64)
    seen: set[str] = set()
    for i, line in enumerate(lines):
        raw = np.frombuffer(line.encode(), np.uint8)
        n = size[i] = len(raw)
        if not n:
            continue
        share = np.bincount(_CLASS[raw], minlength=7) / n
        words = line.split()
        k = max(len(words), 1)
        out[i, :7] = share
        out[i, 7] = np.log1p(n) / 6
        out[i, 8] = len(set(words)) / k
        out[i, 9] = sum(map(operator.eq, words, words[1:])) / k
        out[i, 10] = min(n / k / 12, 3)
        out[i, 11] = line in seen
        out[i, 12] = line.rstrip()[-1:] in (".", "!", "?")
        seen.add(line)
    return out, size


def with_neighbours(own: np.ndarray) -> np.ndarray:
    """Features of each line, its predecessor and its successor, and a constant."""
    zero = np.zeros((1, own.shape[1]), own.dtype)
    return np.hstack([np.ones((len(own), 1), own.dtype), own, np.vstack([zero, own[:-1]]), np.vstack([own[1:], zero])])


def marginals(score: np.ndarray, step: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward over a padded batch: P(good) for each line, expected transitions of the batch, log partition.

    score: documents x lines, the potential of good (bad has 0). step: 2 x 2 potentials.
    """
    n, t = score.shape
    node = np.stack([np.zeros_like(score), score], 2)
    fwd, bwd = np.zeros((t, n, 2)), np.zeros((t, n, 2))
    fwd[0] = node[:, 0]
    for i in range(1, t):
        on = (i < length)[:, None]
        to = np.logaddexp(fwd[i - 1][:, 0:1] + step[0], fwd[i - 1][:, 1:2] + step[1]) + node[:, i]
        fwd[i] = np.where(on, to, fwd[i - 1])
    log_z = np.logaddexp(fwd[t - 1][:, 0], fwd[t - 1][:, 1])
    moved = np.zeros((2, 2))
    for i in range(t - 2, -1, -1):
        on = (i + 1 < length)[:, None]
        after = node[:, i + 1] + bwd[i + 1]
        back = np.logaddexp(step[:, 0] + after[:, 0:1], step[:, 1] + after[:, 1:2])
        bwd[i] = np.where(on, back, bwd[i + 1])
        both = np.exp(fwd[i][:, :, None] + step + after[:, None, :] - log_z[:, None, None])
        moved += (both * on[:, :, None]).sum(0)
    good = np.exp(np.minimum(fwd[:, :, 1] + bwd[:, :, 1] - log_z, 0)).T
    return good, moved, log_z


def _padded(feats: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    length = np.array([len(f) for f in feats])
    x = np.zeros((len(feats), length.max(), feats[0].shape[1]), np.float32)
    for i, f in enumerate(feats):
        x[i, : len(f)] = f
    return x, length


def _groups(lengths: list[int], cells: int = 200_000) -> Iterator[list[int]]:
    """Documents of similar length together, so that padding stays small and a batch bounded."""
    group: list[int] = []
    for i in np.argsort(lengths, kind="stable").tolist():
        if group and (lengths[i] * (len(group) + 1) > cells or lengths[i] > 2 * lengths[group[0]] + 8):
            yield group
            group = []
        group.append(i)
    if group:
        yield group


def fit_field(feats: list[np.ndarray], labels: list[int], steps: int = 300, rate: float = 0.1, decay: float = 1e-5) -> tuple[np.ndarray, np.ndarray]:
    """(weights, 2 x 2 steps) of largest penalised likelihood, every line labelled as its document is."""
    width = feats[0].shape[1]
    scale = np.sqrt(sum((f.astype(np.float64) ** 2).sum(0) for f in feats) / sum(len(f) for f in feats)) + 1e-9
    feats = [f / scale for f in feats]
    batches = [(*_padded([feats[i] for i in g]), np.array([labels[i] for i in g])) for g in _groups([len(f) for f in feats])]
    total = sum(len(f) for f in feats)
    theta, m, v = np.zeros(width + 4), np.zeros(width + 4), np.zeros(width + 4)
    for k in range(1, steps + 1):
        grad = np.zeros_like(theta)
        w, step = theta[:width], theta[width:].reshape(2, 2)
        for x, length, y in batches:
            good, moved, _ = marginals(x @ w, step, length)
            on = np.arange(x.shape[1]) < length[:, None]
            grad[:width] += np.einsum("ntf,nt->f", x, (y[:, None] - good) * on)
            seen = np.zeros((2, 2))
            seen[0, 0], seen[1, 1] = (length - 1)[y == 0].sum(), (length - 1)[y == 1].sum()
            grad[width:] += (seen - moved).ravel()
        grad = grad / total - decay * theta
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        theta += rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    return theta[:width] / scale, theta[width:].reshape(2, 2)


def document_scores(texts: list[str | None], weights: np.ndarray, step: np.ndarray) -> np.ndarray:
    """Length-weighted mean of P(good) over the lines of each text."""
    found = [line_features(t) for t in texts]
    out = np.zeros(len(texts))
    for group in _groups([len(f) for f, _ in found]):
        x, length = _padded([with_neighbours(found[i][0]) for i in group])
        good, _, _ = marginals(x.astype(np.float64) @ weights, step, length)
        for row, i in enumerate(group):
            size = found[i][1] + 1.0
            out[i] = (good[row, : length[row]] * size).sum() / size.sum()
    return np.clip(out, 0.0, 1.0)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE, folds: int = FOLDS):
    """Learns from labelled documents outside the held-out fold; returns a model for `score`."""
    from .base import held_out

    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col, folds))
    known = known.groupBy(F.col(id_col).alias("k")).agg(F.min(label_col).cast("int").alias("y"))
    known = known.orderBy(F.xxhash64("k"), "k").limit(sample)  # bounded, so it may be broadcast
    rows = (
        docs.select(F.col(id_col).alias("k"), F.col(text_col).alias("text")).join(F.broadcast(known), "k")
    )

    def features(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"k": frame["k"], "y": frame["y"], "f": [line_features(t)[0].tobytes() for t in frame["text"]]})

    got = sorted((r.k, r.y, bytes(r.f)) for r in rows.mapInPandas(features, "k long, y int, f binary").toLocalIterator())
    ys = [y for _, y, _ in got]
    if len(set(ys)) < 2:
        share = ys[0] if ys else 0.5
        return None, float(share)
    feats = [with_neighbours(np.frombuffer(f, np.float32).reshape(-1, OWN)) for _, _, f in got]
    return fit_field(feats, ys)


def score(docs: DataFrame, model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """docs with a column more: the score, 0 to 1."""
    weights, step = model

    @F.pandas_udf("double")
    def of(texts: pd.Series) -> pd.Series:
        if weights is None:
            return pd.Series(np.full(len(texts), step))
        # features of a part at a time, as those of a whole batch take a worker more than its texts
        parts = [document_scores(texts.iloc[at : at + 500].tolist(), weights, step) for at in range(0, len(texts), 500)]
        return pd.Series(np.concatenate(parts) if parts else np.zeros(0))

    return docs.withColumn(score_col, of(F.col(text_col)))
