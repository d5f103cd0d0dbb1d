"""Document quality by a generalised additive model with pairwise interactions.

Every feature is cut into quantile bins and has a lookup table; chosen pairs of features
have a table of their own over coarser bins. The tables are learned by cyclic boosting:
round after round each feature in turn gets a shallow regression tree (at most four
leaves, Newton steps of the logistic loss), shrunk and added to its table; then the pairs
that explain most of what is left get theirs. A score is a sum of table entries, which
is a few vectorised gathers for a batch of texts.

Training reads about ``sample_docs`` labelled documents, chosen by a hash of the id; all
of them if there are fewer. Scoring reads every whole text.

Edge cases: null and empty texts have all features zero and a score like any other; a very
long text is measured whole; rows
whose label is null are not learned from; labels of one class give a constant score;
repeated labels of an id count once, the largest; an empty table gives an empty result;
other columns are not read by the score and pass through ``keep_good`` under any name.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import require_free, slices

SAMPLE_DOCS = 12_000
BINS, PAIR_BINS, PAIRS = 48, 12, 10
ROUNDS, PAIR_ROUNDS, RATE = 120, 60, 0.12
THRESHOLD = 0.3

FEATURES = (
    "log_chars", "log_words", "word_length", "upper", "letters", "digits", "marks", "odd_marks", "stops", "commas", "exclaims", "pipes", "breaks", "wide",
    "distinct_words", "top_word", "same_as_last", "long_words", "one_letter", "capital_words", "shouted_words", "marked_words", "pair_repeat",
    "line_words", "repeated_lines", "lines_ended", "worst_tenth_marks", "worst_tenth_upper", "worst_tenth_repeat", "entropy",
)

_CLASS = np.zeros((9, 256))
for _k, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", b"#$%&*+<=>@[\\]^_`{|}~", b".", b",", b"!", b"|")):
    _CLASS[_k, list(_chars)] = 1
_MARKED = re.compile(r"[#$%&*=@^_`{}|~<>\\]|!!|\?\?")


def features_of(text: str) -> list[float]:
    """The features of one whole text, in the order of FEATURES."""
    words = text.split()
    if not words:
        return [float(np.log1p(len(text)))] + [0.0] * (len(FEATURES) - 1)
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    hist = np.bincount(raw, minlength=256)
    upper, lower, digits, marks, odd, stops, commas, exclaims, pipes = _CLASS @ hist
    chars, n = len(text), len(words)
    wide = chars - int(hist[:128].sum())
    counts = Counter(words)
    sizes = np.fromiter(map(len, words), np.int64, n)
    shout = np.fromiter(map(str.isupper, words), bool, n) & (sizes > 2)
    capital = np.fromiter(map(str.istitle, words), bool, n)
    odd_word = np.fromiter((_MARKED.search(w) is not None for w in words), bool, n)
    same = np.fromiter((a == b for a, b in zip(words, words[1:])), bool, n - 1)
    pairs = len(set(zip(words, words[1:])))
    lines = [x for x in map(str.strip, text.split("\n")) if x]
    p = np.array(list(counts.values())) / n
    part = max(8, n // 10)

    def worst(flags: np.ndarray) -> float:
        sums = np.concatenate([[0], np.cumsum(flags)])
        width = min(part, len(flags))
        return float((sums[width:] - sums[:-width]).max() / width) if width else 0.0

    return [
        float(np.log1p(chars)), float(np.log1p(n)), float(sizes.mean()), upper / max(1.0, upper + lower + wide), (upper + lower + wide) / chars, digits / chars, marks / chars, odd / chars,
        stops / n, commas / n, exclaims / n, pipes / n, float(hist[10]) / n, wide / chars,
        len(counts) / n, max(counts.values()) / n, float(same.mean()) if n > 1 else 0.0, float((sizes > 14).mean()), float((sizes == 1).mean()), float(capital.mean()), float(shout.mean()), float(odd_word.mean()), 1 - pairs / max(1, n - 1),
        n / max(1, len(lines)), 1 - len(set(lines)) / max(1, len(lines)), sum(x[-1] in ".!?…\"')" for x in lines) / max(1, len(lines)), worst(odd_word), worst(shout), worst(same), float(-(p * np.log(p)).sum() / max(1.0, np.log(n))),
    ]


@dataclass
class AdditiveModel:
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)
    base: float = 0.0

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.edges)], 1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        total = np.full(len(x), self.base)
        for j, t in enumerate(self.tables):
            total += t[b[:, j]]
        for (i, j), t in zip(self.pairs, self.pair_tables):
            total += t[self.coarse[i][b[:, i]], self.coarse[j][b[:, j]]]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -30, 30)))


def _best_cut(g: np.ndarray, h: np.ndarray, n: np.ndarray, least: int = 8, ridge: float = 1.0) -> tuple[float, int]:
    """(gain, number of bins on the left) of the best split of a run of bins."""
    gl, hl, nl = np.cumsum(g)[:-1], np.cumsum(h)[:-1], np.cumsum(n)[:-1]
    if not len(gl):
        return 0.0, 0
    gain = gl**2 / (hl + ridge) + (g.sum() - gl) ** 2 / (h.sum() - hl + ridge) - g.sum() ** 2 / (h.sum() + ridge)
    gain[(nl < least) | (n.sum() - nl < least)] = -1
    k = int(np.argmax(gain))
    return float(gain[k]), k + 1


def shallow_tree(g: np.ndarray, h: np.ndarray, n: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Leaf value of every bin, at most four leaves."""
    leaves = [(0, len(g))]
    for _ in range(2):
        nxt = []
        for a, b in leaves:
            gain, k = _best_cut(g[a:b], h[a:b], n[a:b])
            nxt += [(a, a + k), (a + k, b)] if gain > 1e-6 else [(a, b)]
        leaves = nxt
    out = np.zeros(len(g))
    for a, b in leaves:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + ridge)
    return out


def pair_tree(g: np.ndarray, h: np.ndarray, n: np.ndarray, ridge: float = 1.0) -> tuple[float, np.ndarray]:
    """(gain, cell values): one cut along the first axis, one along the second on each side; or the axes exchanged."""
    best = (0.0, np.zeros(g.shape))
    for flip in (False, True):
        a, b, c = (x.T if flip else x for x in (g, h, n))
        for k in range(1, a.shape[0]):
            value, gain = np.zeros(a.shape), -a.sum() ** 2 / (b.sum() + ridge)
            for rows in (slice(0, k), slice(k, None)):
                gs, hs, ns = a[rows].sum(0), b[rows].sum(0), c[rows].sum(0)
                got, cut = _best_cut(gs, hs, ns)
                for cols in (slice(0, cut), slice(cut, None)) if got > 1e-6 else (slice(None),):
                    gg, hh = gs[cols].sum(), hs[cols].sum()
                    value[rows, cols] = gg / (hh + ridge)
                    gain += gg**2 / (hh + ridge)
            if gain > best[0]:
                best = (float(gain), value.T if flip else value)
    return best


def fit_additive(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, pair_rounds: int = PAIR_ROUNDS, n_pairs: int = PAIRS, rate: float = RATE) -> AdditiveModel:
    """Cyclic boosting of single features, then of the pairs that gain most."""
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) if len(x) else np.zeros(0) for j in range(x.shape[1])]
    model = AdditiveModel(edges, [np.zeros(len(e) + 1) for e in edges])
    model.coarse = [(np.arange(len(e) + 1) * PAIR_BINS) // (len(e) + 1) for e in edges]
    share = float(np.clip(y.mean(), 1e-4, 1 - 1e-4)) if len(y) else 0.5
    model.base = float(np.log(share / (1 - share)))
    if not len(y) or y.min() == y.max():
        return model
    b = model.bins(x)
    score = np.full(len(x), model.base)
    widths = [len(t) for t in model.tables]
    counts = [np.bincount(b[:, j], minlength=w) for j, w in enumerate(widths)]
    for _ in range(rounds):
        for j, w in enumerate(widths):
            if w < 2:
                continue
            p = 1 / (1 + np.exp(-score))
            tree = rate * shallow_tree(np.bincount(b[:, j], y - p, w), np.bincount(b[:, j], p * (1 - p), w), counts[j])
            model.tables[j] += tree
            score += tree[b[:, j]]
    coarse = np.stack([model.coarse[j][b[:, j]] for j in range(b.shape[1])], 1)
    p = 1 / (1 + np.exp(-score))
    gains = []

    def grids(i: int, j: int, p: np.ndarray) -> tuple[np.ndarray, ...]:
        cell = coarse[:, i] * PAIR_BINS + coarse[:, j]
        return tuple(np.bincount(cell, w, PAIR_BINS**2).reshape(PAIR_BINS, PAIR_BINS) for w in (y - p, p * (1 - p), None))

    for i in range(len(widths)):
        for j in range(i + 1, len(widths)):
            gains.append((pair_tree(*grids(i, j, p))[0], i, j))
    for gain, i, j in sorted(gains, reverse=True)[:n_pairs]:
        if gain > 1e-3:
            model.pairs.append((i, j))
            model.pair_tables.append(np.zeros((PAIR_BINS, PAIR_BINS)))
    for _ in range(pair_rounds):
        for k, (i, j) in enumerate(model.pairs):
            p = 1 / (1 + np.exp(-score))
            tree = rate * pair_tree(*grids(i, j, p))[1]
            model.pair_tables[k] += tree
            score += tree[coarse[:, i], coarse[:, j]]
    return model


def text_features(df: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` and the array ``features`` for every row."""
    kinds = dict(df.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "features array<double>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, text, 1_000_000):
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array([features_of(t) for t in texts], pa.list_(pa.float64()))], [*keep, "features"])

    return df.select(*keep, text).mapInArrow(run, schema)


def fit_quality(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "quality", sample_docs: int = SAMPLE_DOCS) -> AdditiveModel:
    """Learn ``label`` (0 or 1) from ``labels``, all of whose rows may be learned from."""
    known = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(label).alias("_label"))
    total = known.count()
    draw = F.pmod(F.xxhash64(F.col(id_col), F.lit("quality")), F.lit(1 << 30)) / float(1 << 30)
    # about sample_docs rows of an id and a label, whatever the table's size
    sample = known.where(draw < min(1.0, sample_docs / max(1, total)))
    rows = text_features(df.select(id_col, text).join(F.broadcast(sample), id_col), [id_col, "_label"], text).toPandas().sort_values(id_col, kind="stable")
    x = np.array(rows["features"].tolist(), float).reshape(-1, len(FEATURES))
    return fit_additive(x, rows["_label"].to_numpy(float))


def score_quality(df: DataFrame, model: AdditiveModel, keep: list[str], text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``keep``, score (0 to 1, higher: label 1 likelier) and predicted (1 if score >= threshold) for every row.

    A kept column named like an output is an error; ``keep_good`` takes any."""
    require_free(df.select(*keep), ["score", "predicted"])
    shared = df.sparkSession.sparkContext.broadcast(model)
    kinds = dict(df.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "score double, predicted int"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, text, 1_000_000):
            s = shared.value.score(np.array([features_of(t) for t in texts], float).reshape(-1, len(FEATURES)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(s), pa.array((s >= threshold).astype(np.int32))], [*keep, "score", "predicted"])

    return df.select(*dict.fromkeys([*keep, text])).mapInArrow(run, schema)


def keep_good(df: DataFrame, model: AdditiveModel, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``df`` whose score reaches the threshold; columns may have any name."""
    own = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(text).alias("text"))
    return score_quality(own, model, ["row"], "text", threshold).where("predicted = 1").select("row.*")
