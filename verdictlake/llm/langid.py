"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. The
probability of a word is the sum over all its segmentations into pieces, by a forward
algorithm; a text's score is the product over its words, and the posterior under equal
priors is the confidence. Piece probabilities are fitted by expectation-maximisation
(forward and backward sums) on word counts of a bounded sample.

The sample: each language gives about ``sample_docs`` training documents, chosen by a
hash of the id; all of them if it has fewer. Prediction reads every whole text.

Edge cases: a null text, or one without a letter, is ``und`` with score 0; characters
outside the vocabulary have one small probability in every language; ties go to the
first language by name; rows without a language are not learned from; a very long text is
scored whole, word by word; more than
``max_langs`` languages are an error; an empty table gives an empty result and needs no
model; other columns are not read, so they can't leak into a prediction, and may have
any name.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices

LETTERS = re.compile(r"[^\W\d_]+")
MARK = "▁"
SAMPLE_DOCS, MAX_LANGS = 400, 256
CACHE_WORDS = 200_000
UNKNOWN = 1e-7


def load_pieces(path: str) -> list[str]:
    """The vocabulary's pieces in small letters, with MARK for a word's start."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)))
    return sorted({p.lower() for p in pieces})


def words_of(text: str) -> list[str]:
    """Runs of letters in small letters."""
    words = LETTERS.findall(text.lower())
    return words if any(c.isalpha() for w in words for c in w) else []


class Lattice:
    """All pieces of all words: edges (word, begin, end, piece), grouped by their end."""

    def __init__(self, words: list[str], number: dict[str, int], prefixes: set[str]):
        self.n = len(words)
        unknown = len(number)
        word, begin, end, piece = [], [], [], []
        for k, w in enumerate(words):
            w = MARK + w
            for b in range(len(w)):
                single = False
                for e in range(b + 1, len(w) + 1):
                    s = w[b:e]
                    i = number.get(s)
                    if i is not None:
                        word.append(k)
                        begin.append(b)
                        end.append(e)
                        piece.append(i)
                        single |= e == b + 1
                    if s not in prefixes:
                        break
                if not single:
                    word.append(k)
                    begin.append(b)
                    end.append(b + 1)
                    piece.append(unknown)
        self.word, self.begin, self.end, self.piece = (np.array(x, np.int64) for x in (word, begin, end, piece))
        self.length = np.array([len(w) + 1 for w in words], np.int64)
        self.longest = int(self.length.max(initial=0))
        #: characters after which alphas are rescaled: no shorter than a piece
        self.span = max(16, int((self.end - self.begin).max(initial=1)))

    def _groups(self, key: np.ndarray) -> list[np.ndarray]:
        order = np.argsort(key, kind="stable")
        cuts = np.searchsorted(key[order], np.arange(self.longest + 2))
        return [order[a:b] for a, b in zip(cuts, cuts[1:])]

    def forward(self, prob: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(alpha, log of what each word's alphas were divided by): alpha[w, i] sums the segmentations of the first i characters.

        prob: pieces by languages. Every ``span`` characters a word's recent alphas, as many, are rescaled."""
        langs = prob.shape[1]
        alpha = np.zeros((self.n, self.longest + 1, langs))
        alpha[:, 0] = 1
        scale = np.zeros((self.n, langs))
        for e, at in enumerate(self._groups(self.end)):
            if not len(at):
                continue
            w, b = self.word[at], self.begin[at]
            value = alpha[w, b] * prob[self.piece[at]]
            first = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]])) if (np.diff(w) >= 0).all() else None
            if first is None:
                np.add.at(alpha[:, e], w, value)
            else:
                alpha[w[first], e] = np.add.reduceat(value, first)
            if e % self.span == 0:
                live = np.flatnonzero(self.length >= e)
                top = alpha[live, e - self.span + 1 : e + 1].max(1)
                alpha[live, e - self.span + 1 : e + 1] /= top[:, None]
                scale[live] += np.log(top)
        return alpha, scale

    def log_prob(self, prob: np.ndarray) -> np.ndarray:
        """Log probability of each word in each language."""
        alpha, scale = self.forward(prob)
        return np.log(alpha[np.arange(self.n), self.length]) + scale

    def expected(self, prob: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Expected piece counts, words weighted by ``weight`` (words by languages); sums of logs, so that no length underflows."""
        if not len(self.word):
            return np.zeros(prob.shape)
        edge = np.log(prob)[self.piece]
        alpha = np.full((self.n, self.longest + 1, prob.shape[1]), -np.inf)
        alpha[:, 0] = 0
        for e, at in enumerate(self._groups(self.end)):
            np.logaddexp.at(alpha[:, e], self.word[at], alpha[self.word[at], self.begin[at]] + edge[at])
        beta = np.full_like(alpha, -np.inf)
        beta[np.arange(self.n), self.length] = 0
        for b, at in reversed(list(enumerate(self._groups(self.begin)))):
            np.logaddexp.at(beta[:, b], self.word[at], beta[self.word[at], self.end[at]] + edge[at])
        total = alpha[np.arange(self.n), self.length]
        share = np.exp(alpha[self.word, self.begin] + edge + beta[self.word, self.end] - total[self.word]) * weight[self.word]
        out = np.zeros(prob.shape)
        np.add.at(out, self.piece, share)
        return out


class UnigramModel:
    """Piece probabilities for each language; the last row stands for unknown characters."""

    def __init__(self, langs: list[str], pieces: list[str], prob: np.ndarray):
        self.langs, self.pieces, self.prob = langs, pieces, prob

    def __getstate__(self) -> dict:
        return {"langs": self.langs, "pieces": self.pieces, "prob": self.prob}

    def __setstate__(self, state: dict) -> None:
        self.__init__(**state)

    def _open(self) -> None:
        if not hasattr(self, "number"):
            self.number = {p: i for i, p in enumerate(self.pieces)}
            self.prefixes = {p[:k] for p in self.pieces for k in range(1, len(p) + 1)}
            self.slot: dict[str, int] = {}
            self.rows = np.zeros((0, len(self.langs)))

    def lattice(self, words: list[str]) -> Lattice:
        self._open()
        return Lattice(words, self.number, self.prefixes)

    @classmethod
    def fit(cls, counts: dict[str, Counter], pieces: list[str], rounds: int = 4, smoothing: float = 0.05) -> UnigramModel:
        """From word counts of each language."""
        langs = sorted(counts)
        model = cls(langs, pieces, np.zeros((len(pieces) + 1, len(langs))))
        words = list({w for c in counts.values() for w in c})
        # lattices of words of like length, so that short words don't carry the tables of long ones
        parts = [(model.lattice(group), np.array([[counts[g].get(w, 0) for g in langs] for w in group], float)) for group in _by_length(sorted(words))]
        size = np.array([len(p) for p in pieces] + [1.0])
        prob = np.repeat((0.02**size / (0.02**size).sum())[:, None], len(langs), 1)
        for _ in range(rounds):
            prob[-1] = UNKNOWN
            got = np.zeros(prob.shape)
            for lattice, weight in parts:
                got += lattice.expected(prob, weight)
            got[-1] = 0
            got += smoothing
            prob = got / got.sum(0)
        prob[-1] = UNKNOWN
        model.prob = prob
        return model

    def word_rows(self, words: list[str]) -> np.ndarray:
        """Log probabilities of words; remembers CACHE_WORDS of them."""
        self._open()
        new = [w for w in dict.fromkeys(words) if w not in self.slot]
        if len(self.slot) + len(new) > CACHE_WORDS:
            self.slot, self.rows, new = {}, self.rows[:0], list(dict.fromkeys(words))
        parts = [self.rows]
        for group in _by_length(new):
            for w in group:
                self.slot[w] = len(self.slot)
            parts.append(self.lattice(group).log_prob(self.prob))
        self.rows = np.concatenate(parts)
        return self.rows[np.fromiter((self.slot[w] for w in words), np.int64, len(words))]

    def predict(self, texts: list[str]) -> list[tuple[str, float]]:
        self._open()
        if not self.langs:
            return [("und", 0.0)] * len(texts)
        words = [words_of(t) for t in texts]
        rows = self.word_rows([w for x in words for w in x])
        out, at = [], 0
        for x in words:
            if not x:
                out.append(("und", 0.0))
                continue
            score = rows[at : at + len(x)].sum(0)
            at += len(x)
            share = np.exp(score - score.max())
            best = int(np.argmax(score))
            out.append((self.langs[best], float(share[best] / share.sum())))
        return out


def _by_length(words: list[str]) -> Iterator[list[str]]:
    """Groups of words whose alpha tables stay small."""
    group: list[str] = []
    for w in sorted(words, key=len):
        if group and (len(group) + 1) * (len(w) + 2) > 60_000:
            yield group
            group = []
        group.append(w)
    if group:
        yield group


def fit_language_model(df: DataFrame, pieces: list[str], id_col: str = "doc_id", text: str = "text", lang: str = "lang", sample_docs: int = SAMPLE_DOCS, max_langs: int = MAX_LANGS) -> UnigramModel:
    """Learn from a sample of ``df``, all of whose rows may be learned from."""
    rows = df.where(F.col(lang).isNotNull())
    totals = {r[0]: r[1] for r in rows.groupBy(lang).count().limit(max_langs + 1).collect()}
    if len(totals) > max_langs:
        raise ValueError(f"more than {max_langs} languages")
    # a hash of id and text is even over [0, 1), so a language gives about sample_docs rows, also where rows share an id or have none
    share: Column = F.lit(0.0)
    for name, n in totals.items():
        share = F.when(F.col(lang) == name, F.lit(min(1.0, sample_docs / n))).otherwise(share)
    draw = F.pmod(F.xxhash64(F.col(id_col), F.col(text), F.lit("langid")), F.lit(1 << 30)) / float(1 << 30)
    counts: dict[str, Counter] = {name: Counter() for name in totals}
    for r in rows.where(draw < share).select(lang, text).toLocalIterator():
        counts[r[0]].update(words_of(r[1] or ""))
    return UnigramModel.fit(counts, pieces)


def predict_language(df: DataFrame, model: UnigramModel, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, lang_pred, score) of every row."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    kind = dict(df.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, text, 1_000_000):
            found = shared.value.predict(texts)
            yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], [id_col, "lang_pred", "score"])

    return df.select(id_col, text).mapInArrow(run, f"`{id_col}` {kind}, lang_pred string, score double")
