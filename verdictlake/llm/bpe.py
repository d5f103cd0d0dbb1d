"""Byte-level BPE encoding and decoding in batched numpy merge rounds.

Texts of one Arrow batch become one code-point array. The pre-tokenizer is a
handful of vectorised passes over character classes. A word of up to seven
characters below U+0100 is its own 64-bit key. Other words meet by a 64-bit hash,
and words of one hash are compared by their characters, within a batch and with
the remembered word, before they count as equal. Words not seen before are
merged together: their symbols lie in one flat array, and every round merges the
lowest-ranked adjacent pair of each word, ranks being found by binary search
over the sorted pair keys of the vocabulary. Results equal those of the tokenizers library for a byte-level
vocabulary in which every merge makes a token of its own.

Edge cases: a null text counts as empty and gives no ids; an empty table gives
an empty result; repeated rows give repeated results; a very long text is never cut and
is a slice of its own; other columns pass
through, and a clash with an output column is an error raised before the job.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import require_free, slices

OTHER, LETTER, NUMBER, SPACE, BREAK = range(5)
NONE = np.int32(2**31 - 1)
SLICE_CHARS = 2_000_000
CACHE_WORDS, CACHE_CHARS = 1_000_000, 8_000_000


@lru_cache(1)
def char_classes() -> np.ndarray:
    table = np.zeros(0x110000, np.uint8)
    every = "".join(map(chr, (c for c in range(0x110000) if not 0xD800 <= c < 0xE000)))
    for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\p{White_Space}+", SPACE)):
        for m in regex.finditer(pattern, every):
            first, last = ord(m.group()[0]), ord(m.group()[-1])
            table[first : last + 1] = kind
    return table


def split_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code points, word starts plus the end, words before each text plus the total).

    One BREAK character follows each text and is a word of its own."""
    cp = np.frombuffer(("\0".join(texts) + "\0").encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1) - 1
    kind = char_classes()[cp]
    kind[ends] = BREAK
    start = np.empty(len(cp) + 1, bool)
    start[0] = start[-1] = True
    np.not_equal(kind[1:], kind[:-1], out=start[1:-1])
    start[ends] = True  # empty texts: break after break
    start[ends + 1] = True
    # the last of several white-space characters before a word stands apart; a plain space joins the word
    last = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] < SPACE))
    start[last] = True
    start[last[cp[last] == 0x20] + 1] = False
    quote = np.flatnonzero((cp[:-1] == 0x27) & start[:-2] & (kind[1:] == LETTER))
    if len(quote):
        one, two = cp[quote + 1], cp[np.minimum(quote + 2, len(cp) - 1)]
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((two == ord("e")) & ((one == ord("r")) | (one == ord("v")))) | ((one == ord("l")) & (two == ord("l")))
        start[quote[short | long] + 1] = False
        start[quote[short] + 2] = True
        start[quote[long & ~short] + 3] = True
    starts = np.flatnonzero(start)
    return cp, starts, np.concatenate([[0], np.searchsorted(starts, ends) + 1])


_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(cp: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """64-bit polynomial hashes of the words, with each character mixed first."""
    lens = np.diff(starts)
    v = cp.astype(np.uint64)
    v += np.uint64(0x632BE59BD9B4E019)
    v *= np.uint64(0xBF58476D1CE4E5B9)
    v ^= v >> np.uint64(29)
    v *= np.uint64(0x94D049BB133111EB)
    rel = np.arange(len(cp), dtype=np.int64)
    rel -= np.repeat(starts[:-1], lens)
    powers = np.full(int(lens.max(initial=1)), _MULTIPLIER, np.uint64)
    powers[0] = 1
    v *= np.multiply.accumulate(powers)[rel]
    h = np.add.reduceat(v, starts[:-1])
    h ^= h >> np.uint64(31)
    return h * _MULTIPLIER + lens.astype(np.uint64)


_SHIFTS = np.minimum(np.arange(9) * 8, 56).astype(np.uint64)
_HASHED = np.uint64(1 << 63)


def word_keys(cp: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys, whether a key is the word itself): short words packed by byte under their length, other words hashed with the top bit set."""
    lens = np.diff(starts)
    rel = np.arange(len(cp), dtype=np.int32)
    rel -= np.repeat(starts[:-1].astype(np.int32), lens)
    np.minimum(rel, 8, out=rel)
    keys = np.add.reduceat(cp.astype(np.uint64) << _SHIFTS[rel], starts[:-1]) | (lens.astype(np.uint64) << np.uint64(56))
    exact = (lens <= 7) & (np.maximum.reduceat(cp, starts[:-1]) < 256)
    other = np.flatnonzero(~exact)
    if len(other):
        size = lens[other]
        ends = np.cumsum(size)
        chars = cp[np.arange(ends[-1]) + np.repeat(starts[other] - ends + size, size)]
        keys[other] = word_hashes(chars, np.concatenate([[0], ends])) | _HASHED
    return keys, exact


class Merges:
    """The vocabulary's byte symbols and merges, as sorted arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(printable)]
        chars = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}
        self.byte_id = np.zeros(256, np.int32)
        for c, b in chars.items():
            self.byte_id[b] = vocab[c]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        left, right, made = (np.array([vocab[x] for x in xs], np.int64) for xs in ([a for a, _ in pairs], [b for _, b in pairs], [a + b for a, b in pairs]))
        if len(np.unique(made)) != len(made):
            raise ValueError("a token with two merges needs sequential merging")
        self.shift = 1 << int(max(vocab.values())).bit_length()
        order = np.argsort(left * self.shift + right)
        self.keys = (left * self.shift + right)[order]
        self.ranks, self.made = order.astype(np.int32), made[order].astype(np.int32)
        self.by_rank = made.astype(np.int32)
        pieces: dict[int, bytes] = {i: bytes(chars[c] for c in t) for t, i in vocab.items() if all(c in chars for c in t)}
        pieces |= {i: t.encode() for t, i in self.special.items()}
        self.n_ids = max(pieces) + 1
        each = [pieces.get(i, b"") for i in range(self.n_ids)]
        self.piece_start = np.concatenate([[0], np.cumsum([len(p) for p in each])])
        self.piece_bytes = np.frombuffer(b"".join(each), np.uint8)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) * self.shift + right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    def merge(self, data: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words given as one byte array and their lengths: (flat ids, ids per word)."""
        word = np.repeat(np.arange(len(lens), dtype=np.int64), lens)
        sym = self.byte_id[data]
        rank = np.full(len(sym), NONE, np.int32)
        inner = np.flatnonzero(word[1:] == word[:-1])
        rank[inner] = self.rank(sym[inner], sym[inner + 1])
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(sym):
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            size = np.diff(np.concatenate([first, [len(sym)]]))
            low = np.repeat(np.minimum.reduceat(rank, first), size)
            over = low == NONE
            if over.any():
                done.append((word[over], sym[over]))
                keep = ~over
                word, sym, rank, low = word[keep], sym[keep], rank[keep], low[keep]
                if not len(sym):
                    break
            at = np.flatnonzero(rank == low)
            if len(at) > 1 and (np.diff(at) == 1).any():
                # of overlapping equal pairs (a a a) every second one merges, from the left
                fresh = np.concatenate([[True], np.diff(at) != 1])
                run = np.flatnonzero(fresh)
                within = np.arange(len(at)) - np.repeat(run, np.diff(np.concatenate([run, [len(at)]])))
                at = at[within % 2 == 0]
            sym[at] = self.by_rank[rank[at]]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            at -= np.arange(len(at))
            word, sym, rank = word[keep], sym[keep], rank[keep]
            touched = np.unique(np.concatenate([at, at[at > 0] - 1]))
            rank[touched] = NONE
            touched = touched[touched < len(sym) - 1]
            touched = touched[word[touched] == word[touched + 1]]
            rank[touched] = self.rank(sym[touched], sym[touched + 1])
        if not done:
            return np.zeros(0, np.int32), np.zeros(len(lens), np.int64)
        words, ids = np.concatenate([w for w, _ in done]), np.concatenate([s for _, s in done])
        return ids[np.argsort(words, kind="stable")], np.bincount(words, minlength=len(lens))

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes behind the ids."""
        if not len(ids):
            return b""
        start, size = self.piece_start[ids], (self.piece_start[1:] - self.piece_start[:-1])[ids]
        out = np.cumsum(size)
        return self.piece_bytes[np.arange(out[-1]) + np.repeat(start - out + size, size)].tobytes()


@lru_cache(4)
def load_merges(path: str) -> Merges:
    return Merges(path)


def utf8(cp: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words as code points to UTF-8 bytes and their lengths."""
    width = 1 + (cp > 0x7F).astype(np.int64) + (cp > 0x7FF) + (cp > 0xFFFF)
    ends = np.concatenate([[0], np.cumsum(width)])
    at = np.concatenate([[0], np.cumsum(lens)])
    return np.frombuffer(cp.tobytes().decode("utf-32-le").encode(), np.uint8), ends[at[1:]] - ends[at[:-1]]


def same_words(cp: np.ndarray, starts: np.ndarray, mine: np.ndarray, other: np.ndarray, other_starts: np.ndarray, theirs: np.ndarray) -> np.ndarray:
    """Whether the words ``mine`` of one table of code points equal the words ``theirs`` of another, one by one."""
    size = starts[mine + 1] - starts[mine]
    same = size == other_starts[theirs + 1] - other_starts[theirs]
    at = np.flatnonzero(same)
    if len(at):
        size = size[at]
        ends = np.cumsum(size)
        step = np.arange(ends[-1]) - np.repeat(ends - size, size)
        differs = cp[np.repeat(starts[mine[at]], size) + step] != other[np.repeat(other_starts[theirs[at]], size) + step]
        same[at] = ~np.logical_or.reduceat(differs, ends - size)
    return same


class Encoder:
    """Encodes lists of texts; remembers at most ``cache_words`` distinct words between calls.

    ``encode_words(code points, lengths) -> (flat ids, ids per word)`` does the words not seen before."""

    def __init__(self, special: dict[str, int], encode_words: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]], cache_words: int = CACHE_WORDS, cache_chars: int = CACHE_CHARS):
        self.special, self.encode_words, self.cache_words, self.cache_chars = special, encode_words, cache_words, cache_chars
        self.parts = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(special, key=len, reverse=True)) + ")") if special else None
        self.forget()

    def forget(self) -> None:
        self.hashes, self.slot = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.ids, self.at = np.zeros(0, np.int32), np.zeros(1, np.int64)
        self.chars, self.char_at = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(flat int32 ids, ids before each text plus the total)."""
        if self.parts is not None and any(s in t for s in self.special for t in texts):
            return self._with_special(texts)
        return self._plain(texts)

    def _with_special(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        split = [self.parts.split(t) for t in texts]
        ids, at = self._plain([p for parts in split for p in parts[::2]])
        out, counts, k = [], [], 0
        for parts in split:
            n = 0
            for j, p in enumerate(parts):
                if j % 2:
                    out.append(np.array([self.special[p]], np.int32))
                else:
                    out.append(ids[at[k] : at[k + 1]])
                    k += 1
                n += len(out[-1])
            counts.append(n)
        return np.concatenate(out), np.concatenate([[0], np.cumsum(counts)])

    def _plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        cp, starts, at = split_words(texts)
        slot = self._slots(cp, starts, *word_keys(cp, starts))
        begin, size = self.at[slot], self.at[slot + 1] - self.at[slot]
        size[at[1:] - 1] = 0  # the breaks
        out = np.cumsum(size)
        ids = self.ids[np.arange(out[-1]) + np.repeat(begin - out + size, size)]
        return ids, np.concatenate([[0], out[at[1:] - 1]])

    def _slots(self, cp: np.ndarray, starts: np.ndarray, keys: np.ndarray, exact: np.ndarray) -> np.ndarray:
        """The place of every word's ids; words that only share a hash with another get one of their own."""
        words, first, which = np.unique(keys, return_index=True, return_inverse=True)
        if len(self.at) + len(words) > self.cache_words or len(self.chars) + int((starts[first + 1] - starts[first]).sum()) > self.cache_chars:
            self.forget()
        place = np.searchsorted(self.hashes, words)
        known = np.zeros(len(words), bool)
        inside = place < len(self.hashes)
        known[inside] = self.hashes[place[inside]] == words[inside]
        odd = np.zeros(len(words), bool)
        old = np.flatnonzero(known & ~exact[first])
        odd[old] = ~same_words(cp, starts, first[old], self.chars, self.char_at, self.slot[place[old]])
        # words of a batch that aren't the first of their hash are compared with it
        odd = odd[which]
        again = np.flatnonzero(~exact)
        again = again[first[which[again]] != again]
        odd[again] |= ~same_words(cp, starts, again, cp, starts, first[which[again]])
        new = np.flatnonzero(~known)
        base = self._learn(cp, starts, first[new])
        self.hashes = np.insert(self.hashes, place[new], words[new])
        self.slot = np.insert(self.slot, place[new], base + np.arange(len(new)))
        slot = self.slot[np.searchsorted(self.hashes, words)][which]
        strange = np.flatnonzero(odd)
        slot[strange] = self._learn(cp, starts, strange) + np.arange(len(strange))
        return slot

    def _learn(self, cp: np.ndarray, starts: np.ndarray, words: np.ndarray) -> int:
        """Encode and remember the words; the place of the first."""
        base = len(self.at) - 1
        if len(words):
            begin, size = starts[words], starts[words + 1] - starts[words]
            out = np.cumsum(size)
            chars = cp[np.arange(out[-1]) + np.repeat(begin - out + size, size)]
            ids, counts = self.encode_words(chars, size)
            self.ids = np.concatenate([self.ids, ids.astype(np.int32)])
            self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(counts)])
            self.chars = np.concatenate([self.chars, chars])
            self.char_at = np.concatenate([self.char_at, self.char_at[-1] + out])
        return base


def numpy_encoder(path: str) -> Encoder:
    m = load_merges(path)
    return Encoder(m.special, lambda cp, lens: m.merge(*utf8(cp, lens)))


_ENCODERS: dict[str, Encoder] = {}


def worker_encoder(path: str) -> Encoder:
    """One encoder in each Python worker; Spark keeps workers between tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = numpy_encoder(path)
    return _ENCODERS[path]


def bpe_encode(df: DataFrame, tokenizer: str, text: str = "text", ids: str = "ids", n_tokens: str = "n_tokens", decoded: str | None = None) -> DataFrame:
    """Add ``ids`` (binary: little-endian unsigned 32-bit integers) and ``n_tokens`` to every row.

    With ``decoded`` the ids are decoded again in the same pass into a column of that name.
    Special tokens written in a text are encoded as such. Null text: empty."""
    require_free(df, [ids, n_tokens, *([decoded] if decoded else [])])
    fields = [*df.schema.fields, T.StructField(ids, T.BinaryType()), T.StructField(n_tokens, T.LongType())]
    if decoded:
        fields.append(T.StructField(decoded, T.StringType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, merges = worker_encoder(tokenizer), load_merges(tokenizer)
        for batch, texts in slices(batches, text, SLICE_CHARS):
            flat, at = encoder.encode(texts)
            raw = flat.astype("<u4")
            columns = [*batch.columns, pa.array([raw[a:b].tobytes() for a, b in zip(at, at[1:])], pa.binary()), pa.array(np.diff(at), pa.int64())]
            names = [*batch.schema.names, ids, n_tokens]
            if decoded:
                columns.append(pa.array([merges.decode(raw[a:b]).decode("utf-8", "replace") for a, b in zip(at, at[1:])], pa.string()))
                names.append(decoded)
            yield pa.RecordBatch.from_arrays(columns, names)

    return df.mapInArrow(run, T.StructType(fields))


def bpe_decode(df: DataFrame, tokenizer: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Add the text behind a binary ``ids`` column (null: empty); bytes that are no UTF-8 become U+FFFD."""
    require_free(df, [decoded])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = load_merges(tokenizer)
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                texts = [merges.decode(np.frombuffer(x or b"", "<u4")).decode("utf-8", "replace") for x in part.column(ids).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], [*part.schema.names, decoded])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(decoded, T.StringType())]))
