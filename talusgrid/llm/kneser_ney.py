"""An interpolated modified Kneser-Ney n-gram model over the words of a corpus.

Counting runs in Spark on packed arrays: tasks combine the n-grams of a few million tokens,
deal them out by hash to shards, and each shard's task writes its part of the model as sorted
hash arrays to the shared folder, then deals out what the next lower order needs. Workers that
score memory-map those arrays and look n-grams up in hash order, a large batch at a time, so
that a shard is read front to back.

Texts are padded with ORDER - 1 starts and one end. The highest order has plain counts; a lower
one counts the distinct words that precede an n-gram. N-grams of three words and more are dealt
by the hash of their history, so that what follows a history meets in one task (at most one row
for each distinct word); pairs, whose histories are single words and may be hot, by their own.

Files of a model, all below one path of the shared folder, each of several arrays, by shard:
    word/<shard>     sorted 64-bit word hashes, training counts
    stat/<shard>     by word id: total, followers seen once, twice, more often as a history;
                     distinct words before it
    gram<n>/<shard>  n-grams: the starts of buckets by the upper half of their hash, the lower
                     halves in order, counts
    hist<n>/<shard>  histories of n - 1 words that were seen more than once: as above, with
                     total and followers seen once, twice, more often
A word's id is its rank among all word hashes; ids V and V+1 are the end and the start of a
text. Counts are bytes, with the few larger ones apart. A history that was seen once isn't in
its file: its one follower was seen once. An n-gram is taken for another with a chance of
about 2e-9 for each look-up (32 bits inside a bucket of about 8).
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talusgrid.llm import kernels as K
from talusgrid.llm import runtime as R

#: Words of the longest n-grams.
ORDER = 3
#: Tokens that a counting task combines before it deals their counts out, and that are scored at once.
BLOCK_TOKENS, SCORE_TOKENS = 2_000_000, 750_000
#: Bytes of input for each shard of the model, which a task holds some ten times over.
SHARD_BYTES = 32 << 20
#: N-grams for each bucket of a shard's file.
BUCKET = 8
_PACKED = "shard int, kind int, data binary"
_STATS = ("total", "one", "two", "more", "before")
#: Kinds of rows: n-grams of n words by n, parts of the words' statistics, counts of counts of n-grams, and texts.
_STAT, _SUMS, _TEXTS = 1000, 2000, 3000
_U = np.uint64


def _pack(*arrays: np.ndarray) -> bytes:
    """Byte planes of unsigned numbers, as many as the largest needs, compressed; the first array must be sorted."""
    out = []
    for i, x in enumerate(arrays):
        x = np.diff(x, prepend=_U(0)) if i == 0 else x
        x = np.ascontiguousarray(x, dtype="<u8")
        width = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1
        data = zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes())
        out += [bytes([width]), len(data).to_bytes(8, "little"), data]
    return b"".join(out)


def _unpack(data: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(data):
        width, size = data[at], int.from_bytes(data[at + 1 : at + 9], "little")
        planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[at + 9 : at + 9 + size]), dtype=np.uint8).reshape(width, -1)
        x = np.zeros((planes.shape[1], 8), dtype=np.uint8)
        x[:, :width] = planes.T
        x = x.view("<u8").reshape(-1)
        out.append(x if out else np.cumsum(x, dtype=_U))
        at += 9 + size
    return out


def _runs(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values start in a sorted array."""
    return np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1]))) if len(x) else np.zeros(0, np.int64)


def _sums(weights: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.add.reduceat(weights, at) if len(at) else np.zeros(0, weights.dtype)


def _counted(x: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values and their counts, or sums of weights."""
    if weights is None:
        x = np.sort(x)
        at = _runs(x)
        return x[at], np.diff(np.append(at, len(x))).astype(_U)
    order = np.argsort(x)
    x, weights = x[order], weights[order]
    at = _runs(x)
    return x[at], _sums(weights, at)


def _starts(shards: int) -> np.ndarray:
    """The first upper half of a hash of each shard, a range of them, and the end."""
    return np.asarray([-(-(s << 32) // shards) for s in range(shards)] + [1 << 32], dtype=_U)


def _shards_of(sorted_hashes: np.ndarray, shards: int) -> np.ndarray:
    """Edges of each shard's run among sorted hashes."""
    return np.searchsorted(sorted_hashes >> _U(32), _starts(shards))


def _hash(ids: list[np.ndarray]) -> np.ndarray:
    """The hash of an n-gram of word ids, built up from that of its history."""
    out = _first_hash(ids[0])
    for x in ids[1:]:
        out = _next_hash(out, _first_hash(x))
    return out


def _first_hash(ids: np.ndarray) -> np.ndarray:
    return K.mix64(ids.astype(_U) + _U(0x9E3779B97F4A7C15))


def _next_hash(history: np.ndarray, word: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return K.mix64(history * _U(0xD6E8FEB86659FD93) + word)


def _shard_key(ids: list[np.ndarray]) -> np.ndarray:
    """What n-grams are dealt by: the hash of the history, or of a pair itself."""
    return _hash(ids[: max(2, len(ids) - 1)])


def _rows(rows: list[tuple[int, int, bytes]]) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(rows), 256):
        shard, kind, data = zip(*rows[i : i + 256], strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), pa.array(kind, pa.int32()), pa.array(data, pa.binary())], names=["shard", "kind", "data"])


def _by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, dict[int, list[bytes]]]]:
    """The parts of one shard after another, by kind; rows come sorted by shard."""
    for table in R.grouped(batches, "shard"):
        parts: dict[int, list[bytes]] = {}
        for kind, data in zip(table.column("kind").to_pylist(), table.column("data").to_pylist(), strict=True):
            parts.setdefault(kind, []).append(data)
        yield table.column("shard")[0].as_py(), parts


def _token_blocks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[np.ndarray, np.ndarray, list[pa.RecordBatch]]]:
    """Word hashes, numbers of words by text, and the rows, for about ``most`` tokens at a time."""
    words, lengths, rows, held = [], [], [], 0
    for whole in batches:
        for batch in R.slices(whole):
            w, offsets = K.word_hashes(*K.text_bytes(batch.column("text")))
            words.append(w)
            lengths.append(np.diff(offsets))
            rows.append(batch)
            held += len(w) + len(offsets)
            if held >= most:
                yield np.concatenate(words), np.concatenate(lengths), rows
                words, lengths, rows, held = [], [], [], 0
    if words:
        yield np.concatenate(words), np.concatenate(lengths), rows


def _padded(ids: np.ndarray, lengths: np.ndarray, order: int, end: int, start: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts with order - 1 starts before and an end after each, and the positions of words and ends."""
    sizes = lengths + order
    last = np.cumsum(sizes) - 1
    out = np.full(int(sizes.sum()), start, dtype=np.int64)
    real = np.ones(len(out), dtype=bool)
    for k in range(order - 1):
        real[last - lengths - 1 - k] = False
    where = np.flatnonzero(real)
    inside = real.copy()
    inside[last] = False
    out[inside] = ids
    out[last] = end
    return out, where


# -- words ------------------------------------------------------------------------------------


def _count_words(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words, lengths, _ in _token_blocks(batches, BLOCK_TOKENS):
            h, n = _counted(words)
            cut = _shards_of(h, shards)
            rows = [(s, 1, _pack(h[a:b], n[a:b])) for s, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if b > a]
            yield from _rows([*rows, (0, _TEXTS, len(lengths).to_bytes(8, "little"))])

    return run


def _write_words(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, parts in _by_shard(batches):
            got = [_unpack(x) for x in parts.get(1, [])]
            h, n = _counted(np.concatenate([x[0] for x in got]), np.concatenate([x[1] for x in got])) if got else (np.zeros(0, _U), np.zeros(0, _U))
            _put(f"{path}/word/{shard}", {"hash": h} | _count_sections("count", n))
            texts = sum(int.from_bytes(x, "little") for x in parts.get(_TEXTS, []))
            yield pa.RecordBatch.from_pylist([{"shard": shard, "size": len(h), "total": int(n.sum()), "texts": texts}], schema=pa.schema([("shard", pa.int32()), ("size", pa.int64()), ("total", pa.int64()), ("texts", pa.int64())]))

    return run


# -- files ------------------------------------------------------------------------------------


def _count_sections(name: str, n: np.ndarray) -> dict[str, np.ndarray]:
    """Numbers as bytes; those of 255 and more apart, after their positions."""
    big = np.flatnonzero(n >= 255)
    return {name: np.minimum(n, _U(255)).astype(np.uint8), f"{name}.big": np.concatenate([big.astype(_U), n[big].astype(_U)])}


def _put(path: str, sections: dict[str, np.ndarray]) -> None:
    """One file of named arrays: the length of a header, the header, and each array at a multiple of 8."""
    listed, at = [], 0
    for name, x in sections.items():
        listed.append((name, x.dtype.str, at, len(x)))
        at += -(-x.nbytes // 8) * 8
    head = json.dumps(listed).encode()
    head += b" " * (-len(head) % 8)
    body = b"".join(x.tobytes() + bytes(-x.nbytes % 8) for x in sections.values())
    R.put_file(path, len(head).to_bytes(8, "little") + head + body)


def _put_table(path: str, h: np.ndarray, columns: dict[str, np.ndarray]) -> None:
    """Distinct hashes, and columns of counts in their order."""
    buckets = max(1, len(h) // BUCKET)
    bucket = ((h >> _U(32)) * _U(buckets)) >> _U(32)
    order = np.argsort((bucket << _U(32)) | (h & _U(0xFFFFFFFF)))
    sections = {"at": np.searchsorted(bucket[order], np.arange(buckets + 1, dtype=_U)).astype(np.uint32), "low": (h[order] & _U(0xFFFFFFFF)).astype(np.uint32)}
    for name, n in columns.items():
        sections |= _count_sections(name, n[order])
    _put(path, sections)


_MAPPED: dict[str, dict[str, np.ndarray]] = {}
#: Files that a worker maps at once.
_MOST_MAPPED = 8000


def _mapped(path: str) -> dict[str, np.ndarray]:
    """The arrays of a file."""
    if path not in _MAPPED:
        if len(_MAPPED) >= _MOST_MAPPED:
            _MAPPED.clear()
        data = R.map_file(path, np.uint8)
        size = int.from_bytes(data[:8].tobytes(), "little")
        _MAPPED[path] = {name: data[8 + size + at : 8 + size + at + n * np.dtype(kind).itemsize].view(kind) for name, kind, at, n in json.loads(data[8 : 8 + size].tobytes())}
    return _MAPPED[path]


def _counts_at(sections: dict[str, np.ndarray], name: str, at: np.ndarray) -> np.ndarray:
    """Numbers at positions of a column; a position below 0 has none."""
    small = sections[name]
    if not len(small):
        return np.zeros(len(at))
    out = np.where(at >= 0, small[at], 0).astype(np.float64)
    if (full := np.flatnonzero(out == 255)).size:
        big = sections[f"{name}.big"]
        where, values = big[: len(big) // 2], big[len(big) // 2 :]
        out[full] = values[np.searchsorted(where, at[full].astype(_U))]
    return out


def _positions(sections: dict[str, np.ndarray], h: np.ndarray) -> np.ndarray:
    """Positions of hashes in a table, -1 where they aren't there."""
    low, at = sections["low"], sections["at"]
    if not len(low):
        return np.full(len(h), -1, np.int64)
    bucket = (((h >> _U(32)) * _U(len(at) - 1)) >> _U(32)).astype(np.int64)
    want = (h & _U(0xFFFFFFFF)).astype(np.uint32)
    a, b = at[bucket].astype(np.int64), at[bucket + 1].astype(np.int64)
    end = b.copy()
    for _ in range(int((b - a).max(initial=0)).bit_length()):  # the first number not below the wanted one
        middle = (a + b) >> 1
        less = (a < b) & (low[np.minimum(middle, len(low) - 1)] < want)
        a, b = np.where(less, middle + 1, a), np.where(less, b, np.maximum(middle, a))
    there = (a < end) & (low[np.minimum(a, len(low) - 1)] == want)
    return np.where(there, a, -1)


@dataclass
class Model:
    """Where a model lies, its sizes by shard, and its discounts."""

    path: str
    shards: int
    order: int = ORDER
    base: list[int] = field(default_factory=list)  #: the first word id of each shard, and V
    tokens: int = 0
    texts: int = 0
    pairs: int = 0
    #: discounts of the orders from 1 on
    discounts: list[tuple[float, float, float]] = field(default_factory=list)
    root: tuple[float, float, float] = (0, 0, 0)  #: words with one, two and more words before them

    @property
    def words(self) -> int:
        return self.base[-1]

    def word_ids(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids (-1: not in training) and counts of sorted word hashes."""
        ids, counts = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes))
        cut = _shards_of(hashes, self.shards)
        for s, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
            if b > a and len(array := (sections := _mapped(f"{self.path}/word/{s}"))["hash"]):
                at = np.minimum(np.searchsorted(array, hashes[a:b]), len(array) - 1)
                at = np.where(array[at] == hashes[a:b], at, -1)
                ids[a:b] = np.where(at >= 0, at + self.base[s], -1)
                counts[a:b] = _counts_at(sections, "count", at)
        return ids, counts

    def stats(self, ids: np.ndarray) -> np.ndarray:
        """The _STATS of word ids (5 x ids); ids below 0 have none."""
        out = np.zeros((len(_STATS), len(ids)))
        shard = np.minimum(np.searchsorted(np.asarray(self.base), ids, side="right") - 1, self.shards - 1)
        order = np.argsort(shard, kind="stable")
        cut = np.searchsorted(shard[order], np.arange(self.shards + 1))
        for s, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
            who = order[a:b]
            if len(who := who[ids[who] >= 0]):
                sections = _mapped(f"{self.path}/stat/{s}")
                for k, name in enumerate(_STATS):
                    out[k, who] = _counts_at(sections, name, ids[who] - self.base[s])
        return out

    def look_up(self, kind: str, dealt: np.ndarray, h: np.ndarray, columns: tuple[str, ...]) -> np.ndarray:
        """Columns of hashes; ``dealt`` are the sorted hashes that they were dealt by."""
        out = np.zeros((len(columns), len(h)))
        cut = _shards_of(dealt, self.shards)
        for s, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
            if b > a:
                sections = _mapped(f"{self.path}/{kind}/{s}")
                at = _positions(sections, h[a:b])
                for k, name in enumerate(columns):
                    out[k, a:b] = _counts_at(sections, name, at)
        return out

    def discounted(self, order: int, n: np.ndarray) -> np.ndarray:
        """Counts less their discounts."""
        d = self.discounts[order - 1]
        return np.maximum(n - np.select([n >= 3, n == 2, n == 1], [d[2], d[1], d[0]], 0.0), 0)

    def first_order(self, before: np.ndarray) -> np.ndarray:
        """Probability of words with so many distinct words before them, interpolated with 1 / (V + 2) for any word."""
        uniform = 1.0 / (self.words + 2)
        if not self.pairs:
            return np.full(len(before), uniform)
        rest = sum(x * n for x, n in zip(self.discounts[0], self.root, strict=True)) / self.pairs
        return self.discounted(1, before) / self.pairs + rest * uniform

    def interpolated(self, order: int, count: np.ndarray, history: np.ndarray, low: np.ndarray) -> np.ndarray:
        """Probability by an order, of counts, the four numbers of their histories, and the probability by the order below."""
        total, one, two, more = history
        d = self.discounts[order - 1]
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(total > 0, (self.discounted(order, count) + (d[0] * one + d[1] * two + d[2] * more) * low) / total, low)

    def log_probabilities(self, ids: np.ndarray, of: np.ndarray, where: np.ndarray) -> np.ndarray:
        """log10 of the probability of the padded positions ``where``; the word of each position is ids[of]."""
        stats = self.stats(ids)
        word = _first_hash(ids)[of]
        p, history = self.first_order(stats[4])[of], stats[:4][:, of]
        before, by = word, None
        for n in range(2, self.order + 1):
            gram = np.concatenate(([_U(0)], _next_hash(before[:-1], word[1:])))
            count = np.zeros(len(gram))
            if n == 2:
                by = np.argsort(gram)
                count[by] = self._sorted(f"gram{n}", gram[by], ("n",))[0]
            else:  # dealt by the history, which ends one position before
                at = by[by + 1 < len(gram)]
                count[at + 1] = self.look_up(f"gram{n}", before[at], gram[at + 1], ("n",))[0]
            p = np.concatenate((p[:1], self.interpolated(n, count[1:], history[:, :-1], p[1:])))
            if n < self.order:
                by = by if n == 2 else np.argsort(gram)
                once = (count > 0).astype(np.float64)
                history = np.zeros((4, len(gram)))
                history[:, by] = self._sorted(f"hist{n + 1}", gram[by], _STATS[:4])
                seen = history[0] > 0
                history[0], history[1] = np.where(seen, history[0], once), np.where(seen, history[1], once)
                before = gram
        return np.log10(p[where])

    def _sorted(self, kind: str, h: np.ndarray, columns: tuple[str, ...]) -> np.ndarray:
        """Columns of sorted hashes that are dealt by themselves, each distinct one looked up once."""
        new = _runs(h)
        return np.repeat(self.look_up(kind, h[new], h[new], columns), np.diff(np.append(new, len(h))), axis=1)


# -- n-grams ----------------------------------------------------------------------------------


def _discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """The modified Kneser-Ney discounts of counts of counts; plain halves where one of them is 0."""
    if not (n1 and n2 and n3):
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    return tuple(min(max(k - (k + 1) * y * b / a, 0.05), k - 0.05) for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4)))


def _dealt(ids: list[np.ndarray], n: np.ndarray, shards: int) -> Iterator[pa.RecordBatch]:
    """Rows of n-grams by shard, which come sorted by their words."""
    shard = (np.searchsorted(_starts(shards), _shard_key(ids) >> _U(32), side="right") - 1).astype(np.int32)
    order = np.argsort(shard, kind="stable")
    cut = np.searchsorted(shard[order], np.arange(shards + 1))
    yield from _rows([(s, len(ids), _pack(*(x[order[a:b]] for x in ids), n[order[a:b]])) for s, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if b > a])


def _distinct(ids: list[np.ndarray], words: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct n-grams in the order of their first words, and how often each is there."""
    bits = max(int(words + 2).bit_length(), 1)
    if bits * len(ids) <= 64:  # the words themselves are the key
        key = ids[0].astype(_U)
        for x in ids[1:]:
            key = (key << _U(bits)) | x.astype(_U)
        key, n = _counted(key)
        out = []
        for _ in ids:
            out.append(key & _U((1 << bits) - 1))
            key = key >> _U(bits)
        return out[::-1], n
    h = _hash(ids)
    order = np.argsort(h)
    at = _runs(h[order])
    n = np.diff(np.append(at, len(h))).astype(_U)
    first = order[at]
    by = np.argsort(ids[0][first], kind="stable")
    return [x[first[by]].astype(_U) for x in ids], n[by]


def _count_grams(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words, lengths, _ in _token_blocks(batches, BLOCK_TOKENS):
            distinct, inverse = np.unique(words, return_inverse=True)
            v = len(distinct)  # words go by their ranks in the block, whose order is that of their ids
            of, where = _padded(inverse, lengths, model.order, v, v + 1)
            ids = np.concatenate((model.word_ids(distinct)[0], [model.words, model.words + 1])).astype(_U)
            del words, inverse
            grams, n = _distinct([of[where - k] for k in range(model.order - 1, -1, -1)], v)
            yield from _dealt([ids[x.astype(np.int64)] for x in grams], n, model.shards)

    return run


def _write_grams(model: Model, order: int):
    """Write each shard of n-grams and of what their histories have, and deal out what the order below needs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, parts in _by_shard(batches):
            sums = sum((np.frombuffer(x, dtype=np.int64) for x in parts.pop(_SUMS, [])), np.zeros((model.order + 1) * 5, np.int64)).reshape(-1, 5)
            got = [_unpack(x) for x in parts.pop(order, [])] or [[np.zeros(0, _U)] * (order + 1)]
            columns = []
            for k in range(order + 1):
                columns.append(np.concatenate([x[k] for x in got]))
                for x in got:
                    x[k] = None
            h = _hash(columns[:-1])
            by = np.argsort(h)
            at = _runs(h[by])
            n = _sums(columns[-1][by], at)
            first = by[at]
            h, ids = h[first], [x[first] for x in columns[:-1]]
            del columns, by, at, first, got
            _put_table(f"{model.path}/gram{order}/{shard}", h, {"n": n})
            sums[order] += np.asarray([(n == _U(k)).sum() for k in (1, 2, 3, 4)] + [len(n)])
            if order > 2:
                _write_histories(model, order, shard, ids, n)
                below, before = _distinct(ids[1:], model.words)
                yield from _dealt(below, before, model.shards)
                yield from _rows([(shard, _SUMS, sums.tobytes())])
            else:
                yield from _word_parts(model, ids, n)
                yield from _rows([(shard, _SUMS, sums.tobytes())])

    return run


def _write_histories(model: Model, order: int, shard: int, ids: list[np.ndarray], n: np.ndarray) -> None:
    h = _hash(ids[:-1])
    by = np.argsort(h)
    at = _runs(h[by])
    n = n[by]
    table = {"total": _sums(n, at), "one": _sums((n == 1).astype(_U), at), "two": _sums((n == 2).astype(_U), at), "more": _sums((n > 2).astype(_U), at)}
    first = by[at]
    kept = (table["total"] > 1) | (ids[-2][first] == model.words + 1)
    _put_table(f"{model.path}/hist{order}/{shard}", h[first[kept]], {name: x[kept] for name, x in table.items()})


def _word_parts(model: Model, ids: list[np.ndarray], n: np.ndarray) -> Iterator[pa.RecordBatch]:
    """What words have as histories of pairs and as their second words, by shard of the word."""
    base = np.asarray(model.base, dtype=_U)
    base[-1] += _U(2)
    data = [b""] * model.shards
    for who, weights in ((ids[0], n), (ids[0][n == 1], None), (ids[0][n == 2], None), (ids[0][n > 2], None), (ids[1], None)):
        words, sums = _counted(who, weights)
        cut = np.searchsorted(words, base)
        cut[0], cut[-1] = 0, len(words)
        for s, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
            part = _pack(words[a:b], sums[a:b]) if b > a else b""
            data[s] += len(part).to_bytes(8, "little") + part
    yield from _rows([(s, _STAT, x) for s, x in enumerate(data) if len(x) > 8 * len(_STATS)])


def _write_stats(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, parts in _by_shard(batches):
            first = model.base[shard]
            size = model.base[shard + 1] - first + 2 * (shard == model.shards - 1)
            sums = sum((np.frombuffer(x, dtype=np.int64) for x in parts.get(_SUMS, [])), np.zeros((model.order + 1) * 5, np.int64)).reshape(-1, 5)
            columns = np.zeros((len(_STATS), size), dtype=_U)
            for data in parts.get(_STAT, []):
                at = 0
                for column in columns:
                    length, at = int.from_bytes(data[at : at + 8], "little"), at + 8
                    if length:
                        ids, n = _unpack(data[at : at + length])
                        column[ids.astype(np.int64) - first] += n
                    at += length
            sections = {}
            for name, column in zip(_STATS, columns, strict=True):
                sections |= _count_sections(name, column)
            _put(f"{model.path}/stat/{shard}", sections)
            sums[1] = [(column == k).sum() for k in (1, 2, 3, 4)] + [(column > 0).sum()]
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([sums.reshape(-1).tolist()], pa.list_(pa.int64()))], names=["shard", "sums"])

    return run


def _shards_for(texts: DataFrame) -> int:
    """A shard for SHARD_BYTES of the input files, and for each shuffle partition at least."""
    leaves = texts._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    return max(R.partitions(texts.sparkSession), -(-size // SHARD_BYTES) if size < 1 << 60 else 1)  # an unknown size is given as 2^63


def train(texts: DataFrame, shards: int | None = None, order: int = ORDER) -> Model:
    """Count the model of all rows of texts (text) and write it to the shared folder.

    Null texts count as empty. A text without words has its end as its only token. An empty
    table gives a model that scores every token alike. Repeated rows count as often as they are
    there; other columns are ignored. Unset, ``shards`` grows with the bytes of the input files.
    """
    if order < 2:
        raise ValueError("an order of 2 at least")
    spark = texts.sparkSession
    texts = R.columns(texts, "text").select("text")
    shards = shards or _shards_for(texts)
    path = R.new_path(spark, "ngrams")
    every = spark.range(shards).select(F.col("id").cast("int").alias("shard"), F.lit(0).alias("kind"), F.lit(b"").alias("data"))

    def by_shard(df: DataFrame) -> DataFrame:
        return df.unionByName(every).repartition(shards, "shard").sortWithinPartitions("shard")

    rows = {r.shard: r for r in R.arrow_map(by_shard(R.arrow_map(texts, _count_words(shards), _PACKED)), _write_words(path), "shard int, size long, total long, texts long").collect()}
    sizes = [rows[s].size for s in range(shards)]
    base = np.concatenate(([0], np.cumsum(sizes))).tolist()
    n_texts = sum(r.texts for r in rows.values())
    model = Model(path, shards, order, base, sum(r.total for r in rows.values()) + n_texts, n_texts)
    grams = R.arrow_map(texts, _count_grams(model), _PACKED)
    for n in range(order, 1, -1):
        grams = R.arrow_map(by_shard(grams), _write_grams(model, n), _PACKED)
    sums = np.sum([r.sums for r in R.arrow_map(by_shard(grams), _write_stats(model), "shard int, sums array<long>").collect()], axis=0).reshape(-1, 5).tolist()
    model.pairs = sums[2][4]
    model.discounts = [_discounts(*sums[n][:4]) for n in range(1, order + 1)]
    model.root = (sums[1][0], sums[1][1], sums[1][4] - sums[1][0] - sums[1][1])
    return model


# -- scores -----------------------------------------------------------------------------------


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = model.words + (model.texts > 0)
        for words, lengths, rows in _token_blocks(batches, SCORE_TOKENS):
            distinct, inverse = np.unique(words, return_inverse=True)
            v = len(distinct)
            ids, counts = model.word_ids(distinct)
            ids, counts = np.concatenate((ids, [model.words, model.words + 1])), np.append(counts, model.texts)
            of, where = _padded(inverse, lengths, model.order, v, v + 1)
            row = np.repeat(np.arange(len(lengths)), lengths + 1)
            count = counts[of[where]]
            base = np.log10((count + 1) / (model.tokens + vocabulary + 1))
            p = model.log_probabilities(ids, of, where)
            sums = [np.bincount(row, weights=x, minlength=len(lengths)) for x in (count > 0, base, p)]
            at = 0
            for batch in rows:
                here = slice(at, at := at + batch.num_rows)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i) for i in range(batch.num_columns - 1)), pa.array(lengths[here] + 1, pa.int64()), pa.array(sums[0][here].astype(np.int64)), pa.array(np.full(batch.num_rows, model.tokens), pa.int64()), pa.array(sums[1][here]), pa.array(sums[2][here])],
                    names=[*batch.schema.names[:-1], "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    return run


def score(texts: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of each row with n_tokens, n_known, train_tokens, base_score and score.

    ``score`` is the model's log10 probability of the text and its end; ``base_score`` is that
    of add-one smoothed single words. ``10 ** (-score / n_tokens)`` is the perplexity. Null
    texts count as empty: their end is their only token. Repeated rows, and nulls in other
    columns, are kept as they are; an empty table gives no rows; an unknown word has the
    probability that is left for any word.
    """
    rows = R.columns(texts, *keep, "text").select(*keep, "text")
    schema = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes[:-1])
    return R.arrow_map(rows, _score(model), f"{schema}, n_tokens long, n_known long, train_tokens long, base_score double, score double")
