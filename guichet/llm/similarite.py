"""Similar records without pairwise comparison: parity-sketch join.

A record is the set of its words. Words hash to bits of a sketch that flips a bit per word (parity),
so the Hamming distance of two sketches is at most the symmetric difference of the two sets. A
similarity threshold bounds that difference for every pair of set sizes, which gives

* the pigeonhole: in one order of all words (rare first) the first words that two similar sets share
  stand among the first ones of each, how many depends on both sizes. Words have ``colours`` colours;
  of (depth - 1) * colours + 1 shared words, ``depth`` have the same one. Records meet in the cell of
  the first of these, and within a large cell only where the next ones are equal too;
* the filter: what meets is compared by size, position and sketch, vectorised;
* the check: what is left is verified on the word sets themselves.

The cells are those of word hashes, not of blocks of a sketch: a pigeonhole over blocks of
equal width needs one block more than bits may differ (28 to 45 here), and a block then holds about
two words. The README has the figures of both. Nothing is approximated: every pair at or above the
threshold is found, once. Word hashes keep 40 bits; only a collision within one pair's own words could
matter. Equal sets are one class, numbered by 64 bits of their digest: among n different sets two
share a number, and count as one, with a chance of n * n / 3.7e19 (0.03 % at a hundred million).
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from guichet.session import cut

WORD = re.compile(r"[^\W_]{4,}")
_MARKS = regex.compile(r"\p{M}+")
WIDTH = 5  # bytes of a word hash
BUCKET_BITS = 18  # word frequencies are counted in 2**18 hash buckets: a fixed 2 MB, however large the vocabulary
#: A cell beyond so many records is split by the next words of its records; one of ``depth`` words, into blocks that meet pairwise in tasks of their own.
CELL = 400_000
FEW = 32  # groups of at most so many records are compared, larger ones split by the next word first
MANY = 2_000  # groups beyond so many records are compared block by block
HELD = 1 << 17  # rows a task gathers before it compares them
#: A class of more records than this is joined in pieces of about this size.
PIECE = 50_000
PAIRS = 1_000_000  # found pairs a task holds before it drops repeated ones and sends the rest
SKETCH = ("s1", "s2", "s3")
_STEP = 512  # rows of one vectorised comparison
_EPS = 1e-9


def words_of(*texts: str | None) -> set[str]:
    """Unbroken runs of at least four letters or digits, decomposed, lower case, without marks."""
    s = " \n ".join(t for t in texts if t)
    if not s.isascii():
        s = _MARKS.sub("", unicodedata.normalize("NFD", s))
    return set(WORD.findall(s.lower()))


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 1_000_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word) >> (64 - 8 * WIDTH)
        return h


def pack(hashes: np.ndarray) -> bytes:
    return hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :WIDTH].tobytes()


def unpack(blob: bytes) -> np.ndarray:
    raw = np.frombuffer(blob, np.uint8).reshape(-1, WIDTH)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :WIDTH] = raw
    return out.view("<u8").ravel()


def word_sets(df: DataFrame, key: str, texts: list[str], least: int) -> DataFrame:
    """``id, classe, mots``: packed sorted word hashes of each row with at least ``least`` different words.

    Null texts are empty. Equal sets have the same ``classe``, whatever their ids.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _Hashes()
        for batch in batches:
            ids, classes, blobs = [], [], []
            columns = [c.to_pylist() for c in batch.columns]
            for i, *parts in zip(*columns):
                words = words_of(*parts)
                if len(words) < least or i is None:
                    continue
                h = np.unique(np.fromiter(map(table.__getitem__, words), np.uint64, len(words)))
                blob = pack(h)
                ids.append(i)
                blobs.append(blob)
                classes.append(xxhash.xxh3_64_intdigest(blob) - (1 << 63))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(classes, pa.int64()), pa.array(blobs, pa.binary())], ["id", "classe", "mots"])

    return df.select(F.col(key).cast("long").alias("id"), *texts).mapInArrow(run, "id long, classe long, mots binary")


def _flat(blobs: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all hashes, number of each row)."""
    lengths = np.array([len(b) // WIDTH for b in blobs.to_pylist()], np.int64)
    data = b"".join(blobs.to_pylist())
    return (unpack(data) if data else np.zeros(0, np.uint64)), lengths


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h & np.uint64((1 << BUCKET_BITS) - 1)).astype(np.int64)


def _sum_buckets(counts: DataFrame) -> np.ndarray:
    """Bucket counts as one array of fixed length."""
    out = np.zeros(1 << BUCKET_BITS, np.int64)
    for b, n in counts.groupBy("b").agg(F.sum("n")).repartition(1).toLocalIterator():
        out[b] = n
    return out


def _unseen(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, pa.Array]]:
    """(classe, mots) of the batches, each class once per task."""
    seen: set[int] = set()
    for batch in batches:
        classes = batch.column(0).to_pylist()
        keep = []
        for k, c in enumerate(classes):
            if c not in seen:
                seen.add(c)
                keep.append(k)
        if keep:
            at = pa.array(keep, pa.int64())
            yield np.array([classes[k] for k in keep], np.int64), batch.column(1).take(at)


class Bounds:
    """What a Jaccard threshold t says about two sets of a and b words, each of at least ``least``.

    ``depth`` of the first ``shared`` common words have one of ``colours`` colours.
    """

    def __init__(self, threshold: float, least: int = 1):
        self.t, self.k = threshold, threshold / (1 + threshold)
        common = int(self.overlap(max(least, 1), max(least, 1)))  # of any pair
        self.depth = next((d for d in (4, 3, 2) if (common - 1) // (d - 1) >= 3), 1)
        self.colours = min(6, (common - 1) // (self.depth - 1)) if self.depth > 1 else 1
        self.shared = (self.depth - 1) * self.colours + 1
        #: Words of a set that may be common ones before the first of the ``depth``, besides those the partner lacks.
        self.before = self.shared - self.depth

    def overlap(self, a, b):
        return np.ceil(self.k * (a + b) - _EPS)

    def prefix(self, a):
        """Words of a set that can matter for any partner: a - ceil(t * a) + 1."""
        return (a - np.ceil(self.t * a - _EPS) + 1).astype(np.int64)


def _prefixes(h: np.ndarray, lengths: np.ndarray, freq: np.ndarray, bounds: Bounds) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash, position, end) of the words of every row that may be among the first ``shared`` common ones, by row, colour and rarity; words met once are left out.

    ``end`` is where the words of the same row and colour end.
    """
    row = np.repeat(np.arange(len(lengths)), lengths)
    f = freq[_bucket(h)]
    order = np.lexsort((h, f, row))
    h, f = h[order], f[order]
    start = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    position = np.arange(len(h)) - np.repeat(start, lengths)
    keep = (position < np.repeat(bounds.prefix(lengths) + bounds.shared - 1, lengths)) & (f > 1)
    row, h, position = row[keep], h[keep], position[keep]
    # Neighbours in the order of rarity, such as the words of one phrase, get different colours.
    run = row * bounds.colours + _ranks(freq)[_bucket(h)] % bounds.colours
    order = np.lexsort((position, run))
    run = run[order]
    return row[order], h[order], position[order], np.searchsorted(run, run, "right")


_RANKED: list[tuple[np.ndarray, np.ndarray]] = []


def _ranks(freq: np.ndarray) -> np.ndarray:
    """Rank of each bucket by frequency, kept for the last array asked for."""
    if not _RANKED or _RANKED[0][0] is not freq:
        rank = np.empty(len(freq), np.int64)
        rank[np.argsort(freq, kind="stable")] = np.arange(len(freq))
        _RANKED[:] = [(freq, rank)]
    return _RANKED[0][1]


def _spread(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the range, element) of all elements of the ranges begin..end."""
    n = np.maximum(end - begin, 0)
    at = np.repeat(np.arange(len(n)), n)
    return at, np.arange(len(at)) + (begin - (np.cumsum(n) - n))[at]


def _joined(key: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Keys of words added to keys."""
    x = (key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ word
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(32))).view(np.int64)


def _placed(h: np.ndarray, end: np.ndarray, hot: list[np.ndarray], bounds: Bounds) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(level, first, key, next, cells) of the keys of ``level`` words: index of the first word, key, index after the last one.

    ``hot``: of each level that is known, how many cells of ``CELL`` records the bucket of a key would need; keys
    beyond one go on to the next level. ``cells`` is more than 1 at the last level only.
    """
    first = np.nonzero(end - np.arange(len(h)) >= bounds.depth)[0]
    key, after = h[first].astype(np.int64), first + 1
    for level in range(1, bounds.depth + 1):
        cells = np.maximum(hot[level - 1][_bucket(key.view(np.uint64))], 1) if level <= len(hot) else np.ones(len(key), np.int64)
        last = level == bounds.depth or level > len(hot)
        stay = np.ones(len(key), bool) if last else cells == 1
        yield level, first[stay], key[stay], after[stay], cells[stay]
        if last:
            return
        first, key, after = first[~stay], key[~stay], after[~stay]
        at, j = _spread(after, end[first] - (bounds.depth - level - 1))
        first, key, after = first[at], _joined(key[at], h[j]), j + 1


def _sketches(h: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """192 parity bits per row as three words."""
    row = np.repeat(np.arange(len(lengths)), lengths)
    bit = (h >> np.uint64(BUCKET_BITS)) % np.uint64(64 * len(SKETCH))
    out = np.zeros((len(lengths), len(SKETCH)), np.uint64)
    np.bitwise_xor.at(out, (row, (bit >> np.uint64(6)).astype(np.int64)), np.uint64(1) << (bit & np.uint64(63)))
    return out


def cell_rows(sets: DataFrame, bounds: Bounds) -> DataFrame:
    """``cle, bloc, cote, classe, n, pos, s1..s3, suite``: each class in the cells of its prefix words.

    ``suite``: 16 bits of each later word of the same colour. Cells that would hold more than ``CELL``
    records are split by those words; where ``depth`` words are used up they are cut into g blocks: a
    record goes to the g cells (its block, any block), on the side of its block, so that every two
    records still meet once.
    """
    spark = sets.sparkSession

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << BUCKET_BITS, np.int64)
        for _, blobs in _unseen(batches):
            total += np.bincount(_bucket(_flat(blobs)[0]), minlength=1 << BUCKET_BITS)
        at = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["b", "n"])

    source = sets.select("classe", "mots")
    freq = spark.sparkContext.broadcast(_sum_buckets(source.mapInArrow(count_words, "b int, n long")))

    def counted(known):
        def count_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(1 << BUCKET_BITS, np.int64)
            for _, blobs in _unseen(batches):
                _, h, _, end = _prefixes(*_flat(blobs), freq.value, bounds)
                for level, _, key, _, _ in _placed(h, end, known.value, bounds):
                    if level > len(known.value):
                        total += np.bincount(_bucket(key.view(np.uint64)), minlength=1 << BUCKET_BITS)
            at = np.nonzero(total)[0]
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["b", "n"])

        return count_cells

    levels: list[np.ndarray] = []
    while len(levels) < bounds.depth and (not levels or levels[-1].max() > 1):
        levels.append(-(-_sum_buckets(source.mapInArrow(counted(spark.sparkContext.broadcast(list(levels))), "b int, n long")) // CELL))
    hot = spark.sparkContext.broadcast(levels)
    schema = pa.schema([("cle", pa.int64()), ("bloc", pa.int64()), ("cote", pa.int32()), ("classe", pa.int64()), ("n", pa.int32()), ("pos", pa.int32()), *((k, pa.int64()) for k in SKETCH), ("suite", pa.binary())])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for classes, blobs in _unseen(batches):
            words, lengths = _flat(blobs)
            sketch = _sketches(words, lengths)
            row, h, pos, end = _prefixes(words, lengths, freq.value, bounds)
            short = ((h >> np.uint64(22)) & np.uint64(0xFFFF)).astype("<u2")
            for level, first, key, after, cells in _placed(h, end, hot.value, bounds):
                own = (classes[row[first]].view(np.uint64) >> np.uint64(7)).astype(np.int64) % cells
                every, other = _spread(np.zeros_like(cells), cells)
                for i in range(0, len(every), 1 << 16):
                    at, o = every[i : i + (1 << 16)], other[i : i + (1 << 16)]
                    mine, f = own[at], first[at]
                    low, high = np.minimum(mine, o), np.maximum(mine, o)
                    r = row[f]
                    stop = end[f] if level < bounds.depth else after[at]
                    offsets = np.concatenate([[0], np.cumsum(2 * (stop - after[at]))]).astype(np.int32)
                    later = short[_spread(after[at], stop)[1]]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(key[at]), pa.array((level << 60) + (low << 30) + high), pa.array(np.where(low == high, 0, np.where(mine == low, 1, 2)).astype(np.int32)),
                            pa.array(classes[r]), pa.array(lengths[r].astype(np.int32)), pa.array(pos[f].astype(np.int32)),
                            *(pa.array(np.ascontiguousarray(sketch[r, k]).view(np.int64)) for k in range(len(SKETCH))),
                            pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(later)]),
                        ],
                        schema=schema,
                    )

    return source.mapInArrow(emit, "cle long, bloc long, cote int, classe long, n int, pos int, " + ", ".join(f"{k} long" for k in SKETCH) + ", suite binary")


class _Cells:
    """Rows of whole cells, copies sent by several tasks dropped, and what of them passes size, position and sketch."""

    def __init__(self, parts: list[tuple[list[np.ndarray], np.ndarray, np.ndarray]], bounds: Bounds):
        cle, bloc, side, classe, n, pos, *sketch = (np.concatenate(c) for c in zip(*(p[0] for p in parts)))
        many = np.concatenate([p[1] for p in parts])
        self.words = np.concatenate([p[2] for p in parts]).astype(np.int64)
        change = np.ones(len(cle), bool)
        change[1:] = (cle[1:] != cle[:-1]) | (bloc[1:] != bloc[:-1])
        cell = np.cumsum(change) - 1
        order = np.lexsort((classe, cell))
        new = np.ones(len(order), bool)
        new[1:] = (classe[order][1:] != classe[order][:-1]) | (cell[order][1:] != cell[order][:-1])
        at = order[new]
        self.bounds, self.cell, self.level, self.side, self.classe = bounds, cell[at], bloc[at] >> 60, side[at], classe[at]
        self.end = np.cumsum(many)[at]
        self.begin = self.end - many[at]
        self.n, self.pos = n[at].astype(np.int32), pos[at].astype(np.int32)
        self.sketch = [s[at].view(np.uint64) for s in sketch]
        self.share = ((1 - 2 * bounds.k) * self.n).astype(np.float32) + np.float32(0.01)  # of the words that may differ
        self.split = bool(self.side.any())
        self.met = 0  # row pairs compared so far

    def checked(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Class pairs of the row pairs that pass the exact bounds."""
        n, pos, before = self.n, self.pos, self.bounds.before
        o = self.bounds.overlap(n[x].astype(np.int64), n[y].astype(np.int64))
        good = (pos[x] <= n[x] - o + before) & (pos[y] <= n[y] - o + before) & (self.classe[x] != self.classe[y]) & (np.minimum(n[x], n[y]) >= o)
        if self.split:
            good &= (self.side[x] == 0) | (self.side[x] != self.side[y])
        x, y, o = x[good], y[good], o[good]
        d = sum(np.bitwise_count(s[x] ^ s[y]).astype(np.int64) for s in self.sketch)
        good = d <= n[x].astype(np.int64) + n[y] - 2 * o
        a, b = self.classe[x[good]], self.classe[y[good]]
        return np.minimum(a, b), np.maximum(a, b)

    def windows(self, rows: np.ndarray, end: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Each place of ``rows`` with those after it, up to its ``end``."""
        (f1, f2, f3), share = (s[rows] for s in self.sketch), self.share[rows]
        place = np.arange(len(rows))
        total = np.cumsum(end - place - 1)
        i = 0
        while i < len(rows):
            j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + (1 << 19), "right")))
            at, y = _spread(place[i:j] + 1, end[i:j])
            x = at + i
            self.met += len(x)
            d = np.bitwise_count(f1[x] ^ f1[y]) + np.bitwise_count(f2[x] ^ f2[y]) + np.bitwise_count(f3[x] ^ f3[y])
            good = np.nonzero(d <= share[x] + share[y])[0]
            yield self.checked(rows[x[good]], rows[y[good]])
            i = j

    def large(self, rows: np.ndarray, end: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The same for one large group, block by block."""
        (f1, f2, f3), share = (s[rows] for s in self.sketch), self.share[rows]
        for i in range(0, len(rows), _STEP):
            k = min(i + _STEP, len(rows))
            for j in range(i, int(end[k - 1]), 4096):
                m = min(j + 4096, int(end[k - 1]))
                self.met += (k - i) * (m - j)
                d = sum(np.bitwise_count(f[i:k, None] ^ f[None, j:m]) for f in (f1, f2, f3))
                x, y = np.nonzero(d <= np.uint8(min(255, share[k - 1] + share[m - 1])))  # by size: the last ones may differ most
                x, y = x + i, y + j
                good = y > x
                yield self.checked(rows[x[good]], rows[y[good]])

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Class pairs; groups of more than ``FEW`` rows are split by one more word as long as pairs must share one."""
        bounds = self.bounds
        for level in np.unique(self.level):
            rows = np.nonzero(self.level == level)[0]
            group, begin = self.cell[rows], self.begin[rows]
            for depth in range(int(level), bounds.depth + 1):
                size = np.minimum(self.n[rows], 65_535).astype(np.int64)
                order = np.argsort((group << 16) | size)
                rows, group, begin, size = rows[order], group[order], begin[order], size[order]
                new = np.ones(len(rows), bool)
                new[1:] = group[1:] != group[:-1]
                start = np.nonzero(new)[0]
                many = np.diff(np.append(start, len(rows)))
                number = np.cumsum(new) - 1
                # Partners are no smaller, and not larger than the threshold allows.
                most = np.minimum((size / bounds.t + _EPS).astype(np.int64), 65_535)
                end = np.searchsorted((number << 16) | size, (number << 16) | most, "right")
                last = depth == bounds.depth
                direct = (many > 1) & ((many <= FEW) | last & (many <= MANY))
                keep = direct[number]
                if keep.any():
                    to = np.cumsum(keep)
                    yield from self.windows(rows[keep], to[end[keep] - 1])
                if last:
                    for g in np.nonzero(many > MANY)[0]:
                        s = slice(start[g], start[g] + many[g])
                        yield from self.large(rows[s], end[s] - start[g])
                    break
                keep = (many > FEW)[number]
                rows, number, begin = rows[keep], number[keep], begin[keep]
                at, j = _spread(begin, self.end[rows] - (bounds.depth - depth - 1))
                if not len(at):
                    break
                # Numbered anew, so that a group, a word and a size fit into one integer.
                word = (number[at] << 16) | self.words[j]
                rows, begin = rows[at], j + 1
                group = np.unique(word, return_inverse=True)[1]


def candidates(cells: DataFrame, bounds: Bounds) -> DataFrame:
    """``a, b`` (distinct class pairs, a < b) of all cells, group by group over sorted partitions."""

    def different(pairs: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        a, b = np.concatenate([x for x, _ in pairs]), np.concatenate([y for _, y in pairs])
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        first = np.ones(len(a), bool)
        first[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        return pa.RecordBatch.from_arrays([pa.array(a[first]), pa.array(b[first])], ["a", "b"])

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The pairs of a task, each once per ``PAIRS`` found."""
        waiting, n = [], 0
        for cells in whole(batches):
            for pair in cells.pairs():
                if len(pair[0]):
                    waiting.append(pair)
                    n += len(pair[0])
                    if n > PAIRS:
                        yield different(waiting)
                        waiting, n = [], 0
        if waiting:
            yield different(waiting)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[_Cells]:
        held, n = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns[:-1]]
            suite = batch.column(batch.num_columns - 1)
            offsets = np.frombuffer(suite.buffers()[1], np.int32)[suite.offset : suite.offset + len(suite) + 1]
            words = np.frombuffer(suite.buffers()[2], "<u2", (offsets[-1] - offsets[0]) // 2, offsets[0]) if offsets[-1] > offsets[0] else np.zeros(0, "<u2")
            many = np.diff(offsets) // 2
            change = np.nonzero((columns[0][1:] != columns[0][:-1]) | (columns[1][1:] != columns[1][:-1]))[0] + 1
            before = held and (held[-1][0][0][-1], held[-1][0][1][-1]) != (columns[0][0], columns[1][0])
            to = int(change[-1]) if len(change) else 0  # where the batch's last cell begins
            if n + to >= HELD and (to or before):
                w = int(many[:to].sum())
                if to:
                    held.append(([c[:to] for c in columns], many[:to], words[:w]))
                yield _Cells(held, bounds)
                held, n = [], 0
                columns, many, words = [c[to:] for c in columns], many[to:], words[w:]
            held.append((columns, many, words))
            n += len(many)
        if held:
            yield _Cells(held, bounds)

    placed = cells.repartition("cle", "bloc").sortWithinPartitions("cle", "bloc")
    # Placed by a, as the next join wants them: the distinct needs no shuffle of its own.
    return placed.mapInArrow(gathered, "a long, b long").repartition("a").distinct()


def verified(pairs: DataFrame, sets: DataFrame, bounds: Bounds) -> DataFrame:
    """``a, b, communs, total`` of the class pairs whose words in common reach the threshold."""
    words = sets.select("classe", "mots").groupBy("classe").agg(F.first("mots").alias("mots"))
    one = words.withColumnsRenamed({"classe": "a", "mots": "mots_a"})
    two = words.withColumnsRenamed({"classe": "b", "mots": "mots_b"})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, nx = _flat(batch.column(2))
            y, ny = _flat(batch.column(3))
            # Words of a pair: row number above the hash, so one sort finds the common ones of the whole batch.
            rx, ry = np.repeat(np.arange(len(nx)), nx), np.repeat(np.arange(len(ny)), ny)
            mark = np.concatenate([(rx.astype(np.uint64) << np.uint64(40)) | x, (ry.astype(np.uint64) << np.uint64(40)) | y])
            mark.sort()
            twice = mark[1:][mark[1:] == mark[:-1]]
            common = np.bincount((twice >> np.uint64(40)).astype(np.int64), minlength=len(nx))
            good = common >= bounds.overlap(nx, ny)
            at = pa.array(np.nonzero(good)[0])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(common[good].astype(np.int32)), pa.array((nx + ny - common)[good].astype(np.int32))], ["a", "b", "communs", "total"])

    both = pairs.join(one, "a").join(two, "b").select("a", "b", "mots_a", "mots_b")
    return both.mapInArrow(run, "a long, b long, communs int, total int")


def linked_classes(df: DataFrame, key: str, texts: list[str], least: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(members, links): ``id, classe`` of every record with enough words, and ``a, b, communs, total`` between classes.

    ``least``: different words a record needs; ``threshold``: Jaccard similarity, reached or exceeded.
    Rows of one id with equal texts are one record. Both results are written tables; empty input
    gives empty ones. Extra columns of ``df`` are never read.
    """
    bounds = Bounds(threshold, least)
    sets = cut(word_sets(df, key, texts, least), "mots")
    links = cut(verified(candidates(cell_rows(sets, bounds), bounds), sets, bounds), "liens")
    return sets.select("id", "classe").distinct(), links


def _pieces(members: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(``id, classe, piece``, ``classe, pieces`` of the classes of several pieces or None)."""
    big = members.groupBy("classe").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > PIECE)
    big = cut(big.select("classe", F.ceil(F.col("_n") / PIECE).cast("int").alias("pieces")), "grandes")
    if big.isEmpty():
        return members.withColumn("piece", F.lit(0)), None
    placed = members.join(big, "classe", "left")
    return placed.select("id", "classe", F.pmod(F.xxhash64("id"), F.coalesce("pieces", F.lit(1))).cast("int").alias("piece")), big


def expand_pairs(members: DataFrame, links: DataFrame) -> DataFrame:
    """``id_a, id_b`` (id_a < id_b): all pairs of different records, of linked classes or of the same class.

    Every pair is a wanted row; classes of many copies are cut into pieces, so that no join key holds
    more than about ``PIECE`` rows of a side.
    """
    placed, big = _pieces(members)
    left = placed.select(F.col("id").alias("ia"), F.col("classe").alias("a"), F.col("piece").alias("pa"))
    right = placed.select(F.col("id").alias("ib"), F.col("classe").alias("b"), F.col("piece").alias("pb"))
    met = links.select("a", "b").withColumns({"pa": F.lit(0), "pb": F.lit(0)})
    several = members.groupBy("classe").count().where(F.col("count") > 1).select(F.col("classe").alias("a"))
    own = several.select("a", F.lit(0).alias("pa"), F.lit(0).alias("pb"))
    if big is not None:
        numbers = lambda c: F.explode(F.sequence(F.lit(0), F.coalesce(F.col(c), F.lit(1)) - 1))
        for side, piece in (("a", "pa"), ("b", "pb")):
            met = met.drop(piece).join(big.withColumnRenamed("classe", side), side, "left").withColumn(piece, numbers("pieces")).drop("pieces")
        own = several.join(big.withColumnRenamed("classe", "a"), "a", "left").withColumn("pa", numbers("pieces")).withColumn("pb", numbers("pieces")).drop("pieces").where(F.col("pa") <= F.col("pb"))
    across = met.join(left, ["a", "pa"]).join(right, ["b", "pb"]).where(F.col("ia") != F.col("ib")).select(F.least("ia", "ib").alias("id_a"), F.greatest("ia", "ib").alias("id_b"))
    # Two pieces meet once, a piece with itself in one order of ids.
    within = own.join(left, ["a", "pa"]).join(right.withColumnRenamed("b", "a"), ["a", "pb"]).where(F.when(F.col("pa") == F.col("pb"), F.col("ia") < F.col("ib")).otherwise(True))
    return across.unionByName(within.select(F.least("ia", "ib").alias("id_a"), F.greatest("ia", "ib").alias("id_b")))
