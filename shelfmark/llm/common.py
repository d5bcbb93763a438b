"""Helpers that several operators of this folder share."""

from __future__ import annotations

import contextlib
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.shared import materialise, remove_folder, shared_folder

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
ARROW_ROWS = 2000
WHITE = "\\x20\\x09-\\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextlib.contextmanager
def _settings(spark: SparkSession):
    """Inside, the shuffle files of a step go as soon as its result is written, and Arrow batches are small."""
    before = {k: spark.conf.get(k) for k in (_CLEANUP, _ARROW_ROWS)}
    spark.conf.set(_CLEANUP, "true")
    if not 0 < int(before[_ARROW_ROWS]) <= ARROW_ROWS:
        spark.conf.set(_ARROW_ROWS, str(ARROW_ROWS))
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


_SCRATCH: list[str] = []


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Inside, the tables of `written` lie in a folder of their own that is removed at the end, but for those to `keep`."""
    folder = f"scratch-{uuid.uuid4().hex}"
    _SCRATCH.append(folder)
    try:
        yield
    finally:
        _SCRATCH.pop()
        remove_folder(spark, f"{shared_folder(spark)}/{folder}")


def written(df: DataFrame, name: str, keep: bool = False, compression: str = "snappy") -> DataFrame:
    """The step's result, written to the shared folder; its shuffle files are dropped."""
    with _settings(df.sparkSession):
        # The query execution is made anew here, so that it sees the settings.
        return materialise(df.select("*"), name if keep or not _SCRATCH else f"{_SCRATCH[-1]}/{name}", compression)


def bit_hash(*cols, bits: int = 31):
    """A hash of the columns as a number of so many bits, not negative."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 64 - bits)


# --- words of Arrow texts as numbers --------------------------------------------------------

_ODD = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0xD1342543DE82EF95)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_BYTES = (np.arange(256, dtype=np.uint64) + np.uint64(0x632BE59BD9B4E019)) * np.uint64(0xA0761D6478BD642F)
_BYTES ^= _BYTES >> np.uint64(29)
_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Scatter the bits of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_STEP = 1 << 18


def _powers(n: int, base: np.uint64) -> np.ndarray:
    out = np.full(n + 1, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP, _DOWN = _powers(_STEP, _BASE), _powers(_STEP, _BASE_INVERSE)


def plain_text(array) -> pa.Array:
    """A text column as one Arrow string array; null counts as empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    return array.cast(pa.large_string()).fill_null("")


def by_bytes(batches, column: str = "text", limit: int = 4 << 20):
    """Arrow batches cut to slices of about `limit` bytes of text and at most 2**15 rows, to bound memory."""
    for batch in batches:
        lengths = pc.binary_length(batch[column]).fill_null(0).to_numpy(zero_copy_only=False)
        total = np.cumsum(lengths.astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = total[at - 1] if at else 0
            stop = min(at + (1 << 15), max(at + 1, int(np.searchsorted(total, before + limit, "right"))))
            yield batch.slice(at, stop - at)
            at = stop


class Words:
    """The words of a batch of texts: hashes, byte ranges, and each text's first word.

    Words are runs of bytes other than white space (0x20, 0x09 to 0x0D), in UTF-8.  `hashes`
    has 64 bits a word; text i holds the words `starts[i]` to `starts[i + 1]`.
    """

    def __init__(self, texts, lower: bool = False):
        texts = plain_text(texts)
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = texts.buffers()[2]
        data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, np.uint8)
        data = data[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        if lower:
            data = _LOWER[data]
        self.data, self.offsets = data, offsets
        inside = _IS_WORD[data]
        starts = inside.copy()
        starts[1:] &= ~inside[:-1]
        borders = offsets[1:-1][offsets[1:-1] < len(data)]
        starts[borders] = inside[borders]
        ends = inside.copy()
        ends[:-1] &= ~inside[1:]
        before = borders[borders > 0] - 1
        ends[before] = inside[before]
        self.begin = np.flatnonzero(starts)
        self.end = np.flatnonzero(ends) + 1
        self.starts = np.searchsorted(self.begin, offsets)
        self.hashes = self._hash()

    def _hash(self) -> np.ndarray:
        out = np.empty(len(self.begin), dtype=np.uint64)
        first = 0
        while first < len(self.begin):
            last = max(first + 1, int(np.searchsorted(self.end, self.begin[first] + _STEP, "right")))
            lo, hi = int(self.begin[first]), int(self.end[last - 1])
            up, down = (_UP, _DOWN) if hi - lo <= _STEP else (_powers(hi - lo, _BASE), _DOWN)
            sums = np.empty(hi - lo + 1, dtype=np.uint64)
            sums[0] = 0
            np.cumsum(_BYTES[self.data[lo:hi]] * up[: hi - lo], out=sums[1:])
            b, e = self.begin[first:last] - lo, self.end[first:last] - lo
            values = (sums[e] - sums[b]) * down[b]  # above _STEP there is one word, at 0
            out[first:last] = mix(values + (e - b).astype(np.uint64) * _ODD)
            first = last
        return out

    def counts(self) -> np.ndarray:
        """How many words each text has."""
        return np.diff(self.starts)


def windows_hash(hashes: np.ndarray, length: int) -> np.ndarray:
    """A hash of every `length` hashes in a row; the same wherever they stand."""
    n = len(hashes) - length + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    factor = 0x9E3779B97F4A7C15
    for j in range(length):
        factor = (factor * 0xD1342543DE82EF95 + 0x632BE59BD9B4E019) % 2**64 | 1
        out += hashes[j : j + n] * np.uint64(factor)
    return mix(out)


# --- groups of rows that come one after the other ---------------------------------------------


def grouped(batches, keys: tuple[str, ...]):
    """The groups of sorted Arrow batches, each as one table; only one group is held beyond its batch."""
    rest = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        if rest is not None:
            rows = pa.concat_tables([rest, rows]).combine_chunks()
        if not rows.num_rows:
            continue
        values = [rows[k].to_numpy() for k in keys]
        new = np.logical_or.reduce([v[1:] != v[:-1] for v in values])
        borders = [0, *(np.flatnonzero(new) + 1).tolist()]
        for at, stop in zip(borders[:-1], borders[1:], strict=True):
            yield rows.slice(at, stop - at).combine_chunks()
        rest = rows.slice(borders[-1])
    if rest is not None and rest.num_rows:
        yield rest.combine_chunks()


def forest(n: int, p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star (root, leaf) per component of the links (p, q) among n nodes."""
    low = np.arange(n)
    while True:
        least = np.minimum(low[p], low[q])
        new = low.copy()
        np.minimum.at(new, p, least)
        np.minimum.at(new, q, least)
        new = new[new]
        if (new == low).all():
            moved = np.flatnonzero(low != np.arange(n))
            return low[moved], moved
        low = new
