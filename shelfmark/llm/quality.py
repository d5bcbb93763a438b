"""A quality classifier: random-indexing word vectors, pooled per document, under a two-layer network.

Words are runs of letters (ASCII ones and all bytes of other characters), of digits, or of one and the same other
character; case counts.  Each word has a row of ROWS by hash and, by the row's hash, an index vector of DIM
dimensions with MARKS entries of 1 or -1.  A row's context vector is the sum of the index vectors of the words at most
SPAN places before or behind any of its occurrences in any document; the number of occurrences goes with it.  Every
task sums the rows of its texts, and the sums of blocks of rows are added in two steps, salted first, so no task
reads more than a part of a block's sums.  What is shared with the tasks has ROWS x DIM entries, whatever the input.

A word's vector is its row's, less the mean over all occurrences and of length one.  A document's features are the mean and the
spread of its words' vectors, rare words weighing more, and the logarithm of its length; the whole text counts.  A network
with one hidden layer learns from at most `sample` labelled documents, chosen by a hash of doc_id, and takes a fifth of them to
fit a temperature, by which its outputs are divided to give probabilities.

A text that is null, empty or only white space has no words and still a score.  Of several labels of a doc_id the
highest counts, null labels do not; rows with null doc_id have none.  Without labels of both kinds every score is the
share of label 1, or a half.  An empty table gives an empty result; extra columns do no harm.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import Words, by_bytes, mix, plain_text, table, written
from .toxicity import fold

ROWS, DIM, MARKS, SPAN = 1 << 15, 64, 4, 2
BLOCKS = 64
SAMPLE = 20_000
HIDDEN = 32
_RARE = 1e-3

_KIND = np.arange(256) + 3
_KIND[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = 0
_KIND[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_KIND[48:58] = 2


class Runs(Words):
    """The words of a batch of texts: runs of bytes of one kind, in place of runs without white space."""

    def __init__(self, texts):
        texts = plain_text(texts)
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = texts.buffers()[2]
        data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, np.uint8)
        self.data, self.offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
        kind = _KIND[self.data]
        change = np.ones(len(kind) + 1, dtype=bool)
        change[1:-1] = kind[1:] != kind[:-1]
        change[self.offsets] = True
        borders = np.flatnonzero(change)
        words = kind[borders[:-1]] != 0
        self.begin, self.end = borders[:-1][words], borders[1:][words]
        self.starts = np.searchsorted(self.begin, self.offsets)
        self.hashes = self._hash()

    def rows(self) -> np.ndarray:
        return (self.hashes >> np.uint64(64 - (ROWS.bit_length() - 1))).astype(np.int64)

    def owners(self) -> np.ndarray:
        counts = self.counts()
        return np.repeat(np.arange(len(counts)), counts)


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """(place, sign) of the MARKS entries of every row's index vector."""
    seed = np.arange(ROWS * MARKS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0xD1342543DE82EF95)
    bits = mix(seed).reshape(ROWS, MARKS)
    return (bits % np.uint64(DIM)).astype(np.int64), np.where(bits >> np.uint64(63), 1.0, -1.0)


def add_contexts(sums: np.ndarray, runs: Runs, place: np.ndarray, sign: np.ndarray, step: int = 1 << 18) -> None:
    """Add the contexts of a batch's words to sums (ROWS x (DIM + 1)), the last column counting words."""
    rows, owner = runs.rows(), runs.owners()
    flat, width = sums.reshape(-1), sums.shape[1]
    for at in range(0, len(rows), step):
        # Pairs whose earlier word lies in this stretch.
        first = rows[at : at + step]
        np.add(flat, np.bincount(first * width + DIM, minlength=len(flat)), out=flat, casting="unsafe")
        cells, values = [], []
        for apart in range(1, SPAN + 1):
            second = rows[at + apart : at + step + apart]
            near = owner[at : at + len(second)] == owner[at + apart : at + apart + len(second)]
            a, b = first[: len(second)][near], second[near]
            for x, y in ((a, b), (b, a)):
                cells.append((x[:, None] * width + place[y]).ravel())
                values.append(sign[y].ravel())
        cells, values = np.concatenate(cells), np.concatenate(values)
        np.add(flat, np.bincount(cells, weights=values, minlength=len(flat)), out=flat, casting="unsafe")


def _added(parts: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Sums of the blocks (block, salt, sums) of equal keys; a task holds one block's sum at a time."""

    def run(batches):
        at, total = None, None
        for batch in batches:
            blocks, salts = batch["block"].to_pylist(), batch["salt"].to_pylist()
            for block, salt, raw in zip(blocks, salts, batch["sums"], strict=True):
                key = (block, salt) if "salt" in keys else (block, 0)
                # A task's own sums are short numbers, as it has less than 2**27 words; sums of tasks are long.
                values = np.frombuffer(raw.as_buffer(), dtype=np.int32 if "salt" in keys else np.int64)
                if key == at:
                    total += values
                    continue
                if at is not None:
                    yield _block(at, total)
                at, total = key, values.astype(np.int64)
        if at is not None:
            yield _block(at, total)

    return parts.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "block int, salt int, sums binary")


def _block(key: tuple[int, int], sums: np.ndarray) -> pa.RecordBatch:
    columns = [pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([sums.tobytes()], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["block", "salt", "sums"])


def _blocks(sums: np.ndarray, salt: int):
    for i, block in enumerate(sums.reshape(BLOCKS, -1)):
        yield _block((i, salt), block.astype(np.int32))


def context_sums(docs: DataFrame) -> np.ndarray:
    """The context vectors and counts of all rows, over every document: ROWS x (DIM + 1)."""

    def run(batches):
        place, sign = index_vectors()
        sums, salt = np.zeros((ROWS, DIM + 1), dtype=np.int64), None
        for batch in batches:
            if salt is None and batch.num_rows:
                salt = batch["salt"][0].as_py()
            for part in by_bytes([batch]):
                add_contexts(sums, Runs(part["text"]), place, sign)
            if sums[:, DIM].sum() >> 27:
                yield from _blocks(sums, salt)
                sums[:] = 0
        if salt is not None:
            yield from _blocks(sums, salt)

    spread = max(1, int(docs.rdd.getNumPartitions() ** 0.5))
    parts = docs.select("text", F.pmod(F.spark_partition_id(), F.lit(spread)).alias("salt"))
    parts = parts.mapInArrow(run, "block int, salt int, sums binary")
    added = written(_added(_added(parts, ("block", "salt")), ("block",)), "contexts")
    sums = np.zeros((BLOCKS, ROWS // BLOCKS * (DIM + 1)), dtype=np.int64)
    for r in added.select("block", "sums").collect():  # BLOCKS rows
        sums[r["block"]] = np.frombuffer(r["sums"], dtype=np.int64)
    return sums.reshape(ROWS, DIM + 1)


@dataclass
class WordVectors:
    """A unit vector for every row, and the weight of its words."""

    vectors: np.ndarray
    weights: np.ndarray

    @staticmethod
    def of(sums: np.ndarray) -> WordVectors:
        counts = sums[:, DIM].astype(float)
        contexts = sums[:, :DIM] / np.maximum(counts, 1)[:, None]
        share = counts / max(counts.sum(), 1)
        contexts = np.where(counts[:, None] > 0, contexts - share @ contexts, 0)
        length = np.sqrt((contexts**2).sum(axis=1, keepdims=True))
        return WordVectors((contexts / np.maximum(length, 1e-9)).astype(np.float32), (_RARE / (_RARE + share)).astype(np.float32))

    @cached_property
    def _terms(self) -> np.ndarray:
        """Of each row its weighted vector, the same squared, and its weight: what a document's features are sums of."""
        weights = self.weights[:, None]
        return np.hstack([weights * self.vectors, weights * self.vectors**2, weights])

    def pooled(self, texts) -> np.ndarray:
        """Features of every text: mean and spread of its words' vectors, and its length."""
        runs = Runs(texts)
        counts, rows = runs.counts(), runs.rows()
        out = np.zeros((len(counts), 2 * DIM + 1))
        some = np.flatnonzero(counts)
        for first, last, members in _stretches(runs.starts, some):
            begins = np.maximum(runs.starts[members] - first, 0)
            out[members] += np.add.reduceat(self._terms[rows[first:last]], begins, axis=0)
        out[some, : 2 * DIM] /= np.maximum(out[some, 2 * DIM :], 1e-9)
        out[some, DIM : 2 * DIM] = np.sqrt(np.maximum(out[some, DIM : 2 * DIM] - out[some, :DIM] ** 2, 0))
        out[:, 2 * DIM] = np.log1p(counts)
        return out


def _stretches(starts: np.ndarray, some: np.ndarray, step: int = 1 << 13):
    """(first, last, texts with words there) over all words, at most `step` at a time."""
    for first in range(0, int(starts[-1]), step):
        last = min(first + step, int(starts[-1]))
        lo = int(np.searchsorted(starts[some], first, "right")) - 1
        hi = int(np.searchsorted(starts[some], last, "left"))
        yield first, last, some[lo:hi]


@dataclass
class Network:
    """Scaled features through a hidden layer of rectified units to one output, divided by a temperature."""

    mean: np.ndarray
    scale: np.ndarray
    layers: list[np.ndarray]
    temperature: float = 1.0

    def outputs(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return np.maximum((x - self.mean) / self.scale @ w1 + b1, 0) @ w2 + b2

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.outputs(x) / self.temperature, -500, 500)))


def fit_network(x: np.ndarray, y: np.ndarray, hidden: int = HIDDEN, rounds: int = 40, batch: int = 256) -> Network:
    """A network for labels y of features x by Adam steps on four fifths; the temperature by the last fifth."""
    rnd = np.random.default_rng(17)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    order = rnd.permutation(len(y))
    apart = order[: len(y) // 5]
    # With few rows all serve both ends.
    learn = order[len(apart) :] if len(np.unique(y[order[len(apart) :]])) == 2 else order
    net = Network(mean, scale, [
        rnd.standard_normal((x.shape[1], hidden)) * np.sqrt(2 / x.shape[1]), np.zeros(hidden),
        rnd.standard_normal(hidden) * np.sqrt(1 / hidden), np.zeros(1),
    ])
    scaled = (x - mean) / scale
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in net.layers]
    step = 0
    for done in range(rounds):
        rate = 3e-3 * (1 - done / rounds)
        turn = rnd.permutation(learn)
        for at in range(0, len(turn), batch):
            rows = turn[at : at + batch]
            w1, b1, w2, b2 = net.layers
            inner = scaled[rows] @ w1 + b1
            active = np.maximum(inner, 0)
            wrong = (1 / (1 + np.exp(-np.clip(active @ w2 + b2, -30, 30))) - y[rows]) / len(rows)
            back = np.outer(wrong, w2) * (inner > 0)
            slopes = [scaled[rows].T @ back + 1e-4 * w1, back.sum(axis=0), active.T @ wrong + 1e-4 * w2, wrong.sum(keepdims=True)]
            step += 1
            for p, g, m in zip(net.layers, slopes, moments, strict=True):
                m[0] += 0.1 * (g - m[0])
                m[1] += 0.001 * (g * g - m[1])
                p -= rate * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.999**step)) + 1e-8)
    held = apart if len(apart) else order
    net.temperature = fit_temperature(net.outputs(x[held]), y[held])
    return net


def fit_temperature(z: np.ndarray, y: np.ndarray) -> float:
    """The temperature under which the labels are likeliest, from a grid of powers."""
    grid = 2.0 ** np.linspace(-2, 6, 161)
    signed = np.where(y > 0, z, -z)
    losses = [np.logaddexp(0, -signed / t).mean() for t in grid]
    return float(grid[int(np.argmin(losses))])


@dataclass
class Classifier:
    words: WordVectors
    network: Network | None
    share: float

    def scores(self, texts) -> np.ndarray:
        if self.network is None:
            return np.full(len(texts), self.share)
        return self.network.probabilities(self.words.pooled(texts))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Classifier:
    """Word vectors of all documents, and the network from labels of (doc_id, quality)."""
    words = WordVectors.of(context_sums(docs))
    chosen = (
        labels.where("doc_id is not null and quality is not null")
        .groupBy("doc_id").agg(F.max(F.col("quality").cast("int")).alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    )
    chosen = F.broadcast(written(chosen, "quality-sample"))  # at most `sample` rows
    labelled = docs.select("doc_id", "text").join(chosen, "doc_id").select("doc_id", "text", "quality")
    shared = docs.sparkSession.sparkContext.broadcast(words)

    def run(batches):
        for batch in by_bytes(batches):
            features = shared.value.pooled(batch["text"]).astype(np.float32)
            raw = pa.array([f.tobytes() for f in features], pa.binary())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["quality"], raw], names=["doc_id", "quality", "features"])

    found = written(labelled.mapInArrow(run, "doc_id long, quality int, features binary"), "quality-features")
    rows = found.orderBy("doc_id", "features").limit(sample).collect()
    y = np.array([min(max(r["quality"], 0), 1) for r in rows], dtype=float)
    if len(np.unique(y)) < 2:
        return Classifier(words, None, float(y.mean()) if len(y) else 0.5)
    x = np.stack([np.frombuffer(r["features"], dtype=np.float32) for r in rows]).astype(float)
    return Classifier(words, fit_network(x, y), float(y.mean()))


def scored(docs: DataFrame, classifier: Classifier, name: str = "__llm_score") -> DataFrame:
    """The documents with a column of scores, from the text alone."""
    shared = docs.sparkSession.sparkContext.broadcast(classifier)
    names = docs.columns

    def run(batches):
        for batch in by_bytes(batches):
            scores = pa.array(shared.value.scores(batch["text"]))
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in names], scores], names=[*names, name])

    return docs.mapInArrow(run, StructType([*docs.schema, StructField(name, DoubleType())]))


def op13_quality(spark: SparkSession, sf_dir: str, least: float = 0.5) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").where(fold(3) != 1)
    return scored(docs.select("doc_id", "text"), train(docs, labels), "score").select(
        "doc_id",
        F.coalesce(fold(3) == 1, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= least).cast("int").alias("predicted"),
    )
