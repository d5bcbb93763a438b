"""Language-model scores by a hashed maximum-entropy model with a class-factored softmax.

A text's tokens are its words (A-Z lowered) and one end.  The model's probability of a token after its history is

    P(class | history) * P(token | class, class of the token before).

The first factor is a softmax over hashed features of the history, each a row of one weight table: the last token,
the one before it and the one before that (skips), the last two together, and the last of the most frequent words,
however far back.  The second is a softmax over the class's words, a count prior and a weight for each of the
`PAIRED` most frequent tokens after each class, fitted by iterative scaling to their counts.  Tokens outside the `VOCABULARY` most frequent are one class; inside
it a token has its smoothed share of the class's counts, so unseen tokens have a probability too.

Classes are a word's company (one of GROUPS groups of the ANCHORS most frequent words, grouped by which of them
follow each other) and its band of frequency.  Counts, company and weights are gathered over all training
texts.  Weights are trained in ROUNDS rounds, each on another part of them: every task makes gradient updates
from the common weights, and the tasks' changes are averaged by tokens, summed level by level.  What is broadcast
has a fixed size; rarer tokens meet their counts in an ordinary join.

Null and empty texts have the end alone.  Null doc_ids count as text "" in the fold.  Repeated rows count as often as
they occur and score alike.  Without training texts the score is the base score.  An empty table gives an empty
result; extra columns do no harm.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, by_bytes, mix, table, written

VOCABULARY, ANCHORS, GROUPS = 1 << 17, 256, 8
BANDS = (64, 1024, 16384)
ROWS, PAIRED = 1 << 14, 4096
ROUNDS, RATE, BATCH = 2, 0.2, 1 << 14
END = np.uint64(0x5BD1E9955BD1E995)
START = np.uint64(0xC6A4A7935BD1E995)
_SLOTS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)
BLOCK = 1 << 16  # numbers in a block of a summed table
MERGED = 32


class Tokens:
    """The tokens of a batch of texts: hashes, each text's row, and its first token."""

    def __init__(self, texts):
        words = Words(texts, lower=True)
        n = len(words.starts) - 1
        self.hashes = np.insert(words.hashes, words.starts[1:], END)
        self.starts = words.starts + np.arange(n + 1)
        self.counts = np.diff(self.starts)
        self.row = np.repeat(np.arange(n), self.counts)
        self.place = np.arange(len(self.hashes)) - self.starts[self.row]

    def before(self, values: np.ndarray, steps: int, start) -> np.ndarray:
        """The values so many tokens earlier in the text; `start` ahead of it."""
        out = np.full(len(values), start, dtype=values.dtype)
        out[steps:] = np.where(self.place[steps:] >= steps, values[:-steps], start)
        return out


@dataclass
class Model:
    """What is broadcast: the vocabulary in the order of hashes, classes, priors and weights."""

    hashes: np.ndarray  # ascending
    ids: np.ndarray  # by frequency, 0 first
    logs: np.ndarray  # log10(count + 0.1) by id
    group_of: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # of anchors, by id
    class_of: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # by id, then the rare, then the start
    prior: np.ndarray = field(default_factory=lambda: np.zeros(0))  # log share of the class, by id
    weights: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), np.float32))
    pairs: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), np.float32))

    @property
    def size(self) -> int:
        return len(self.ids)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Ids of tokens; the vocabulary's size for rarer ones."""
        at = np.minimum(np.searchsorted(self.hashes, hashes), self.size - 1)
        return np.where(self.hashes[at] == hashes, self.ids[at], self.size)

    def last_anchor(self, tokens: Tokens, ids: np.ndarray) -> np.ndarray:
        """The id of the last anchor before each token, -1 where the text has none yet."""
        is_anchor = ids < min(ANCHORS, self.size)
        at = np.where(is_anchor, np.arange(len(ids)), -1)
        at = np.maximum.accumulate(at)
        before = np.append(-1, at[:-1])
        return np.where(before >= tokens.starts[tokens.row], ids[before], -1)

    def features(self, tokens: Tokens, anchor: np.ndarray) -> np.ndarray:
        """Rows of the weight table for every token's history."""
        one, two, three = (tokens.before(tokens.hashes, n, START) for n in (1, 2, 3))
        keys = (one, two, three, one * _SLOTS[3] + two, (anchor + 2).astype(np.uint64))
        shift = np.uint64(64 - int(math.log2(ROWS)))
        return np.stack([(mix(k + s) >> shift).astype(np.int32) for k, s in zip(keys, _SLOTS, strict=True)], axis=1)

    def class_probabilities(self, features: np.ndarray) -> np.ndarray:
        z = self.weights.take(features[:, 0], axis=0)
        for column in features.T[1:]:
            z += self.weights.take(column, axis=0)
        z -= z.max(axis=1, keepdims=True)
        np.exp(z, out=z)
        return z / z.sum(axis=1, keepdims=True)

    def pair_norms(self) -> np.ndarray:
        """The log of the summed weights of each class's words, after each class."""
        classes = self.weights.shape[1]
        held = min(PAIRED, self.size)
        share = np.exp(self.prior)
        rest = np.bincount(self.class_of[held : self.size], weights=share[held:], minlength=classes)
        out = np.empty((self.pairs.shape[0], classes))
        for c in range(len(out)):
            lifted = share[:held] * np.exp(self.pairs[c, :held].astype(float))
            out[c] = np.bincount(self.class_of[:held], weights=lifted, minlength=classes) + rest
        return np.log(np.maximum(out, 1e-300))


# --- sums of tables over all tasks --------------------------------------------------------------


def _blocks(values: np.ndarray, weight: float):
    """A table as rows (block, part, weight, data)."""
    flat = values.ravel().astype(np.float32)
    part = TaskContext.get().partitionId()
    for at in range(0, len(flat), BLOCK):
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([at // BLOCK], pa.int32()), pa.array([part], pa.int32()), pa.array([float(weight)]),
                pa.array([flat[at : at + BLOCK].tobytes()], pa.binary()),
            ],
            names=["block", "part", "weight", "data"],
        )


_BLOCKS = "block int, part int, weight double, data binary"


def _add(rows: pa.Table) -> pa.Table:
    data = sum(np.frombuffer(d, np.float32).astype(np.float64) for d in rows["data"].to_pylist())
    return pa.table(
        {
            "block": rows["block"][:1].combine_chunks(), "part": rows["part"][:1].combine_chunks(),
            "weight": pa.array([sum(rows["weight"].to_pylist())]),
            "data": pa.array([data.astype(np.float32).tobytes()], pa.binary()),
        }
    )


def _summed(rows: DataFrame, parts: int, shape: tuple, name: str) -> tuple[np.ndarray, float]:
    """The sum of the tasks' tables, MERGED at a time, and of their weights."""
    rows = written(rows, name)
    while parts > 1:
        rows = rows.withColumn("part", F.floor(F.col("part") / MERGED).cast("int"))
        rows = rows.groupBy("block", "part").applyInArrow(_add, _BLOCKS)
        parts = -(-parts // MERGED)
    out = np.zeros(math.prod(shape), dtype=np.float32)
    weight = 0.0
    for r in rows.collect():
        values = np.frombuffer(r["data"], np.float32)
        out[r["block"] * BLOCK : r["block"] * BLOCK + len(values)] += values
        weight = max(weight, r["weight"])
    return out.reshape(shape), weight


# --- training -----------------------------------------------------------------------------------


def _token_counts(texts: DataFrame) -> DataFrame:
    def run(batches):
        for batch in by_bytes(batches):
            token, count = np.unique(Tokens(batch["text"]).hashes, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(count)], names=["token", "c"])

    return texts.mapInArrow(run, "token long, c long").groupBy("token").agg(F.sum("c").alias("c"))


def _tables(texts: DataFrame, model: Model, shape: tuple, add, name: str) -> np.ndarray:
    """The sum of a table that `add(model, table, tokens, ids)` fills in every task."""
    shared = texts.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        out = np.zeros(shape)
        for batch in by_bytes(batches):
            tokens = Tokens(batch["text"])
            add(shared.value, out, tokens, shared.value.find(tokens.hashes))
        yield from _blocks(out, 1)

    rows = texts.mapInArrow(run, _BLOCKS)
    return _summed(rows, texts.rdd.getNumPartitions(), shape, name)[0]


def _followers(model: Model, out: np.ndarray, tokens: Tokens, ids: np.ndarray) -> None:
    before = model.last_anchor(tokens, ids)
    use = (before >= 0) & (ids < len(out))
    np.add.at(out, (before[use], ids[use]), 1)


def _company(model: Model, out: np.ndarray, tokens: Tokens, ids: np.ndarray) -> None:
    before = model.last_anchor(tokens, ids)
    use = (before >= 0) & (ids < model.size)
    key = ids[use] * out.shape[1] + model.group_of[before[use]]
    out += np.bincount(key, minlength=out.size).reshape(out.shape)


def _grouped(follow: np.ndarray, groups: int) -> np.ndarray:
    """Groups of anchors by the anchors around them: k-means from mutually far seeds."""
    near = follow + follow.T + 0.1
    expected = near.sum(1, keepdims=True) * near.sum(0, keepdims=True) / near.sum()
    x = np.maximum(np.log(near / expected), 0)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    seeds = [0]
    while len(seeds) < min(groups, len(x)):
        seeds.append(int((x @ x[seeds].T).max(axis=1).argmin()))
    centres = x[seeds]
    for _ in range(25):
        group = (x @ centres.T).argmax(axis=1)
        centres = np.stack([x[group == g].mean(axis=0) if (group == g).any() else centres[g] for g in range(len(centres))])
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-9)
    return group


class _Learner:
    """Gradient updates of one task, from the common weights, and its counts of pairs."""

    def __init__(self, model: Model, rate: float):
        self.model = model
        self.start = model.weights
        model.weights = model.weights.copy()
        self.rate = rate
        self.squares = np.ones(len(model.weights), dtype=np.float32)
        self.seen = np.zeros(model.pairs.shape)
        self.after = np.zeros((len(model.pairs), model.weights.shape[1]))
        self.tokens = 0

    def learn(self, tokens: Tokens) -> None:
        m = self.model
        ids = m.find(tokens.hashes)
        features = m.features(tokens, m.last_anchor(tokens, ids))
        classes = m.class_of[ids]
        before = m.class_of[tokens.before(ids, 1, m.size + 1)]
        for at in range(0, len(ids), BATCH):
            part = slice(at, at + BATCH)
            self._step(features[part], classes[part])
        use = ids < PAIRED
        key = before[use] * PAIRED + ids[use]
        self.seen += np.bincount(key, minlength=self.seen.size).reshape(self.seen.shape)
        key = before * self.after.shape[1] + classes
        self.after += np.bincount(key, minlength=self.after.size).reshape(self.after.shape)
        self.tokens += len(ids)

    def _step(self, features: np.ndarray, classes: np.ndarray) -> None:
        m = self.model
        slope = m.class_probabilities(features)
        slope[np.arange(len(classes)), classes] -= 1
        keys, table = features.T.ravel().astype(np.intp), len(m.weights)
        rows = np.flatnonzero(np.bincount(keys, minlength=table))
        # Summed class by class: one class's sums of all rows stay in the cache.
        sums = np.empty((len(rows), slope.shape[1]))
        for c, own in enumerate(slope.T.astype(float)):
            sums[:, c] = np.bincount(keys, weights=np.tile(own, features.shape[1]), minlength=table)[rows]
        self.squares[rows] += (sums**2).sum(axis=1)
        m.weights[rows] -= self.rate * sums / np.sqrt(self.squares[rows])[:, None]

    def result(self) -> np.ndarray:
        change = (self.model.weights - self.start) * self.tokens
        return np.concatenate([change.ravel(), self.seen.ravel(), self.after.ravel()])


def _round(texts: DataFrame, model: Model, rate: float, name: str) -> tuple[np.ndarray, np.ndarray]:
    """One round: every task learns from its texts; the mean change, by tokens, moves the common weights.

    Returns how often each class was followed by each paired token, and by each class.
    """
    shared = texts.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        learner = _Learner(Model(**vars(shared.value)), rate)
        for batch in by_bytes(batches):
            learner.learn(Tokens(batch["text"]))
        if learner.tokens:
            yield from _blocks(learner.result(), learner.tokens)

    shapes = (model.weights.shape, model.pairs.shape, (len(model.pairs), model.weights.shape[1]))
    sizes = [math.prod(shape) for shape in shapes]
    total, tokens = _summed(texts.mapInArrow(run, _BLOCKS), texts.rdd.getNumPartitions(), (sum(sizes),), name)
    change, seen, after = (
        part.reshape(shape) for part, shape in zip(np.split(total, np.cumsum(sizes)[:-1]), shapes, strict=True)
    )
    if tokens:
        model.weights = model.weights + change / tokens
    return seen, after


def _fit_pairs(model: Model, seen: np.ndarray, after: np.ndarray, rounds: int = 4, calm: float = 3.0) -> None:
    """Pair weights by iterative scaling: what is expected after each class comes to what was seen."""
    held = min(PAIRED, model.size)
    classes = model.class_of[:held]
    for _ in range(rounds):
        expected = after[:, classes] * np.exp(model.prior[:held] + model.pairs[:, :held] - model.pair_norms()[:, classes])
        model.pairs[:, :held] += np.log((seen[:, :held] + calm) / (expected + calm)).astype(np.float32)


@dataclass
class Counts:
    """The training tokens' counts as a table, with their sums; those outside the vocabulary for themselves."""

    table: DataFrame
    tokens: int
    distinct: int
    rare_tokens: int
    rare_distinct: int


def _most_frequent(counted: DataFrame, n: int):
    """The most frequent tokens as pandas rows, at most n: all those of the largest steps of counts that fit.

    Sorting for the first n would send n rows of every partition to the driver.
    """
    step = F.floor(F.log2("c") * 32)
    sizes = counted.groupBy(step.alias("step")).agg(F.count("*").alias("n")).orderBy(F.desc("step")).collect()
    total, least = 0, None
    for r in sizes:
        total += r["n"]
        if total > n:
            break
        least = r["step"]
    if least is None:  # more tokens of one count than fit
        found = counted.where(step == sizes[0]["step"]).orderBy("token").limit(n)
    else:
        found = counted.where(step >= least)
    return found.toPandas().sort_values(["c", "token"], ascending=[False, True], ignore_index=True)


def train(texts: DataFrame) -> tuple[Model | None, Counts]:
    """The model of a table of (part, text); `part` numbers the rounds' shares."""
    counted = written(_token_counts(texts.select("text")), "token-counts")
    tokens, distinct = counted.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    if not tokens:
        return None, Counts(counted, 0, 0, 0, 0)
    top = _most_frequent(counted, VOCABULARY)
    hashes, c = top["token"].to_numpy().view(np.uint64), top["c"].to_numpy()
    order = np.argsort(hashes)
    model = Model(hashes[order], order.astype(np.int64), np.log10(c + 0.1))
    rare = Counts(counted, tokens, distinct, tokens - int(c.sum()), distinct - len(c))

    anchors = min(ANCHORS, len(c))
    follow = _tables(texts.select("text"), model, (anchors, anchors), _followers, "anchors")
    model.group_of = _grouped(follow.astype(float), GROUPS)
    groups = int(model.group_of.max()) + 1
    company = _tables(texts.select("text"), model, (len(c), groups), _company, "company").astype(float)
    lift = (company + 0.5 * company.sum(0) / max(1.0, company.sum())) / np.maximum(company.sum(0), 1.0)
    band = np.searchsorted(BANDS, np.arange(len(c)), "right")
    class_of = lift.argmax(axis=1) * (len(BANDS) + 1) + band
    end = int(model.find(np.array([END]))[0])
    classes = groups * (len(BANDS) + 1)
    if end < len(c):
        class_of[end] = classes
    # The rare, and the start of a text, are classes of their own.
    model.class_of = np.concatenate([class_of, [classes + 1, classes + 2]]).astype(np.int64)
    mass = np.bincount(class_of, weights=c, minlength=classes + 3)
    model.prior = np.log(c / mass[class_of])
    total = mass.copy()
    total[classes + 1] = max(rare.rare_tokens, 0.5)
    model.weights = np.zeros((ROWS, classes + 2), dtype=np.float32)
    # Every history has the same number of features, so a fifth of the log shares each makes the unigram model.
    model.weights += (np.log((total[:-1] + 0.5) / (total[:-1] + 0.5).sum()) / len(_SLOTS)).astype(np.float32)
    model.pairs = np.zeros((classes + 3, PAIRED), dtype=np.float32)
    seen, after = np.zeros(model.pairs.shape), 0
    for k in range(ROUNDS):
        part = texts.where(F.col("part") == k).select("text")
        found = _round(part, model, RATE / (1 + k), f"weights-{k}")
        seen, after = seen + found[0], after + found[1]
    _fit_pairs(model, seen, after)
    return model, rare


# --- scoring ------------------------------------------------------------------------------------

_SCORED = "row long, doc_id long, n_tokens long, n_common long, base double, score double, tokens array<long>, times array<int>"


def _common_scores(docs: DataFrame, model: Model) -> DataFrame:
    """Scores of the vocabulary's tokens and of the rare class, and the rare tokens themselves."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m: Model = shared.value
        norms = m.pair_norms()
        part, n = TaskContext.get().partitionId() << 40, 0
        for batch in by_bytes(batches):
            tokens = Tokens(batch["text"])
            ids = m.find(tokens.hashes)
            features = m.features(tokens, m.last_anchor(tokens, ids))
            classes = m.class_of[ids]
            before = m.class_of[tokens.before(ids, 1, m.size + 1)]
            score = np.empty(len(ids))
            for at in range(0, len(ids), BATCH):
                p = m.class_probabilities(features[at : at + BATCH])
                score[at : at + BATCH] = np.log(np.maximum(p[np.arange(len(p)), classes[at : at + BATCH]], 1e-30))
            common = ids < m.size
            known = ids[common]
            score[common] += m.prior[known] - norms[before[common], classes[common]]
            paired = ids < min(PAIRED, m.size)
            score[paired] += m.pairs[before[paired], ids[paired]]
            rows = batch.num_rows
            row = tokens.row
            key = np.stack([row[~common].astype(np.uint64), tokens.hashes[~common]], axis=1)
            order = np.lexsort((key[:, 1], key[:, 0]))
            key = key[order]
            new = np.append(True, (key[1:] != key[:-1]).any(axis=1)) if len(key) else np.zeros(0, bool)
            begins = np.flatnonzero(new)
            times = np.diff(np.append(begins, len(key))).astype(np.int32)
            held = np.bincount(key[begins, 0].astype(np.int64), minlength=rows)
            offsets = pa.array(np.append(0, np.cumsum(held)).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(part + n + np.arange(rows)),
                    batch["doc_id"],
                    pa.array(tokens.counts),
                    pa.array(np.bincount(row[common], minlength=rows)),
                    pa.array(np.bincount(row[common], weights=m.logs[known], minlength=rows)),
                    pa.array(np.bincount(row, weights=score, minlength=rows) / math.log(10)),
                    pa.ListArray.from_arrays(offsets, pa.array(key[begins, 1].view(np.int64))),
                    pa.ListArray.from_arrays(offsets, pa.array(times)),
                ],
                names=["row", "doc_id", "n_tokens", "n_common", "base", "score", "tokens", "times"],
            )
            n += rows

    return docs.select("doc_id", "text").mapInArrow(run, _SCORED)


def scores(docs: DataFrame, held_out=None) -> DataFrame:
    """Per row the counts and log10 scores of its text; rows where `held_out` is true are not learnt from."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    fold = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(10))
    held_out = (fold == 0) if held_out is None else held_out
    texts = docs.where(~held_out).select(F.pmod(F.xxhash64("doc_id"), F.lit(ROUNDS)).alias("part"), "text")
    model, counts = train(texts)
    whole = math.log10(counts.tokens + 0.1 * (counts.distinct + 1))
    if model is None:
        words = F.size(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+"), F.lit(0)))
        n = (words + 1).cast("long")
        base = n * F.lit(-1 - whole)
        return docs.select(
            "doc_id", held_out.alias("held_out"), n.alias("n_tokens"), F.lit(0).cast("long").alias("n_known"),
            F.lit(0).cast("long").alias("train_tokens"), base.alias("base_score"), base.alias("score"),
        )
    common = written(_common_scores(docs, model), "common-scores")
    rare_whole = math.log10(counts.rare_tokens + 0.1 * (counts.rare_distinct + 1))
    rare = common.select("row", F.explode(F.arrays_zip("tokens", "times")).alias("t"))
    rare = rare.select("row", F.col("t.tokens").alias("token"), F.col("t.times").alias("m"))
    rare = (
        rare.join(counts.table, "token", "left")
        .select("row", "m", F.coalesce("c", F.lit(0)).alias("c"))
        .groupBy("row")
        .agg(
            F.sum(F.when(F.col("c") > 0, F.col("m")).otherwise(0)).alias("known"),
            F.sum(F.col("m") * F.log10(F.col("c") + 0.1)).alias("rare_base"),
            F.sum("m").alias("rare"),
        )
    )
    zero = F.lit(0)
    rare_base = F.coalesce("rare_base", F.lit(0.0))
    return common.drop("tokens", "times").join(rare, "row", "left").select(
        "doc_id",
        held_out.alias("held_out"),
        "n_tokens",
        (F.col("n_common") + F.coalesce("known", zero)).cast("long").alias("n_known"),
        F.lit(counts.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + rare_base - F.col("n_tokens") * whole).alias("base_score"),
        (F.col("score") + rare_base - F.coalesce("rare", zero) * rare_whole).alias("score"),
    )


def op1_maxent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(table(spark, sf_dir, "documents"))
