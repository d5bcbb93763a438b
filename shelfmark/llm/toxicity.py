"""Toxicity by a support vector machine on gap-weighted subsequences, with Nystroem landmarks.

The kernel of two words counts their common subsequences of three characters, each weighted by DECAY to the
power of the characters it spans in either, at most SPAN.  An insult with gaps, inserted characters or an
ending keeps most of its subsequences.  The kernel's map is taken over landmarks, insults or stems of insults,
scaled to length one.

Training sees at most `sample` labelled documents, those of the least hash of their doc_id.  Their sentences are
a bag: a toxic document has some sentence with an insult, a clean one has none.  Candidates are the words and
word beginnings that toxic bags hold at least LIFT times as often as clean ones; witnesses are chosen by greedy
cover, in which a bag counts AGAIN times as much for every witness it holds already, and become the landmarks, at most
LANDMARKS.  A witness needs LEAST_BAGS bags and counts beyond chance, or a fiftieth of the toxic bags; if there is none,
the words that tell most are taken.  Equal texts are one bag.  Instances are words:
witnesses, also with a character inserted, against the clean words nearest to any landmark.  A linear machine with
squared hinge loss is fitted on their Nystroem features.

A text is judged by its two worst words and by how many of its words begin with a landmark, which the kernel, blind to
places, cannot tell from words that hold it inside: a logistic curve, fitted on the sampled documents, maps the two
margins and that count to a probability, moved so that 0.7 is where errors on the sample are fewest.
Words are lower-cased (A-Z) and freed of characters other than letters and digits; a run of at least three single
letters ("i d i o t") is a word too.  The pieces between such characters are judged as well, and above LONGEST bytes
instead, single letters among them put together.  No word is cut: a long one is judged in overlapping windows, the
overlap the longest landmark and GAPS bytes, and counts as two worst words by windows that do not overlap.  Training
sees the same words and windows; candidates inside windows, or words of scripts without spaces, begin at any of their
characters.  Null and empty texts get the score of a text without any such word.  Without labels of both kinds the
score is the constant 0.  Repeated rows get equal scores, an empty table an empty result; extra columns do no harm.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass
from heapq import heapify, heappop, heappush
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import Words, by_bytes, table, written

SAMPLE = 20_000
DECAY, SPAN = 0.5, 7
PREFIX, LIFT = (4, 12), 5
LANDMARKS, CANDIDATES, NEGATIVES, LEAST_BAGS = 512, 8192, 4000, 3
CHANCE = 0.1
LONGEST, GAPS = 40, 8
INNER = (4, 6, 9, 12)
AGAIN = 0.7
_SYMBOLS = 64
_CODE = np.zeros(256, dtype=np.int64)  # 0: not a symbol
_CODE[ord("0") : ord("9") + 1] = np.arange(1, 11)
_CODE[ord("a") : ord("z") + 1] = np.arange(11, 37)
_CODE[128:] = 37 + np.arange(128) % 27
_STRIP = re.compile(rb"[^0-9a-z\x80-\xff]+")
_BETWEEN = re.compile(  # as _STRIP, and the punctuation of U+0080, U+2000, U+3000 and U+FF00
    rb"(?:[^0-9a-z\x80-\xff]|\xc2[\x80-\xa9\xab-\xb4\xb6-\xb9\xbb-\xbf]|\xe2[\x80\x81][\x80-\xbf]|\xe3\x80[\x80-\x84\x88-\xbf]"
    rb"|\xef\xbc[\x81-\x8f\x9a-\xa0\xbb-\xbf]|\xef\xbd[\x80\x9b-\xa5])+"
)
_THREE_BYTES = re.compile(rb"[\xe0-\xef]")
_SPACED = re.compile(r"(?<![^\W_])(?:[^\W_][ \t.,*_-]+){2,}[^\W_](?![^\W_])")


def normal(word: bytes) -> bytes:
    return _STRIP.sub(b"", word.lower())


def windows(run: bytes, width: int, step: int) -> list[tuple[int, bytes]]:
    """(start, part): the whole run, or windows of `width` bytes that cover it, at most `step` apart."""
    if len(run) <= width:
        return [(0, run)]
    return [(at, run[at : at + width]) for at in [*range(0, len(run) - width, step), len(run) - width]]


def pieces(word: bytes) -> list[bytes]:
    """The parts of a word between characters other than letters and digits."""
    return [p for p in _BETWEEN.split(word.lower()) if p]


def views(run: bytes) -> list[list[bytes]]:
    """The ways to read a run as words: put together if short, as its pieces, and single letters put together."""
    joined, parts = normal(run), pieces(run)
    if len(parts) < 2:
        return [[joined]]
    if len(joined) <= LONGEST:
        return [[joined], parts]
    single = groupby(parts, lambda p: len(p) <= 4 and len(p.decode()) == 1)
    return [parts + [w for one, g in single if one and len(w := b"".join(g)) > 2]]


def spaced_words(text: str) -> list[bytes]:
    """Runs of at least three single letters, put together."""
    return [normal(m.encode()) for m in _SPACED.findall(text)]


def subsequences(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, subsequence, weight) of every occurrence, words by their place."""
    codes = _CODE[np.frombuffer(b"".join(words), dtype=np.uint8)]
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    word = np.repeat(np.arange(len(words)), lengths)
    ends = np.repeat(np.cumsum(lengths), lengths)
    place = np.arange(len(codes))
    found = []
    for span in range(3, SPAN + 1):
        at = place[place + span <= ends]
        for middle in range(1, span - 1):
            triple = (codes[at] * _SYMBOLS + codes[at + middle]) * _SYMBOLS + codes[at + span - 1]
            found.append((word[at], triple, np.full(len(at), DECAY**span)))
    return tuple(np.concatenate(parts) for parts in zip(*found, strict=True))


def _by_size(words: list[bytes], size: int = 1 << 16, most: int = 8192):
    """(place, words) of slices of about `size` bytes, to bound memory."""
    total = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)))
    at = 0
    while at < len(words):
        before = total[at - 1] if at else 0
        stop = min(at + most, max(at + 1, int(np.searchsorted(total, before + size, "right"))))
        yield at, words[at:stop]
        at = stop


class Landmarks:
    """The landmarks' subsequences as a table from subsequence to weights."""

    def __init__(self, words: list[bytes]):
        self.words = words
        word, triple, weight = subsequences(words)
        self.row = np.full(_SYMBOLS**3, -1, dtype=np.int32)
        known = np.unique(triple)
        self.row[known] = np.arange(len(known))
        self.weights = np.zeros((len(known), len(words)))
        np.add.at(self.weights, (self.row[triple], word), weight)
        self.weights /= np.maximum(np.sqrt((self.weights**2).sum(axis=0)), 1e-12)

    def kernel(self, words: list[bytes]) -> np.ndarray:
        """The kernel of every word with every landmark of length one."""
        out = np.zeros((len(words), len(self.words)))
        for at, part in _by_size(words, (1 << 16) * 96 // max(96, len(self.words))):
            word, triple, weight = subsequences(part)
            row = self.row[triple]
            hit = row >= 0
            word, row, weight = word[hit], row[hit], weight[hit]
            if not len(word):
                continue
            # Occurrences are summed by (word, subsequence) first, as most words have few hits.
            key, place = np.unique(word * len(self.weights) + row, return_inverse=True)
            sums = np.bincount(place, weights=weight, minlength=len(key))
            word, row = np.divmod(key, len(self.weights))
            begins = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            out[at + word[begins]] = np.add.reduceat(self.weights[row] * sums[:, None], begins, axis=0)
        return out


def _clipped(signs: np.ndarray) -> np.ndarray:
    return np.hstack([np.clip(signs[:, :2], -1.5, 1.5), np.log1p(signs[:, 2:]), np.ones((len(signs), 1))])


@dataclass
class Machine:
    """A fitted machine; `weights` act on the kernel with the landmarks, `curve` on a text's signs."""

    landmarks: list[bytes]
    weights: np.ndarray
    bias: float
    curve: tuple[float, float, float, float] = (2.0, 2.0, 0.0, 0.0)

    def margins(self, words: list[bytes]) -> np.ndarray:
        if not hasattr(self, "_row"):
            known = Landmarks(self.landmarks)
            # The margin is linear in the subsequences, so that each has one weight.
            self._row, self._weight = known.row, known.weights @ self.weights
        out = np.full(len(words), self.bias)
        for at, part in _by_size(words):
            word, triple, weight = subsequences(part)
            row = self._row[triple]
            hit = row >= 0
            sums = np.bincount(word[hit], weights=weight[hit] * self._weight[row[hit]], minlength=len(part))
            out[at : at + len(part)] += sums
        return out

    def run_margins(self, runs: list[bytes]) -> np.ndarray:
        """The two largest margins of each run, at places that do not overlap; the second is -inf if there is one place.

        A run is judged by every way to read it.
        """
        reach = max(map(len, self.landmarks)) + GAPS
        width = max(LONGEST, 2 * reach)
        out = np.full((len(runs), 2), -np.inf)
        for first in range(0, len(runs), 1 << 14):
            at: list[int] = []
            short: list[bytes] = []
            for i, run in enumerate(runs[first : first + (1 << 14)], first):
                read = views(run)
                if len(read) == len(read[0]) == 1 and len(read[0][0]) <= width:
                    at.append(i)
                    short += read[0]
                    continue
                for words in read:
                    out[i] = np.maximum(out[i], self._two_largest(words, width, width - reach))
            out[at, 0] = self.margins(short)
        return out

    def _two_largest(self, words: list[bytes], width: int, step: int) -> list[float]:
        parts, word, start = [], [], []
        for i, w in enumerate(words):
            for at, part in windows(w, width, step):
                parts.append(part)
                word.append(i)
                start.append(at)
        margin, word, start = self.margins(parts), np.array(word), np.array(start)
        top = int(margin.argmax())
        apart = margin[(word != word[top]) | (np.abs(start - start[top]) >= width)]
        return [margin[top], apart.max() if len(apart) else -np.inf]

    def begins(self, runs: list[bytes]) -> np.ndarray:
        """Whether each run begins with a landmark."""
        known = set(self.landmarks)
        lengths = sorted({len(w) for w in known})
        words = map(normal, runs)
        return np.fromiter((any(w[:n] in known for n in lengths) for w in words), dtype=bool, count=len(runs))

    def scores(self, signs: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(_clipped(signs) @ self.curve, -30, 30)))


def sentence_words(text: str) -> set[bytes]:
    """The words of all sentences of a text, as the machine sees them; long ones as windows that overlap by half."""
    runs: set[bytes] = set()
    for sentence in re.split(r"[.!?]+\s", text or ""):
        for word in set(sentence.encode().split()):
            runs.update(*views(word))
        runs.update(spaced_words(sentence))
    return {w for run in runs if len(run) > 2 for _, w in windows(run, LONGEST, LONGEST // 2)}


def _beginnings(words: set[bytes]) -> set[bytes]:
    """Words and what they begin with; also what stands inside windows, and in scripts that may have no spaces."""
    out = words | {w[:n] for w in words for n in range(PREFIX[0], min(PREFIX[1], len(w)))}
    for w in words:
        if len(w) == LONGEST or _THREE_BYTES.search(w):
            starts = [i for i, c in enumerate(w) if c & 0xC0 != 0x80]
            out.update(w[i : i + n] for i in starts for n in INNER if i + n <= len(w))
    return out


def _word_counts(labelled: DataFrame) -> DataFrame:
    """(word, whole, toxic, clean): how many documents of either kind hold the word or beginning."""

    def run(batches):
        for batch in by_bytes(batches):
            counts: dict[bytes, list[int]] = {}
            whole: set[bytes] = set()
            for text, toxic in zip(batch["text"].to_pylist(), batch["toxic"].to_pylist(), strict=True):
                words = sentence_words(text)
                whole |= words
                for word in _beginnings(words):
                    counts.setdefault(word, [0, 0])[0 if toxic else 1] += 1
            sums = np.array(list(counts.values()), dtype=np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(list(counts), pa.binary()),
                    pa.array([w in whole for w in counts], pa.bool_()),
                    pa.array(sums[:, 0]),
                    pa.array(sums[:, 1]),
                ],
                names=["word", "whole", "toxic", "clean"],
            )

    found = labelled.select("text", "toxic").mapInArrow(run, "word binary, whole boolean, toxic long, clean long")
    return found.groupBy("word").agg(
        F.max("whole").alias("whole"), F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")
    )


def _bags(labelled: DataFrame, candidates: list[bytes]) -> list[list[int]]:
    """For every toxic document of the sample the candidates it holds, by their place."""
    at = {w: i for i, w in enumerate(candidates)}

    def run(batches):
        for batch in by_bytes(batches):
            found = [
                sorted(at[w] for w in _beginnings(sentence_words(text)) if w in at) for text in batch["text"].to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int32()))], names=["found"])

    return [r["found"] for r in labelled.where("toxic = 1").select("text").mapInArrow(run, "found array<int>").collect()]


def witnesses(bags: list[list[int]], costs: list[float], n: int, least: list[float]) -> list[int]:
    """Words that explain the toxic bags, best first.

    A word gains the weight of the bags that hold it less its cost, and must gain its `least`.  Choosing it takes
    weight from its bags: further insults of a text still count, but the chance words of a text with copies do not.
    """
    weights = np.ones(len(bags))
    holders: dict[int, list[int]] = {}
    for b, bag in enumerate(bags):
        for i in bag:
            holders.setdefault(i, []).append(b)
    open_words = {i: np.array(h) for i, h in holders.items()}
    # Gains only fall, so that a word whose gain still leads when it is taken again is the best.
    heap = [(costs[i] - len(h), i) for i, h in open_words.items()]
    heapify(heap)
    chosen: list[int] = []
    while len(chosen) < n and heap:
        _, i = heappop(heap)
        gain = weights[open_words[i]].sum() - costs[i]
        if gain < least[i]:
            continue
        if heap and heap[0] < (-gain, i):
            heappush(heap, (-gain, i))
            continue
        chosen.append(i)
        weights[open_words[i]] *= AGAIN
    return chosen


def _nearest_clean(words: DataFrame, landmarks: list[bytes], n: int) -> list[bytes]:
    """The clean sentences' words with the largest kernel to any landmark, at most n."""

    def run(batches):
        known = Landmarks(landmarks)
        for batch in batches:
            near = known.kernel(batch["word"].to_pylist()).max(axis=1)
            yield pa.RecordBatch.from_arrays([batch["word"], pa.array(near)], names=["word", "near"])

    near = words.where("whole and clean > 0").select("word").mapInArrow(run, "word binary, near double")
    return [bytes(r["word"]) for r in near.orderBy(F.desc("near"), "word").limit(n).collect()]


def _fit(features: np.ndarray, y: np.ndarray, penalty: float = 1e-3, rounds: int = 50) -> tuple[np.ndarray, float]:
    """A linear machine with squared hinge loss, by Newton steps; both kinds weigh the same."""
    x = np.hstack([features, np.ones((len(y), 1))])
    share = np.where(y > 0, 0.5 / (y > 0).sum(), 0.5 / (y < 0).sum())
    w = np.zeros(x.shape[1])
    ridge = penalty * np.eye(len(w))
    ridge[-1, -1] = 1e-9
    active = np.ones(len(y), dtype=bool)
    for _ in range(rounds):
        weighted = x[active] * share[active][:, None]
        w = np.linalg.solve(ridge + weighted.T @ x[active], weighted.T @ y[active])
        before, active = active, y * (x @ w) < 1
        if (active == before).all():
            break
    return w[:-1], float(w[-1])


def _stretched(word: bytes) -> list[bytes]:
    """The word with a foreign character inserted at each inner place, as a gapped insult has."""
    return [word[:i] + b"q" + word[i:] for i in range(1, len(word))]


def beyond_chance(toxic: int, clean: int, odds: float, tried: int) -> bool:
    """Whether fewer than CHANCE of the tried words would be so frequent in toxic texts by chance (Chernoff's bound)."""
    n, share = toxic + clean, odds / (1 + odds)
    far = toxic * math.log(toxic / (n * share)) + (clean * math.log(clean / (n * (1 - share))) if clean else 0)
    return toxic > n * share and tried * math.exp(-far) < CHANCE


def _landmarks(labelled: DataFrame, rows: list, odds: float, least: list[float], n: int = LANDMARKS) -> list[bytes]:
    """The witnesses among the candidate rows; one beginning stands for all that begin with it, or that it begins with."""
    candidates = [bytes(r["word"]) for r in rows]
    landmarks: list[bytes] = []
    for i in witnesses(_bags(labelled, candidates), [2 * odds * r["clean"] for r in rows], len(rows), least):
        if len(landmarks) < n and not any(candidates[i].startswith(w) or w.startswith(candidates[i]) for w in landmarks):
            landmarks.append(candidates[i])
    return landmarks


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Machine | None:
    """The machine from labels of (doc_id, toxic); None without labels of both kinds."""
    chosen = (
        labels.where("doc_id is not null and toxic is not null")
        .groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
        .orderBy(F.xxhash64("doc_id")).limit(sample)
    )
    chosen = F.broadcast(written(chosen, "toxic-sample"))
    labelled = written(docs.select("doc_id", "text").join(chosen, "doc_id"), "toxic-texts")
    # Copies are no evidence of their own: words are counted, and bags made, once a text.
    text = F.xxhash64("text").alias("digest")
    one = labelled.groupBy(text, "toxic").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "toxic")
    one = written(one, "toxic-one-each")
    single = labelled.join(F.broadcast(one), ["doc_id", "toxic"])
    words = written(_word_counts(single), "toxic-words")
    n_toxic, n_clean = one.agg(F.sum("toxic"), F.count("*") - F.sum("toxic")).first()
    if not (n_toxic and n_clean):
        return None
    odds = n_toxic / n_clean
    gain = F.col("toxic") - 2 * odds * F.col("clean")
    often = words.where((F.col("toxic") >= LEAST_BAGS) & (F.col("toxic") >= LIFT * odds * F.col("clean")))
    order = [F.desc(gain), F.desc(F.length("word")), "word"]
    rows = often.orderBy(*order).limit(CANDIDATES).collect()
    tried = words.where(F.col("toxic") >= LEAST_BAGS).count()
    # What is not beyond chance must explain a share of the toxic texts.
    share = max(LEAST_BAGS, n_toxic / 50)
    least = [LEAST_BAGS if beyond_chance(r["toxic"], r["clean"], odds, tried) else share for r in rows]
    landmarks = _landmarks(single, rows, odds, least)
    if not landmarks:
        # Too few texts for evidence: the words that tell most, as far as toxic texts have words.
        rows = words.where("toxic > 0").orderBy(*order).limit(CANDIDATES).collect()
        landmarks = _landmarks(single, rows, odds, [-math.inf] * len(rows), 16)
    if not landmarks:
        return None
    # A clean word that begins like a landmark tells nothing about words; the documents' curve weighs it.
    negative = [w for w in _nearest_clean(words, landmarks, max(NEGATIVES, 40 * len(landmarks))) if not w.startswith(tuple(landmarks))]
    positive = landmarks + [v for w in landmarks for v in _stretched(w)]
    instances = positive + negative
    y = np.append(np.ones(len(positive)), -np.ones(len(negative)))
    known = Landmarks(landmarks)
    kernel = known.kernel(instances)
    # Nystroem: features whose products are the kernel as far as the landmarks span it.
    values, vectors = np.linalg.eigh(known.kernel(landmarks))
    root = vectors / np.sqrt(np.maximum(values, 1e-6)) @ vectors.T
    if (y < 0).any():
        w, b = _fit(kernel @ root, y)
    else:
        w, b = root @ np.ones(len(landmarks)), -0.5
    machine = Machine(landmarks, root @ w, b)
    judged = _signs_of(labelled, machine).toPandas()
    machine.curve = _fit_curve(judged[["first", "second", "begin"]].to_numpy(), judged["toxic"].to_numpy())
    return machine


def _fit_curve(signs: np.ndarray, toxic: np.ndarray, least: float = 0.7) -> tuple[float, float, float, float]:
    """A logistic curve by Newton steps, shifted so that `least` parts the sample with the fewest errors."""
    x, y = _clipped(signs), toxic.astype(float)
    w = np.zeros(4)
    ridge = np.diag([1.0, 1.0, 1.0, 1e-6])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w = w - np.linalg.solve(ridge + (x * (p * (1 - p))[:, None]).T @ x, ridge @ w + x.T @ (p - y))
    z = x @ w
    order = np.argsort(z)
    z, y = z[order], y[order]
    # Errors when everything from place i on counts as toxic.
    errors = np.append(0, np.cumsum(y)) + np.append(np.cumsum((1 - y)[::-1])[::-1], 0)
    best = np.flatnonzero(errors == errors.min())
    edge = np.concatenate([[z[0] - 2], z, [z[-1] + 2]])
    width = edge[best + 1] - edge[best]
    i = best[np.argmax(width)]
    cut = edge[i] + 0.5 * (edge[i + 1] - edge[i])
    return *map(float, w[:3]), float(w[3] - cut + math.log(least / (1 - least)))


def _signs_of(labelled: DataFrame, machine: Machine) -> DataFrame:
    """(toxic, first, second, begin): the signs of each document."""

    def run(batches):
        for batch in by_bytes(batches):
            columns = [batch["toxic"], *map(pa.array, _signs(machine, batch["text"]).T.copy())]
            yield pa.RecordBatch.from_arrays(columns, names=["toxic", "first", "second", "begin"])

    return labelled.select("text", "toxic").mapInArrow(run, "toxic int, first double, second double, begin double")


def _signs(judge: Machine, texts) -> np.ndarray:
    """The two largest word margins of every text, and how many of its words begin with a landmark."""
    words = Words(texts, lower=True)
    counts = words.counts()
    worst = np.full((len(counts), 2), judge.bias)
    begin = np.zeros(len(counts))
    if len(words.hashes):
        data = words.data.tobytes()
        distinct, first, place = np.unique(words.hashes, return_index=True, return_inverse=True)
        spans = zip(words.begin[first].tolist(), words.end[first].tolist(), strict=True)
        runs = [data[i:j] for i, j in spans]
        margin, next_margin = judge.run_margins(runs)[place].T
        row = np.repeat(np.arange(len(counts)), counts)
        begin += np.bincount(row, weights=judge.begins(runs)[place], minlength=len(counts))
        some = np.flatnonzero(counts)
        begins = words.starts[some]
        worst[some, 0] = np.maximum.reduceat(margin, begins)
        top = np.flatnonzero(margin == worst[row, 0])
        top = top[np.append(True, row[top[1:]] != row[top[:-1]])]
        rest = margin.copy()
        rest[top] = np.maximum(judge.bias, next_margin[top])
        worst[some, 1] = np.maximum.reduceat(rest, begins)
        # Only texts with three short words in a row can spell one letter by letter.
        short = words.end - words.begin <= 2
        spelt = short[:-2] & short[1:-1] & short[2:] & (row[:-2] == row[2:])
        owner, spaced = [], []
        for r in np.unique(row[: len(spelt)][spelt]).tolist():
            found = spaced_words(data[words.offsets[r] : words.offsets[r + 1]].decode())
            spaced += found
            owner += [r] * len(found)
        if spaced:
            for r, m in zip(owner, judge.run_margins(spaced).tolist(), strict=True):
                worst[r] = sorted([*worst[r], *m])[:-3:-1]
    return np.column_stack([worst, begin])


def _scores(judge: Machine, texts) -> np.ndarray:
    return judge.scores(_signs(judge, texts))


def scored(docs: DataFrame, machine: Machine | None, name: str = "__llm_score") -> DataFrame:
    """The documents with a column of scores, from the text alone."""
    if machine is None:
        return docs.withColumn(name, F.lit(0.0))
    shared = docs.sparkSession.sparkContext.broadcast(machine)
    names = docs.columns

    def run(batches):
        for batch in by_bytes(batches):
            scores = pa.array(_scores(shared.value, batch["text"]))
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in names], scores], names=[*names, name])

    return docs.mapInArrow(run, StructType([*docs.schema, StructField(name, DoubleType())]))


def fold(divisor: int, name: str = "doc_id"):
    """crc32 of the number as text, modulo the divisor."""
    return F.pmod(F.crc32(F.col(name).cast("string").cast("binary")), F.lit(divisor))


def op8_toxicity(spark: SparkSession, sf_dir: str, least: float = 0.7) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").where(fold(3) != 1)
    return scored(docs.select("doc_id", "text"), train(docs, labels), "score").select(
        "doc_id",
        F.coalesce(fold(3) == 1, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= least).cast("int").alias("predicted"),
    )


def drop_toxic(docs: DataFrame, labels: DataFrame, least: float = 0.7) -> DataFrame:
    """The documents, whole rows, without those whose text scores `least` or more."""
    machine = train(docs, labels.where(fold(3) != 1))
    return scored(docs, machine).where(F.col("__llm_score") < least).drop("__llm_score")
