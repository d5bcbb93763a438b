"""Packing into token sequences by order-preserving dynamic programming.

The documents of an input split, in their order, make one stream of tokens, each document closed by
an end id.  The stream is cut at ends of documents or sentences; inside a sentence only where two such
places lie more than `reach` tokens apart.  The cuts minimise padding plus a penalty for every cut that
truncates a document.  With f(j) the least cost up to cut j,

    f(j) = penalty(j) + size - p(j) + min of f(i) + p(i) over the cuts i with p(j) - p(i) <= size,

a minimum over a sliding window, which a monotone queue gives in constant time a cut.  Each Arrow batch
is solved with all its tokens; what lies after its last but one cut moves on to the next batch, so
only the last sequence of a split is short.  No shuffle: splits are independent, and sequence ids begin
with the split's number, which a retried task keeps.

Null text counts as empty and is a document of the end id alone; an empty table has no sequences; repeated
rows are packed as often as they occur; a long document or word is cut as often as it must be.
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import model_of, share_model
from .common import by_bytes, table

SIZE = 2048
END_ID = 1
SENTENCE, INSIDE = 6, 48
REACH = 512
_STOPS = np.zeros(256, dtype=bool)
_STOPS[[ord(c) for c in ".!?"]] = True
SCHEMA = (
    "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
)


def best_cuts(places: list[int], penalties: list[int], size: int) -> list[int]:
    """Indexes of the places where the sequences end; the last place's own padding costs nothing.

    `places` ascend from 0 and are at most `size` apart.
    """
    n = len(places)
    value, back = [0] * n, [0] * n
    queue = deque([0])
    for j in range(1, n - 1):
        least = places[j] - size
        while places[queue[0]] < least:
            queue.popleft()
        i = queue[0]
        back[j] = i
        value[j] = v = penalties[j] + size + value[i]
        while queue and value[queue[-1]] >= v:
            queue.pop()
        queue.append(j)
    if n > 1:
        # Without padding at the end the least f(i) counts, not the least f(i) + p(i).
        window = [i for i in range(max(0, n - 1 - size), n - 1) if places[i] >= places[-1] - size]
        back[-1] = min(window, key=lambda i: value[i] - places[i])
    cuts, j = [], n - 1
    while j > 0:
        cuts.append(j)
        j = back[j]
    return cuts[::-1]


def _filled(places: np.ndarray, kinds: np.ndarray, words: np.ndarray, size: int, reach: int):
    """Adds word ends, or any token, where places lie further apart than `reach` (`size`)."""
    gaps = np.flatnonzero(np.diff(places) > reach)
    if len(gaps):
        inner = [words[np.searchsorted(words, places[g], "right") : np.searchsorted(words, places[g + 1])] for g in gaps]
        inner = np.unique(np.concatenate(inner))
        places = np.concatenate([places, inner])
        kinds = np.concatenate([kinds, np.full(len(inner), INSIDE)])
        order = np.argsort(places, kind="stable")
        places, kinds = places[order], kinds[order]
        wide = np.flatnonzero(np.diff(places) > size)
        more = [np.arange(places[g] + size, places[g + 1], size) for g in wide]
        if more:
            inner = np.concatenate(more)
            places = np.concatenate([places, inner])
            kinds = np.concatenate([kinds, np.full(len(inner), INSIDE)])
            order = np.argsort(places, kind="stable")
            places, kinds = places[order], kinds[order]
    return places, kinds


class _Stream:
    """The open end of a split's stream: ids and the pieces of documents they belong to."""

    def __init__(self, first_id: int, size: int, reach: int):
        self.size, self.reach = size, reach
        self.sequence = first_id
        self.ids = np.zeros(0, dtype="<u4")
        # Per piece of a document: doc_id, start in the document, tokens of the document; and its end here.
        self.docs = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
        self.null = np.zeros(0, bool)
        self.ends = np.zeros(0, np.int64)
        self.soft = np.zeros(0, np.int64)
        self.words = np.zeros(0, np.int64)

    def add(self, doc_ids, null, ids, doc_lengths, soft, words):
        at = len(self.ids)
        self.ids = np.concatenate([self.ids, ids])
        new = (doc_ids, np.zeros(len(doc_ids), np.int64), doc_lengths)
        self.docs = tuple(np.concatenate(pair) for pair in zip(self.docs, new, strict=True))
        self.null = np.concatenate([self.null, null])
        self.ends = np.concatenate([self.ends, at + np.cumsum(doc_lengths)])
        self.soft = np.concatenate([self.soft, at + soft])
        self.words = np.concatenate([self.words, at + words])

    def sequences(self, last: bool):
        """Pieces of the finished sequences as an Arrow batch; all of them if this is the end."""
        total = len(self.ids)
        if not total:
            return None
        places = np.unique(np.concatenate([[0], self.soft, self.ends]))
        kinds = np.where(np.isin(places, self.ends), 0, SENTENCE)
        places, kinds = _filled(places, kinds, self.words, self.size, self.reach)
        cuts = places[best_cuts(places.tolist(), kinds.tolist(), self.size)]
        if not last:
            cuts = cuts[:-1]
        done = int(cuts[-1]) if len(cuts) else 0
        out = self._pieces(cuts, done) if done else None
        self._drop(done)
        return out

    def _pieces(self, cuts: np.ndarray, done: int):
        stops = np.unique(np.concatenate([cuts, self.ends[self.ends <= done]]))
        begins = np.append(0, stops[:-1])
        doc = np.searchsorted(self.ends, begins, "right")
        doc_begin = np.append(0, self.ends[:-1])[doc]
        sequence = np.searchsorted(cuts, begins, "right")
        offset = begins - np.append(0, cuts[:-1])[sequence]
        raw = self.ids[:done].tobytes()
        pieces = [raw[4 * i : 4 * j] for i, j in zip(begins.tolist(), stops.tolist(), strict=True)]
        doc_ids, start, tokens = self.docs
        out = pa.RecordBatch.from_arrays(
            [
                pa.array(doc_ids[doc], mask=self.null[doc]),
                pa.array(begins - doc_begin + start[doc]),
                pa.array(stops - begins),
                pa.array(pieces, pa.binary()),
                pa.array(tokens[doc]),
                pa.array(sequence + self.sequence),
                pa.array(offset),
            ],
            names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
        )
        self.sequence += len(cuts)
        return out

    def _drop(self, done: int) -> None:
        if not done:
            return
        self.ids = self.ids[done:].copy()
        stay = int(np.searchsorted(self.ends, done, "right"))
        begin = np.append(0, self.ends[:-1])[stay:]
        doc_ids, start, tokens = (a[stay:].copy() for a in self.docs)
        if len(start) and begin[0] < done:
            start[0] += done - begin[0]
        self.docs = (doc_ids, start, tokens)
        self.null = self.null[stay:].copy()
        self.ends = self.ends[stay:] - done
        self.soft = self.soft[self.soft > done] - done
        self.words = self.words[self.words > done] - done


def pack(docs: DataFrame, path: str | None = None, size: int = SIZE, end_id: int = END_ID, reach: int = REACH) -> DataFrame:
    """Pieces of documents with their sequence and place there; `ids` are little-endian 32-bit numbers."""
    shared = share_model(docs.sparkSession, path)

    def run(batches):
        model = model_of(shared)
        stream = _Stream(TaskContext.get().partitionId() << 40, size, reach)
        for batch in by_bytes(batches):
            ids, words, borders = model.encode(batch["text"])
            lengths = np.diff(borders) + 1
            # Every document's ids move up by the end ids before it.
            doc_of_word = np.repeat(np.arange(len(lengths)), words.counts())
            word_ends = words.ids[1:] + doc_of_word
            is_stop = _STOPS[words.data[words.end - 1]] if len(words.end) else np.zeros(0, bool)
            stream.add(
                batch["doc_id"].fill_null(0).to_numpy(zero_copy_only=False),
                batch["doc_id"].is_null().to_numpy(zero_copy_only=False),
                np.insert(ids, borders[1:], end_id).astype("<u4"),
                lengths,
                word_ends[is_stop],
                word_ends,
            )
            out = stream.sequences(last=False)
            if out is not None:
                yield out
        out = stream.sequences(last=True)
        if out is not None:
            yield out

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents")).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )
