"""BPE encoding and decoding with an index from pairs to all their positions in a batch.

The distinct words of a batch that are not yet known are laid out as one array of symbols.  Every pair
that has a merge rank is listed with all its positions; the active ranks are applied in ascending
order, each at all its positions at once, and only the lists of the neighbouring pairs are updated.
Each word is so merged once a batch; texts are put together from their words' ids.

The model file is one of the public word-end vocabularies (NFC, lower case, split by a pattern, byte
symbols, `</w>` at word ends); it is read on the driver and broadcast, as its size is fixed.  Null
counts as empty text; an empty text has no ids.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import unicodedata
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import Words, by_bytes, plain_text, table

KNOWN_RUNS = 600_000


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_symbols() -> list[str]:
    """The printable stand-in of each byte: itself where printable, else the next free one from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    symbols = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [symbols[b] for b in range(256)]


class Bpe:
    """A model in memory; `ids_of` encodes texts, `tokens` decodes."""

    def __init__(self, model_json: str):
        spec = json.loads(model_json)
        model = spec["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = [""] * (max([*vocab.values(), *added.values()]) + 1)
        for token, i in (vocab | added).items():
            self.tokens[i] = token
        self.decimal = [str(i) for i in range(len(self.tokens))]
        symbols = _byte_symbols()
        self.plain = np.array([vocab[s] for s in symbols], dtype=np.int32)
        self.last = np.array([vocab[s + end] for s in symbols], dtype=np.int32)
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.left = np.array([vocab[a] for a, _ in merges], dtype=np.int64)
        self.right = np.array([vocab[b] for _, b in merges], dtype=np.int64)
        self.made = np.array([vocab[a + b] for a, b in merges], dtype=np.int32)
        self.size = len(self.tokens)
        codes = self.left * self.size + self.right
        self.code_rank = np.argsort(codes, kind="stable")
        self.codes = codes[self.code_rank]
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        pattern = pattern.replace(r"[^\s", r"[^\p{White_Space}")
        self.split = regex.compile(pattern + "|\n").findall
        special = regex.compile("|".join(map(regex.escape, added)))
        self.special_all = special.finditer
        self.lead = os.path.commonprefix(list(added))
        self.special = lambda run: self.lead in run and special.search(run)
        self.added = added
        self._forget()

    # --- one batch of words ---------------------------------------------------------------

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Merge ranks of symbol pairs; -1 where there is none."""
        codes = a.astype(np.int64) * self.size + b
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        return np.where(self.codes[at] == codes, self.code_rank[at], -1)

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of non-empty words one after the other, and the number of ids of each."""
        if not words:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        data = np.frombuffer(b"".join(words), dtype=np.uint8)
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        ends = np.cumsum(lengths)
        first, last = ends - lengths, ends - 1
        n = len(data)
        symbol = self.plain[data]
        symbol[last] = self.last[data[last]]
        after = np.arange(1, n + 1)
        after[last] = -1
        before = np.arange(-1, n - 1)
        before[first] = -1

        index: dict[int, list] = {}
        active: list[int] = []

        def enlist(at: np.ndarray, ranks: np.ndarray) -> None:
            found = ranks >= 0
            at, ranks = at[found], ranks[found]
            if not len(at):
                return
            order = np.argsort(ranks, kind="stable")
            at, ranks = at[order], ranks[order]
            cuts = np.flatnonzero(np.diff(ranks)) + 1
            begin = 0
            for stop, rank in zip([*cuts.tolist(), len(at)], ranks[np.append(0, cuts)].tolist(), strict=True):
                held = index.get(rank)
                if held is None:
                    index[rank] = [at[begin:stop]]
                    heapq.heappush(active, rank)
                else:
                    held.append(at[begin:stop])
                begin = stop

        start = np.flatnonzero(after >= 0)
        enlist(start, self._ranks(symbol[start], symbol[start + 1]))
        while active:
            rank = heapq.heappop(active)
            lists = index.pop(rank)
            at = lists[0] if len(lists) == 1 else np.concatenate(lists)
            a, b, new = self.left[rank], self.right[rank], self.made[rank]
            at = at[(symbol[at] == a) & (after[at] >= 0)]
            at = at[symbol[after[at]] == b]
            if a == b and len(at) > 1:
                at = np.sort(at)
                joined = np.append(False, at[1:] == after[at[:-1]])
                run = np.maximum.accumulate(np.where(joined, 0, np.arange(len(at))))
                at = at[(np.arange(len(at)) - run) % 2 == 0]
            if not len(at):
                continue
            gone = after[at]
            follow = after[gone]
            symbol[at] = new
            symbol[gone] = -1
            after[at] = follow
            has_next = follow >= 0
            before[follow[has_next]] = at[has_next]
            prior = before[at]
            prior = prior[prior >= 0]
            # A prior symbol that has just been made itself is listed among `at`.
            touched = np.concatenate([prior[symbol[prior] != new], at[has_next]])
            if len(touched):
                enlist(touched, self._ranks(symbol[touched], symbol[after[touched]]))
        alive = symbol >= 0
        return symbol[alive], np.diff(np.cumsum(alive)[last], prepend=0)

    # --- texts ----------------------------------------------------------------------------

    def _words(self, text: str) -> list[str]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return self.split(text.lower())

    def _split(self, runs: list[str]) -> list:
        """The words of all runs, special tokens as their ids, each run closed by a line end."""
        out = self._words("\n".join([run for run in runs if not self.special(run)]) + "\n")
        for run in runs:
            if self.special(run):
                done = 0
                for m in self.special_all(run):
                    out += [*self._words(run[done : m.start()]), self.added[m[0]]]
                    done = m.end()
                out += [*self._words(run[done:]), "\n"]
        return out

    def _learn(self, hashes: np.ndarray, runs: list[bytes]) -> None:
        """Encode runs that are not yet known and remember their ids."""
        texts = [run.decode() for run in runs]
        is_special = np.fromiter(map(bool, map(self.special, texts)), dtype=bool, count=len(texts))
        hashes = np.concatenate([hashes[~is_special], hashes[is_special]])
        parts = self._split(texts) if len(hashes) > is_special.sum() else self._split(texts)[1:]
        distinct = {word: i for i, word in enumerate(dict.fromkeys(parts))}
        words = [w for w in distinct if w.__class__ is str and w != "\n"]
        ids, counts = self.merge([w.encode() for w in words])
        length = np.zeros(len(distinct), dtype=np.int64)
        source = np.zeros(len(distinct), dtype=np.int64)
        own = np.fromiter(map(distinct.__getitem__, words), dtype=np.int64, count=len(words))
        length[own], source[own] = counts, np.cumsum(counts) - counts
        extra = [w for w in distinct if w.__class__ is int]
        for i, token in enumerate(extra):
            length[distinct[token]], source[distinct[token]] = 1, len(ids) + i
        ids = np.concatenate([ids, np.array(extra, dtype=np.int32)])
        place = np.fromiter(map(distinct.__getitem__, parts), dtype=np.int64, count=len(parts))
        each = length[place]
        ends = np.cumsum(each)
        flat = ids[np.repeat(source[place] - ends + each, each) + np.arange(ends[-1])]
        stops = ends[place == distinct["\n"]]
        lengths = np.diff(stops, prepend=0)
        first = len(self.known_ids) + stops - lengths
        hashes = np.concatenate([self.known, hashes])
        order = np.argsort(hashes)
        self.known = hashes[order]
        self.known_first = np.concatenate([self.known_first, first])[order]
        self.known_length = np.concatenate([self.known_length, lengths])[order]
        self.known_ids = np.concatenate([self.known_ids, flat])

    def _forget(self) -> None:
        self.known = np.zeros(0, dtype=np.uint64)
        self.known_first = np.zeros(0, dtype=np.int64)
        self.known_length = np.zeros(0, dtype=np.int64)
        self.known_ids = np.zeros(0, dtype=np.int32)

    def encode(self, texts) -> tuple[np.ndarray, Words, np.ndarray]:
        """The ids of all texts one after the other, their runs, and where each text's ids begin.

        `runs.ids` says where each run's ids begin; both have one entry more, the end.  Runs are
        looked up by their 64-bit hashes; a run that is not known yet is encoded first.
        """
        texts = plain_text(texts)
        # A-Z may be lowered first unless a special token, which is matched as it stands, may occur.
        words = Words(texts, lower=not pc.any(pc.match_substring(texts, self.lead)).as_py())
        if len(self.known) > KNOWN_RUNS:
            self._forget()
        distinct, first, place = np.unique(words.hashes, return_index=True, return_inverse=True)
        at = np.searchsorted(self.known, distinct)
        new = np.ones(len(distinct), dtype=bool)
        if len(self.known):
            new = self.known[np.minimum(at, len(self.known) - 1)] != distinct
        if new.any():
            data = memoryview(words.data)
            spans = zip(words.begin[first[new]].tolist(), words.end[first[new]].tolist(), strict=True)
            self._learn(distinct[new], [bytes(data[i:j]) for i, j in spans])
            at = np.searchsorted(self.known, distinct)
        length = self.known_length[at][place] if len(place) else np.zeros(0, np.int64)
        begins = np.append(0, np.cumsum(length))
        source = np.repeat(self.known_first[at][place] - begins[:-1], length) if len(place) else length
        words.ids = begins
        return self.known_ids[source + np.arange(begins[-1])], words, begins[words.starts]


_MODELS: dict[int, Bpe] = {}


def model_of(broadcast) -> Bpe:
    """The broadcast model, built once in each Python worker."""
    key = hash(broadcast.value)
    if key not in _MODELS:
        _MODELS[key] = Bpe(broadcast.value)
    return _MODELS[key]


def share_model(spark: SparkSession, path: str | None = None):
    with open(path or vocabulary_path(), encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids) for every row."""
    shared = share_model(docs.sparkSession, path)

    def run(batches):
        model = model_of(shared)
        for batch in by_bytes(batches):
            ids, begins, borders = model.encode(batch["text"])
            offsets = pa.array(borders.astype(np.int32))
            lists = pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], lists], names=["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, text): tokens joined by one space, as the model has no decoder; null ids give an empty text."""
    shared = share_model(encoded.sparkSession, path)

    def run(batches):
        tokens = model_of(shared).tokens
        for batch in batches:
            texts = [" ".join([tokens[i] for i in ids or ()]) for ids in batch["ids"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encoded and decoded in one pass, kept as digests."""
    shared = share_model(docs.sparkSession, path)

    def run(batches):
        model = model_of(shared)
        decimal, tokens = model.decimal.__getitem__, model.tokens.__getitem__
        for batch in by_bytes(batches):
            flat, _, borders = model.encode(batch["text"])
            counts, ids_sha, text_sha = [], [], []
            for i, j in pairwise(borders.tolist()):
                ids = flat[i:j].tolist()
                counts.append(j - i)
                ids_sha.append(hashlib.sha256(" ".join(map(decimal, ids)).encode()).hexdigest())
                text_sha.append(hashlib.sha256(" ".join(map(tokens, ids)).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(counts, pa.int64()), pa.array(ids_sha), pa.array(text_sha)],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
