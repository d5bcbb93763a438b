"""Repeated passages by seed and extend on winnowed anchors.

A passage repeats if at least `length` words in a row (20) stand elsewhere too.  Seeds are the anchors
of winnowing: of every window of `length` words the least hash of its `SEED`-word runs (the last of
equals).  The choice depends on the window's words alone, so equal windows share the seed and its
place.  All windows of one anchor form its span, at most 32 words.

1. Seeds that occur once are dropped (counts are summed on the map side, rows joined back).
2. Occurrences are extended both ways: equal span, equal windows.  All but the first occurrence of a
   span are repeats as a whole; so are those with an equal earlier span in the same Arrow batch, which
   never leave the task.
3. Where a seed has several spans, the spans' first occurrences are extended window by window, and a
   window that also starts earlier is a repeat.

Words of repeats are removed; repeats that touch or overlap join to maximal ones.  Spans are compared
by 128 bits of hashes, windows by 128 as well.  The input is written once with a number for every row, by
which spans and passages find their text.  Earlier is: smaller doc_id (null last), of the same doc_id the smaller
number, and in a row the earlier start.  Null, empty and short texts have no windows and stay as they are; an empty
table gives an empty result; other columns pass unchanged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import Words, by_bytes, mix, table, windows_hash, written

LENGTH = 20
SEED = 8
NO_ID = np.iinfo(np.int64).max
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """For every run of `width` values the place of the least, the last of equals."""
    place = np.arange(len(values))
    done = 1
    while done < width:
        step = min(done, width - done)
        left, right = place[:-step], place[step:]
        place = np.where(values[right] <= values[left], right, left)
        done += step
    return place


def _doc_ids(column) -> np.ndarray:
    return column.fill_null(NO_ID).to_numpy(zero_copy_only=False)


def _spans(words: Words, length: int) -> dict[str, np.ndarray]:
    """The spans of a batch: row, first window's start in the text, windows, seed and span hash."""
    n = len(words.hashes) - length + 1
    if n <= 0:
        return {}
    seeds = windows_hash(words.hashes, SEED)
    anchor = _least(seeds, length - SEED + 1)
    windows = windows_hash(words.hashes, length)
    row = np.repeat(np.arange(len(words.starts) - 1), words.counts())[:n]
    inside = np.arange(n) + length <= words.starts[row + 1]
    place = np.flatnonzero(inside)
    if not len(place):
        return {}
    new = np.append(True, (anchor[place[1:]] != anchor[place[:-1]]) | (row[place[1:]] != row[place[:-1]]))
    first = place[new]
    count = np.diff(np.append(np.flatnonzero(new), len(place)))
    last = first + count - 1
    at = anchor[first]
    span = mix(
        windows[first] * _FACTORS[0]
        + windows[last] * _FACTORS[1]
        + ((at - first) * 64 + count).astype(np.uint64) * _FACTORS[2]
    )
    return {
        "row": row[first],
        "start": first - words.starts[row[first]],
        "windows": count,
        "seed": seeds[at].view(np.int64),
        "span": span.view(np.int64),
    }


def _occurrences(docs: DataFrame, length: int) -> DataFrame:
    def run(batches):
        for batch in by_bytes(batches):
            s = _spans(Words(batch["text"]), length)
            if not s:
                continue
            doc = _doc_ids(batch["doc_id"])[s["row"]]
            row = batch["__llm_row"].to_numpy(zero_copy_only=False)[s["row"]]
            order = np.lexsort((s["start"], row, doc, s["span"], s["seed"]))
            seed, span = s["seed"][order], s["span"][order]
            repeated = np.zeros(len(order), dtype=bool)
            repeated[order[1:]] = (seed[1:] == seed[:-1]) & (span[1:] == span[:-1])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(s["seed"]),
                    pa.array(s["span"]),
                    pa.array(doc),
                    pa.array(row),
                    pa.array(s["start"].astype(np.int32)),
                    pa.array(s["windows"].astype(np.int8)),
                    pa.array(repeated),
                ],
                names=["seed", "span", "doc", "row", "start", "windows", "repeated"],
            )

    schema = "seed long, span long, doc long, row long, start int, windows byte, repeated boolean"
    return docs.select("doc_id", "text", "__llm_row").mapInArrow(run, schema)


def _list_numbers(column) -> tuple[np.ndarray, pa.Array]:
    """For a list column: the row of each entry, and the entries."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = np.diff(column.offsets.to_numpy())
    lengths = np.where(column.is_null().to_numpy(zero_copy_only=False), 0, lengths)
    return np.repeat(np.arange(len(column)), lengths), column.flatten()


def _open_windows(docs: DataFrame, length: int) -> DataFrame:
    """The windows of the listed spans: (seed, window, doc, row, start)."""

    def run(batches):
        for batch in by_bytes(batches):
            words = Words(batch["text"])
            windows = windows_hash(words.hashes, length)
            row, spans = _list_numbers(batch["spans"])
            start = spans.field("start").to_numpy(zero_copy_only=False).astype(np.int64)
            count = spans.field("windows").to_numpy(zero_copy_only=False).astype(np.int64)
            each = np.repeat(np.arange(len(row)), count)
            begin = start[each] + np.arange(len(each)) - np.repeat(np.cumsum(count) - count, count)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(spans.field("seed").to_numpy(zero_copy_only=False)[each]),
                    pa.array(windows[words.starts[row[each]] + begin].view(np.int64)),
                    pa.array(_doc_ids(batch["doc_id"])[row[each]]),
                    pa.array(batch["__llm_row"].to_numpy(zero_copy_only=False)[row[each]]),
                    pa.array(begin.astype(np.int32)),
                ],
                names=["seed", "window", "doc", "row", "start"],
            )

    return docs.mapInArrow(run, "seed long, window long, doc long, row long, start int")


def numbered(docs: DataFrame) -> DataFrame:
    """The documents, written with a number `__llm_row` for every row."""
    return written(docs.withColumn("__llm_row", F.monotonically_increasing_id()), "numbered")


def repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(row, start, words) of the repeated passages of numbered documents; they may overlap."""
    all_spans = written(_occurrences(docs, length), "spans")
    firsts = all_spans.where("not repeated").drop("repeated")
    often = firsts.groupBy("seed").agg(F.count("*").alias("n")).where("n > 1").select("seed")
    seeded = written(firsts.join(often, "seed"), "seeded")
    place = F.struct("doc", "row", "start")
    classes = seeded.groupBy("seed", "span").agg(
        F.min(F.struct("doc", "row", "start", "windows")).alias("first"), F.count("*").alias("n")
    )
    classes = written(classes, "span-classes")
    later = (
        seeded.join(classes.where("n > 1").select("seed", "span", "first"), ["seed", "span"])
        .where(place != F.struct("first.doc", "first.row", "first.start"))
        .select("row", "start", "windows")
    )
    mixed = classes.groupBy("seed").agg(F.count("*").alias("n")).where("n > 1").select("seed")
    open_spans = (
        classes.join(mixed, "seed")
        .select("seed", "first.*")
        .groupBy(F.col("row").alias("__llm_row"))
        .agg(F.collect_list(F.struct("start", "windows", "seed")).alias("spans"))
    )
    texts = docs.select("doc_id", "text", "__llm_row").join(written(open_spans, "open-spans"), "__llm_row")
    windows = written(_open_windows(texts, length), "open-windows")
    earliest = (
        windows.groupBy("seed", "window")
        .agg(F.min(place).alias("first"), F.max(place).alias("last"))
        .where("first != last")
        .select("seed", "window", "first")
    )
    single = (
        windows.join(earliest, ["seed", "window"])
        .where(place != F.col("first"))
        .select("row", "start", F.lit(1).cast("byte").alias("windows"))
    )
    found = all_spans.where("repeated").select("row", "start", "windows").union(later).union(single)
    return found.select("row", "start", (F.col("windows") + (length - 1)).alias("words"))


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """The documents with `__llm_kept` (the words that stay, joined by one space), `__llm_words` and `__llm_removed`."""
    rows = numbered(docs)
    per_row = repeats(rows, length).groupBy(F.col("row").alias("__llm_row")).agg(
        F.collect_list(F.col("start").cast("long") * 64 + F.col("words")).alias("__llm_passages")
    )
    joined = rows.join(written(per_row, "passages"), "__llm_row", "left")
    joined = joined.select(*[f"`{c}`" for c in docs.columns], "__llm_passages")
    names = docs.columns

    def run(batches):
        for batch in by_bytes(batches):
            words = Words(batch["text"])
            row, passages = _list_numbers(batch["__llm_passages"])
            passages = passages.to_numpy(zero_copy_only=False).astype(np.int64)
            begin = words.starts[row] + passages // 64
            change = np.zeros(len(words.hashes) + 1, dtype=np.int32)
            np.add.at(change, begin, 1)
            np.add.at(change, begin + passages % 64, -1)
            stay = np.cumsum(change[:-1]) == 0
            kept_count = np.append(0, np.cumsum(stay))[words.starts]
            counts = words.counts()
            removed = counts - np.diff(kept_count)
            kept = _joined(words, stay)
            yield pa.RecordBatch.from_arrays(
                [batch[c] for c in names] + [kept, pa.array(counts), pa.array(removed)],
                names=[*names, "__llm_kept", "__llm_words", "__llm_removed"],
            )

    extra = [StructField("__llm_kept", StringType()), StructField("__llm_words", LongType()), StructField("__llm_removed", LongType())]
    schema = StructType([*docs.schema, *extra])
    return joined.mapInArrow(run, schema)


def _joined(words: Words, stay: np.ndarray) -> pa.Array:
    """Per text the words that stay, joined by one space."""
    begin, end = words.begin[stay], words.end[stay]
    lengths = end - begin + 1  # with a space after each
    total = int(lengths.sum())
    stops = np.cumsum(lengths)
    out = np.full(total, 32, dtype=np.uint8)
    size = lengths - 1
    into = np.repeat(stops - lengths - np.cumsum(size) + size, size) + np.arange(size.sum())
    out[into] = words.data[np.repeat(begin - np.cumsum(size) + size, size) + np.arange(size.sum())]
    borders = np.append(0, np.cumsum(stay))[words.starts]
    edges = np.append(0, stops)[borders]
    texts = pa.LargeStringArray.from_buffers(len(edges) - 1, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(out))
    return pc.ascii_rtrim(texts, " ").cast(pa.string())


def drop_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """The documents without repeated passages; texts without any stay as they are.

    A text that lost words has the others joined by one space; n_chars follows, if there is one.
    """
    done = remove_repeats(docs, length)
    text = F.when(F.col("__llm_removed") > 0, F.col("__llm_kept")).otherwise(F.col("text"))
    out = done.withColumn("text", text)
    if "n_chars" in docs.columns:
        n_chars = F.when(F.col("__llm_removed") > 0, F.length("text")).otherwise(F.col("n_chars"))
        out = out.withColumn("n_chars", n_chars.cast(docs.schema["n_chars"].dataType))
    return out.select(*[f"`{c}`" for c in docs.columns])


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id",
        F.col("__llm_words").alias("n_words"),
        F.col("__llm_removed").alias("n_removed"),
        F.sha2("__llm_kept", 256).alias("kept_sha256"),
    )
