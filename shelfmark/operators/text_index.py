"""Block postings and BM25-ranked text search, many queries per job.

Documents are dealt to ranges of about RANGE_DOCS by a hash of their id.  A posting is one term in one range:
the documents that hold it, in the order of their ids, and beside them how often, their lengths, and the places
(field and position) of the term.  With it go the number of documents, the most occurrences in one of them and
the least length, which bound what the term can add to any score in the range.  All blocks of a range hold
the same documents, so a search compares blocks of one range with each other and needs no join by document:
ranges that lack a term of a query are never opened, nor are those whose bound is below the scores found
in the best ranges.

Every range has a block of the empty term, which lists all its documents, those without tokens too.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import as_column, tokens, with_once
from ..plans.shared import materialise
from .joins import spread_join, top_k

# Fixed values of the ranking function.
K1 = 1.2
B = 0.75
LOWEST_IDF = 1e-6

# A unit's score counts in whole points of 1 / POINTS, so that sums do not depend on the order of adding.  Scores
# are ranked by points and given in steps of SHOWN points.
POINTS, SHOWN = 10**12, 10**6
DEFAULT_K = 10

RANGE_DOCS = 64
FIRST_RANGES = 8  # opened before the bound of a query is known
PRUNE_ABOVE = 20_000_000  # hits to score, above which ranges are ruled out by their bounds first
EVERY_DOC = ""  # the term whose blocks list all documents
PLACE_BITS = 32  # a place is the field's number above these bits and the position below
BIN = 3  # characters by which the term dictionary is binned
TASK_BYTES = 1 << 24  # of text that one task indexes
BUCKETS = 16  # at most, if not given
TASK_HITS = 1 << 22  # that one task scores
_BLOCK = T.StructType(
    [
        T.StructField("term", T.StringType()), T.StructField("range", T.LongType()), T.StructField("n", T.IntegerType()),
        T.StructField("n_occurrences", T.LongType()), T.StructField("max_tf", T.IntegerType()),
        T.StructField("min_len", T.IntegerType()), T.StructField("docs", T.ArrayType(T.StringType())),
        T.StructField("tfs", T.ArrayType(T.IntegerType())), T.StructField("lens", T.ArrayType(T.IntegerType())),
        T.StructField("places", T.ArrayType(T.ArrayType(T.LongType()))),
    ]
)


@dataclass(frozen=True)
class TextIndex:
    """Block postings, and the dictionary terms (term, bin, n_docs, n_occurrences) over them."""

    postings: DataFrame
    fields: tuple[str, ...]
    terms: DataFrame
    # Number of term buckets a stored index is parted in; None for one built in the same job.
    buckets: int | None = None

    @property
    def doc_stats(self) -> DataFrame:
        """(doc_id, n_tokens) of every document."""
        every = self.postings.filter(F.col("term") == EVERY_DOC)
        if self.buckets is not None:
            every = every.filter(F.col("bucket") == term_bucket(F.lit(EVERY_DOC), self.buckets))
        return every.select(F.explode(F.arrays_zip("docs", "lens")).alias("d")).select(
            F.col("d.docs").alias("doc_id"), F.col("d.lens").alias("n_tokens")
        )


def _field_columns(fields: Sequence[str] | dict[str, Column]) -> dict[str, Column]:
    if isinstance(fields, dict):
        return {name: as_column(col) for name, col in fields.items()}
    return {name: F.col(name) for name in fields}


def _tokenised(docs: DataFrame, fields: dict[str, Column], id_col: str) -> DataFrame:
    parts = F.array(*[F.struct(F.lit(n).alias("field"), tokens(text).alias("terms")) for n, text in enumerate(fields.values())])
    return docs.select(F.col(id_col).alias("doc_id"), parts.alias("parts"))


def _n_tokens() -> Column:
    return F.aggregate("parts", F.lit(0), lambda n, p: n + F.size(p["terms"]))


def doc_stats(docs: DataFrame, fields, id_col: str = "id") -> DataFrame:
    """Tokens per document over all fields; documents without tokens count too."""
    return _tokenised(docs, _field_columns(fields), id_col).select("doc_id", _n_tokens().alias("n_tokens"))


def occurrences(docs: DataFrame, fields, id_col: str = "id") -> DataFrame:
    """(term, doc_id, field, pos), one row per term occurrence; a map-side explode, no shuffle."""
    # The outer form: a plain explode would tokenise once more to filter empty arrays.
    return (
        _tokenised(docs, _field_columns(fields), id_col)
        .select("doc_id", F.explode_outer("parts").alias("part"))
        .select("doc_id", "part.field", F.posexplode("part.terms").alias("pos", "term"))
    )


def term_stats(places: DataFrame) -> DataFrame:
    """Documents and occurrences per term, counted per (term, doc) first."""
    return (
        places.groupBy("term", "doc_id")
        .agg(F.count("*").alias("tf"))
        .groupBy("term")
        .agg(F.count("*").alias("n_docs"), F.sum("tf").alias("n_occurrences"))
    )


def corpus_stats(stats: DataFrame) -> DataFrame:
    """One row: number of documents, number of tokens, mean length."""
    return stats.agg(
        F.count("*").alias("n_docs"),
        F.coalesce(F.sum("n_tokens"), F.lit(0)).cast("long").alias("n_tokens"),
        F.avg("n_tokens").alias("mean_tokens"),
    )


# --- building -----------------------------------------------------------------------------


def build_postings(docs: DataFrame, fields, range_of: Column, id_col: str, tasks: int) -> DataFrame:
    """Block postings of `docs` dealt to ranges.

    Texts go once to the task of their range, in tasks of about TASK_BYTES of text; there each is tokenised once,
    and the blocks of whole ranges are made batch by batch.  Neither tokens nor places are shuffled or sorted by Spark.
    """
    columns = _field_columns(fields)
    names = [f"_field{n}" for n in range(len(columns))]
    texts = docs.select(
        F.col(id_col).alias("doc_id"), range_of.cast("long").alias("range"),
        *[text.alias(name) for name, text in zip(names, columns.values(), strict=True)],
    ).repartition(tasks, "range").sortWithinPartitions("range", "doc_id")
    rows = texts.select("range", "doc_id", *[tokens(name).alias(name) for name in names])
    ids = T.ArrayType(rows.schema["doc_id"].dataType)
    return rows.mapInArrow(_blocks_of(names), T.StructType([f if f.name != "docs" else T.StructField("docs", ids) for f in _BLOCK]))


def text_bytes(fields: Sequence[str] | dict[str, Column]) -> Column:
    """The size of a document's fields."""
    sizes = [F.coalesce(F.octet_length(text), F.lit(0)).cast("long") for text in _field_columns(fields).values()]
    return reduce(Column.__add__, sizes)


def tasks_for(df: DataFrame, size: int) -> int:
    """Tasks that index texts of so many bytes, at least one a core."""
    return max(df.sparkSession.sparkContext.defaultParallelism, math.ceil(size / TASK_BYTES))


def _whole_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows that come in the order of their range, every range in one table."""
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        ranges = batch["range"].to_numpy()
        last = int(np.searchsorted(ranges, ranges[-1]))
        if kept and (last or kept[-1]["range"][-1].as_py() != ranges[0]):
            first = int(np.searchsorted(ranges, kept[-1]["range"][-1].as_py(), "right"))
            yield pa.Table.from_batches([*kept, batch.slice(0, first)])
            kept, batch, last = [], batch.slice(first), last - first
        if last > 0:
            yield pa.Table.from_batches([batch.slice(0, last)])
        kept.append(batch.slice(max(last, 0)))
    if kept:
        yield pa.Table.from_batches(kept)


def _blocks_of(names: Sequence[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches):
        for rows in _whole_ranges(batches):
            yield _blocks(rows.combine_chunks(), names)

    return run


def _blocks(rows: pa.Table, names: Sequence[str]) -> pa.RecordBatch:
    """The blocks of some ranges, from their documents (range, doc_id, an array of tokens per field) in that order."""
    size = rows.num_rows
    ranges, ids = rows["range"].to_numpy(), rows["doc_id"].combine_chunks()
    codes = ids.dictionary_encode(null_encoding="encode").indices.to_numpy()
    # Rows of the same id are one document.
    doc = np.cumsum(np.append(True, (codes[1:] != codes[:-1]) | (ranges[1:] != ranges[:-1]))) - 1
    lists = [rows[name].combine_chunks() for name in names]
    counts = [x.value_lengths().to_numpy() for x in lists]
    every = pa.array([EVERY_DOC], pa.string())
    term = pa.concat_arrays([every, *[x.flatten().cast(pa.string()) for x in lists]]).dictionary_encode()
    row = np.concatenate([np.repeat(np.arange(size), n) for n in counts])
    place = np.concatenate([
        np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + (field << PLACE_BITS) for field, n in enumerate(counts)
    ])
    # The empty term, which has the first code, stands in every document without a place.
    row, place = np.append(np.arange(size), row), np.append(np.full(size, -1), place)
    code = np.append(np.zeros(size, np.int64), term.indices.to_numpy()[1:].astype(np.int64))
    block = np.cumsum(np.append(False, ranges[1:] != ranges[:-1]))[row] * len(term.dictionary) + code
    key = block * (doc[-1] + 1) + doc[row]
    order = np.lexsort((place, key)) if doc[-1] + 1 < size else np.argsort(key, kind="stable")
    row, place, block, key, code = row[order], place[order], block[order], key[order], code[order]
    posting = np.flatnonzero(np.append(True, key[1:] != key[:-1]))  # where one begins
    head = np.flatnonzero(np.append(True, block[posting][1:] != block[posting][:-1]))  # a block's first posting
    length = np.sum(counts, axis=0)[row]
    tfs, lens = np.diff(np.append(posting, len(row))), np.maximum.reduceat(length, posting)
    here = code[posting[head]]
    inside = np.append(0, np.cumsum(np.add.reduceat((place >= 0).astype(np.int64), posting)))
    offsets = pa.array(np.append(head, len(posting)).astype(np.int32))
    places = pa.ListArray.from_arrays(pa.array(inside.astype(np.int32)), pa.array(place[place >= 0]))
    return pa.RecordBatch.from_arrays(
        [
            term.dictionary.take(pa.array(here)), pa.array(ranges[row[posting[head]]]),
            pa.array(np.diff(np.append(head, len(posting))).astype(np.int32)),
            pa.array(np.add.reduceat(np.where(code[posting] == 0, lens, tfs), head)),
            pa.array(np.maximum.reduceat(tfs, head).astype(np.int32)), pa.array(np.minimum.reduceat(lens, head).astype(np.int32)),
            pa.ListArray.from_arrays(offsets, ids.take(pa.array(row[posting]))),
            pa.ListArray.from_arrays(offsets, pa.array(tfs.astype(np.int32))),
            pa.ListArray.from_arrays(offsets, pa.array(lens.astype(np.int32))), pa.ListArray.from_arrays(offsets, places),
        ],
        names=_BLOCK.names,
    )


def dictionary(postings: DataFrame) -> DataFrame:
    """(term, bin, n_docs, n_occurrences): every term once; a prefix is an interval of terms in few bins."""
    return (
        postings.groupBy("term")
        .agg(F.sum("n").alias("n_docs"), F.sum("n_occurrences").alias("n_occurrences"))
        .select("term", bin_of("term").alias("bin"), "n_docs", "n_occurrences")
    )


def bin_of(term: Column | str) -> Column:
    """The bin of a term in the dictionary: its first characters."""
    return F.substring(term, 1, BIN)


def build_index(docs: DataFrame, fields, id_col: str = "id", range_docs: int = RANGE_DOCS) -> TextIndex:
    """Index `docs` over `fields`: column names, or field name -> text column."""
    size = text_bytes(fields)
    n, total = docs.agg(F.count("*"), F.sum(size)).first()
    ranges = max(1, math.ceil(n / range_docs))
    postings = build_postings(docs, fields, F.pmod(F.xxhash64(id_col), F.lit(ranges)), id_col, tasks_for(docs, total or 0))
    return TextIndex(postings, tuple(_field_columns(fields)), dictionary(postings))


def term_bucket(term: Column | str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def by_bucket(postings: DataFrame, buckets: int) -> DataFrame:
    """Postings as they are stored, with their bucket, sorted by it and by term in each task.

    Nothing is shuffled: a task holds whole ranges, and writes their blocks to the buckets' folders itself.
    """
    dealt = postings.withColumn("bucket", term_bucket("term", buckets))
    return dealt.sortWithinPartitions("bucket", "term", "range")


def write_index(index: TextIndex, path: str, buckets: int | None = None) -> TextIndex:
    """Store an index, its postings parted by term bucket and sorted by term; each task writes a file per bucket."""
    spark = index.postings.sparkSession
    buckets = buckets or min(BUCKETS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = by_bucket(index.postings, buckets)
    rows.write.partitionBy("bucket").parquet(f"{path}/postings")
    postings = spark.read.schema(rows.schema).parquet(f"{path}/postings")
    dictionary(postings).sortWithinPartitions("term").write.parquet(f"{path}/terms")
    about = spark.range(1).select(F.lit(buckets).alias("buckets"), F.array(*map(F.lit, index.fields)).alias("fields"))
    about.write.parquet(f"{path}/about")
    return TextIndex(postings, index.fields, spark.read.parquet(f"{path}/terms"), buckets)


def read_index(spark, path: str) -> TextIndex:
    """An index that `write_index` stored; the number of buckets and the fields come with it."""
    about = spark.read.parquet(f"{path}/about").first()
    postings = spark.read.parquet(f"{path}/postings")
    return TextIndex(postings, tuple(about["fields"]), spark.read.parquet(f"{path}/terms"), about["buckets"])


# --- what a query asks for ----------------------------------------------------------------


def _term_units(queries: DataFrame) -> DataFrame:
    """(qid, term, weight, need): a term named twice counts twice; `need` is the number of terms of the query."""
    units = (
        queries.select("qid", F.explode(tokens("query")).alias("term"))
        .groupBy("qid", "term")
        .agg(F.count("*").alias("weight"))
    )
    return units.withColumn("need", F.count("*").over(Window.partitionBy("qid")))


def _words(queries: DataFrame) -> DataFrame:
    """(qid, term, offset, need): the words of a phrase in their order."""
    words = queries.select("qid", tokens("query").alias("words"))
    return words.select("qid", F.size("words").alias("need"), F.posexplode("words").alias("offset", "term"))


def _located(terms: DataFrame, buckets: int | None) -> DataFrame:
    """With the bucket of each term; of a stored index only those buckets are read, chosen at run time."""
    return terms if buckets is None else terms.withColumn("bucket", term_bucket("term", buckets))


def _on(buckets: int | None) -> list[str]:
    return ["term"] if buckets is None else ["bucket", "term"]


# --- ranking ------------------------------------------------------------------------------


def _idf(n_docs: Column, n: Column) -> Column:
    idf = F.log((n_docs - n + 0.5) / (n + 0.5))
    return F.when(idf <= 0, F.lit(LOWEST_IDF)).otherwise(idf)


def _bm25(idf: Column, tf: Column, doc_len: Column, mean_len: Column) -> Column:
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * doc_len / mean_len))


def _points(score: Column) -> Column:
    return F.floor(score * F.lit(float(POINTS)) + 0.5)


@dataclass(frozen=True)
class _Totals:
    n_docs: Column
    mean_len: Column


def _totals(terms: DataFrame) -> _Totals:
    """Number and mean length of all documents, from the empty term's entry."""
    every = terms.filter(F.col("term") == EVERY_DOC)
    return _Totals(
        every.agg(F.sum("n_docs").cast("double")).scalar(),
        every.agg(F.sum("n_occurrences") / F.sum("n_docs")).scalar(),
    )


# --- blocks -------------------------------------------------------------------------------


def _held(places: Column, numbers: Sequence[int] | None, at_start: bool) -> Column:
    """The places that lie in the fields of these numbers, and at a field's start if asked for."""

    def keep(place: Column) -> Column:
        found = F.lit(True)
        if numbers is not None:
            found &= F.shiftright(place, PLACE_BITS).isin(*numbers) if numbers else F.lit(False)
        if at_start:
            found &= place.bitwiseAND((1 << PLACE_BITS) - 1) == 0
        return found

    return F.filter(places, keep)


def _view(index: TextIndex, wanted: DataFrame, fields: Sequence[str] | None, at_start: bool) -> DataFrame:
    """The wanted terms' blocks, with only the hits that a search counts; blocks without any drop out."""
    if fields is None and not at_start:
        return index.postings
    numbers = None if fields is None else [n for n, name in enumerate(index.fields) if name in fields]
    terms = _located(wanted.select("term").distinct(), index.buckets)
    blocks = spread_join(index.postings, terms, _on(index.buckets), ["range"], "left_semi")
    held = F.transform("places", lambda p: _held(p, numbers, at_start))
    entries = F.filter(F.arrays_zip("docs", "lens", held.alias("places")), lambda e: F.size(e["places"]) > 0)
    named = blocks.withColumn("e", entries).filter(F.size("e") > 0)
    tfs = F.transform("e.places", lambda p: F.size(p))
    return named.select(
        *_on(index.buckets), "range", F.size("e").alias("n"), F.array_max(tfs).alias("max_tf"),
        F.array_min("e.lens").alias("min_len"), F.col("e.docs").alias("docs"), tfs.alias("tfs"),
        F.col("e.lens").alias("lens"), F.col("e.places").alias("places"),
    )


def _ranges(view: DataFrame, asked: DataFrame, on: list[str], totals: _Totals, complete: bool) -> DataFrame:
    """(qid, range, bound): the most that any document of a range can score; reads no arrays.

    With `complete` only ranges that have blocks of all terms of the query.
    """
    heads = view.select(*on, "range", "max_tf", "min_len")
    most = _bm25(F.col("idf"), F.col("max_tf"), F.col("min_len"), totals.mean_len)
    found = spread_join(heads, asked, on, ["range"]).groupBy("qid", "range").agg(
        F.sum(most).alias("bound"), F.count("*").alias("n"), F.max("need").alias("need")
    )
    return (found.filter(F.col("n") == F.col("need")) if complete else found).select("qid", "range", "bound")


def _open(view: DataFrame, asked: DataFrame, chosen: DataFrame, on: list[str]) -> DataFrame:
    """The blocks of the asked terms in the chosen (qid, range)."""
    # Written, so that its size is known: a small one goes to the blocks, which are then not shuffled.
    sought = materialise(spread_join(chosen.select("qid", "range"), asked, ["qid"], ["range"]), "sought")
    # It grows with the ranges.  Beyond a broadcast only blocks of asked terms are shuffled; terms grow with the queries alone.
    blocks = spread_join(view, asked.select(*on).distinct(), on, ["range"], "left_semi")
    return blocks.join(sought, [*on, "range"])


def _by_range(view: DataFrame, asked: DataFrame, on: list[str], hits: int, chosen: DataFrame | None = None) -> DataFrame:
    """The asked terms' blocks beside their queries, in the chosen (qid, range) if given.

    Each block is shuffled once, to its range, whatever the number of queries that ask for it; a range has all blocks of
    its documents, so their scores are summed there.  `hits` to score give the number of tasks.
    """
    tasks = max(view.sparkSession.sparkContext.defaultParallelism, -(-hits // TASK_HITS))
    blocks = view.select(*on, "range", "docs", "tfs", "lens")
    blocks = spread_join(blocks, asked.select(*on).distinct(), on, ["range"], "left_semi").repartition(tasks, "range")
    if chosen is None:
        return blocks.join(asked, on)
    # Both sides lie by range, so that neither is shuffled again.
    open_to = chosen.select("range", "qid").repartition(tasks, "range").groupBy("range").agg(F.collect_set("qid").alias("open"))
    return blocks.join(open_to, "range").join(asked, on).filter(F.array_contains("open", F.col("qid"))).drop("open")


def _any_scores(opened: DataFrame, totals: _Totals) -> DataFrame:
    """(qid, doc_id, points) of all documents in opened blocks; a document lies in one range."""
    hits = opened.select("range", "qid", "idf", F.explode(F.arrays_zip("docs", "tfs", "lens")).alias("d"))
    score = _bm25(F.col("idf"), F.col("d.tfs"), F.col("d.lens"), totals.mean_len)
    sums = hits.groupBy("range", "qid", F.col("d.docs").alias("doc_id")).agg(F.sum(_points(score)).alias("points"))
    return sums.select("qid", "doc_id", "points")


def _side_by_side(opened: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(qid, doc_id, h): documents that hold all terms, with what each block says of them (columns in the singular).

    Blocks of one query and range, bounded by the range, are compared by their document lists.
    """
    # Dealt as rows: lists begun before the shuffle would hold a block or two each and be three times as large.
    dealt = opened.repartition("qid", "range")
    blocks = dealt.groupBy("qid", "range").agg(F.collect_list(F.struct(*columns)).alias("b"), F.max("need").alias("need"))
    both = F.aggregate(
        F.slice("b", F.lit(2), F.size("b")), F.get("b", F.lit(0))["docs"], lambda docs, x: F.array_intersect(docs, x["docs"])
    )
    shared = blocks.filter(F.size("b") == F.col("need")).withColumn("shared", both).filter(F.size("shared") > 0)
    rows = shared.select("qid", "b", F.explode("shared").alias("doc_id"))
    lists = {"tfs": "tf", "lens": "len", "places": "places"}

    def own(x: Column) -> Column:
        at = (F.array_position(x["docs"], F.col("doc_id")) - 1).cast("int")
        return F.struct(*[
            F.get(x[c], at).alias(lists[c]) if c in lists else x[c].alias(c) for c in columns if c != "docs"
        ])

    return with_once(rows, "h", F.transform("b", own)).select("qid", "doc_id", "h")


def _scored(held: DataFrame, totals: _Totals) -> DataFrame:
    """(qid, doc_id, points): the sum over the hits `h` of a document."""
    # A column, as the functions of an array's elements take no subquery.
    mean = F.col("mean_len")
    points = F.aggregate(
        "h", F.lit(0).cast("long"), lambda total, h: total + _points(_bm25(h["idf"], h["tf"], h["len"], mean))
    )
    return held.withColumn("mean_len", totals.mean_len).select("qid", "doc_id", points.alias("points"))


def _all_scores(opened: DataFrame, totals: _Totals) -> DataFrame:
    """(qid, doc_id, points) of the documents that hold all terms."""
    return _scored(_side_by_side(opened, ("idf", "docs", "tfs", "lens")), totals)


def close_stretches(events: Column, need: Column, span: int) -> Column:
    """Stretches (lo, hi) of places in close groups, from events (place, unit) in order of place.

    One pass keeps the last place of every unit.  When all lie within `span`, from s to p, every hit from p - span to
    s + span is in a group; such stretches come in order, and those that overlap become one.
    """
    state = F.struct(
        F.array_repeat(F.lit(None).cast("long"), need).alias("last"),
        F.array().cast("array<struct<lo:bigint,hi:bigint>>").alias("found"),
    )

    def seen(acc: Column, event: Column) -> Column:
        last = F.transform(acc["last"], lambda p, i: F.when(i == event["unit"], event["place"]).otherwise(p))
        first = F.array_min(last)
        close = ~F.exists(last, lambda p: p.isNull()) & (event["place"] - first <= span)
        new = F.struct((event["place"] - span).alias("lo"), (first + span).alias("hi"))
        before = F.get(acc["found"], F.size(acc["found"]) - 1)
        joins = before.isNotNull() & (before["hi"] >= new["lo"])
        merged = F.array_append(
            F.slice(acc["found"], F.lit(1), F.greatest(F.size(acc["found"]) - 1, F.lit(0))),
            F.struct(before["lo"].alias("lo"), new["hi"].alias("hi")),
        )
        found = F.when(~close, acc["found"]).when(joins, merged).otherwise(F.array_append(acc["found"], new))
        return F.struct(last.alias("last"), found.alias("found"))

    return F.aggregate(events, state, seen)["found"]


def _near_scores(distance: int) -> Callable[[DataFrame, _Totals], DataFrame]:
    """Scores of documents where all terms stand with at most `distance` tokens between; only hits in such groups count."""

    def scores(opened: DataFrame, totals: _Totals) -> DataFrame:
        held = _side_by_side(opened, ("idf", "docs", "lens", "places"))
        # Every group has a hit of the document's rarest term, and lies within the span of it.
        fewest = F.array_min(F.transform("h", lambda x: F.size(x["places"])))
        held = with_once(held, "fewest", F.filter("h", lambda x: F.size(x["places"]) == fewest)[0]["places"])
        span = distance + 1

        def around(x: Column) -> Column:
            return F.filter(x["places"], lambda p: F.exists("fewest", lambda r: F.abs(p - r) <= span))

        near = F.transform("h", lambda x: F.struct(x["idf"].alias("idf"), x["len"].alias("len"), around(x).alias("places")))
        held = with_once(held.select("qid", "doc_id", "h", "fewest"), "near", near).select("qid", "doc_id", F.col("near").alias("h"))
        held = held.filter(~F.exists("h", lambda x: F.size(x["places"]) == 0))
        events = F.sort_array(F.flatten(F.transform(
            "h", lambda x, u: F.transform(x["places"], lambda p: F.struct(p.alias("place"), u.alias("unit")))
        )))
        rows = with_once(held, "stretches", close_stretches(events, F.size("h"), span))
        rows = rows.filter(F.size("stretches") > 0)

        def counted(x: Column) -> Column:
            inside = F.filter(x["places"], lambda p: F.exists("stretches", lambda s: (p >= s["lo"]) & (p <= s["hi"])))
            return F.struct(x["idf"].alias("idf"), F.size(inside).alias("tf"), x["len"].alias("len"))

        return _scored(rows.select("qid", "doc_id", F.transform("h", counted).alias("h")), totals)

    return scores


# --- searching ----------------------------------------------------------------------------


def _best(scored: DataFrame, queries: DataFrame, k: int, limit_col: str | None) -> DataFrame:
    """(qid, doc_id, points, rank) of the best documents of every query."""
    order = [F.col("points").desc(), F.col("doc_id")]
    if limit_col is not None:
        # Cut at the largest limit first, which Spark does before the shuffle.
        k = queries.agg(F.max(limit_col)).first()[0] or 0
    best = top_k(scored, ["qid"], order, k, ["doc_id"])
    if limit_col is not None:
        best = best.join(queries.select("qid", limit_col), "qid").filter(F.col("rank") <= F.col(limit_col))
    return best.select("qid", "doc_id", "points", "rank")


def open_ranges(ranges: DataFrame, first: DataFrame, best: DataFrame, queries: DataFrame, k: int, limit_col: str | None) -> DataFrame:
    """Ranges (qid, range) that may hold a document better than the `k` best of the first ranges."""
    limit = F.lit(k) if limit_col is None else F.col(limit_col)
    limits = queries.select("qid", limit.alias("k"))
    floor = best.join(limits, "qid").filter(F.col("rank") == F.col("k")).select("qid", F.col("points").alias("floor"))
    rest = ranges.join(first.select("qid", "range"), ["qid", "range"], "left_anti").join(floor, "qid", "left")
    # Bounds are sums of doubles, scores of rounded points; the margin is above both errors.
    reached = F.col("bound") >= F.col("floor") / float(POINTS) - 1e-9
    return rest.filter(F.col("floor").isNull() | reached).select("qid", "range")


def _block_search(
    index: TextIndex, queries: DataFrame, asked: DataFrame, view: DataFrame, totals: _Totals, complete: bool,
    scores: Callable[[DataFrame, _Totals], DataFrame], k: int, limit_col: str | None, barred: DataFrame | None,
    prune_above: int,
) -> DataFrame:
    """The best documents.  Of many, first those of the best ranges, then of all others that these do not rule out."""
    on = _on(index.buckets)

    def allowed(scored: DataFrame) -> DataFrame:
        return scored if barred is None else scored.join(barred, ["qid", "doc_id"], "left_anti")

    hits = 0 if complete else asked.agg(F.sum("n")).first()[0] or 0
    if not complete and hits <= prune_above:
        return _best(allowed(scores(_by_range(view, asked, on, hits), totals)), queries, k, limit_col)
    ranges = materialise(_ranges(view, asked, on, totals, complete), "ranges")
    if complete and ranges.count() * RANGE_DOCS <= prune_above:
        return _best(allowed(scores(_open(view, asked, ranges, on), totals)), queries, k, limit_col)

    order = [F.col("bound").desc(), F.col("range")]
    first = materialise(top_k(ranges, ["qid"], order, FIRST_RANGES, ["range"]).select("qid", "range"), "first-ranges")
    best = allowed(scores(_open(view, asked, first, on), totals))
    best = materialise(_best(best, queries, k, limit_col), "first-best")
    rest = materialise(open_ranges(ranges, first, best, queries, k, limit_col), "open-ranges")
    if rest.isEmpty():
        return best
    others = _open(view, asked, rest, on) if complete else _by_range(view, asked, on, hits, rest)
    others = allowed(scores(others, totals))
    return _best(best.select("qid", "doc_id", "points").union(others), queries, k, limit_col)


def _phrase_hits(index: TextIndex, words: DataFrame, view: DataFrame, at_start: bool) -> DataFrame:
    """(qid, doc_id, tf, len) of documents with the whole phrase of a qid, from words (qid, term, offset, need)."""
    on = _on(index.buckets)
    heads = view.select(*on, "range")
    ranges = spread_join(heads, words, on, ["range"]).groupBy("qid", "range").agg(
        F.count("*").alias("n"), F.max("need").alias("need")
    )
    chosen = materialise(ranges.filter("n = need"), "ranges")
    held = _side_by_side(_open(view, words, chosen, on), ("offset", "docs", "lens", "places"))
    starts = F.aggregate(
        F.slice("h", F.lit(2), F.size("h")), _starts(F.get("h", F.lit(0))), lambda s, x: F.array_intersect(s, _starts(x))
    )
    if at_start:
        starts = _held(starts, None, True)
    hits = held.select("qid", "doc_id", F.size(starts).alias("tf"), F.get("h", F.lit(0))["len"].alias("len"))
    return materialise(hits.filter("tf > 0"), "phrase-hits")


def _phrase_scores(hits: DataFrame, totals: _Totals) -> DataFrame:
    """(qid, doc_id, points) of phrase hits; the phrase is the unit that is scored."""
    n = hits.groupBy("qid").agg(F.count("*").alias("n")).withColumn("idf", _idf(totals.n_docs, F.col("n")))
    score = _bm25(F.col("idf"), F.col("tf"), F.col("len"), totals.mean_len)
    return spread_join(hits, n, ["qid"], ["doc_id"]).select("qid", "doc_id", _points(score).alias("points"))


def _starts(word: Column) -> Column:
    """Where a phrase would start for each place of one of its words."""
    return F.transform(word["places"], lambda p: p - word["offset"])


def _prefix_bins(index: TextIndex, prefixes: DataFrame) -> DataFrame:
    """(prefix, bin): where terms that begin with one of the prefixes are.  A long prefix has one bin, a short one those bins that begin with it."""
    wanted = prefixes.select("prefix").filter("prefix != ''").distinct()
    terms = index.terms.filter(F.col("term") != EVERY_DOC)
    short = [F.substring("bin", 1, n) for n in range(1, BIN)]
    bins = terms.select("bin").distinct().select("bin", F.explode(F.array_distinct(F.array(*short))).alias("prefix"))
    return (
        wanted.filter(F.length("prefix") >= BIN).select("prefix", bin_of("prefix").alias("bin"))
        .unionByName(bins.join(wanted, "prefix").select("prefix", "bin"))
    )


def _begins() -> Column:
    """Whether a term lies in the interval from the prefix itself to itself with the highest character behind it."""
    return (F.col("term") >= F.col("prefix")) & (F.col("term") < F.concat("prefix", F.lit(chr(0x10FFFF))))


def prefix_terms(index: TextIndex, prefixes: DataFrame) -> DataFrame:
    """(prefix, term) of all terms that begin with one of the prefixes, from the dictionary alone.

    A prefix is an interval of terms, which are binned by their first characters.
    """
    terms = index.terms.filter(F.col("term") != EVERY_DOC).select("bin", "term")
    return spread_join(terms, _prefix_bins(index, prefixes), ["bin"], ["term"]).filter(_begins()).select("prefix", "term")


def _prefix_scores(index: TextIndex, units: DataFrame, view: DataFrame, totals: _Totals) -> DataFrame:
    """(qid, doc_id, points) of documents that hold a term of every prefix; a prefix is the unit that is scored."""
    # The terms found may be many, their bins are few: blocks meet the prefixes by bin and are not shuffled by term.
    bins = materialise(_prefix_bins(index, units.select(F.col("term").alias("prefix"))), "prefix-bins")
    blocks = view.select("term", bin_of("term").alias("bin"), "range", "docs", "tfs", "lens")
    hits = (
        spread_join(blocks, bins, ["bin"], ["range"]).filter(_begins())
        .select("prefix", F.explode(F.arrays_zip("docs", "tfs", "lens")).alias("d"))
        .groupBy("prefix", F.col("d.docs").alias("doc_id"))
        .agg(F.sum("d.tfs").alias("tf"), F.max("d.lens").alias("len"))
    )
    hits = materialise(hits, "prefix-hits")
    counts = hits.groupBy("prefix").agg(F.count("*").alias("n"))
    asked = units.withColumnRenamed("term", "prefix").join(counts, "prefix")
    asked = asked.withColumn("found", F.count("*").over(Window.partitionBy("qid"))).filter("found = need")
    asked = materialise(asked.withColumn("idf", F.col("weight") * _idf(totals.n_docs, F.col("n"))), "prefixes")
    # Candidates come from a query's rarest prefix, so the work follows that one and not the frequent ones.
    rarest = asked.groupBy("qid").agg(F.min_by("prefix", F.struct("n", "prefix")).alias("prefix"))
    candidates = spread_join(hits, rarest, ["prefix"], ["doc_id"]).select("qid", "doc_id")
    score = _points(_bm25(F.col("idf"), F.col("tf"), F.col("len"), totals.mean_len))
    scored = spread_join(candidates, asked, ["qid"], ["doc_id"]).join(hits, ["prefix", "doc_id"]).groupBy("qid", "doc_id").agg(
        F.sum(score).alias("points"), F.count("*").alias("n"), F.max("need").alias("need")
    )
    return scored.filter("n = need").select("qid", "doc_id", "points")


def _barred(queries: DataFrame, index: TextIndex) -> DataFrame:
    """(qid, doc_id) of the documents that hold a term the query excludes."""
    terms = _located(queries.select("qid", F.explode(tokens("exclude")).alias("term")).distinct(), index.buckets)
    on = _on(index.buckets)
    blocks = spread_join(index.postings.select(*on, "range", "docs"), terms, on, ["range"])
    return blocks.select("qid", F.explode("docs").alias("doc_id"))


def search(
    queries: DataFrame,
    index: TextIndex,
    k: int = DEFAULT_K,
    mode: str = "all",
    fields: Sequence[str] | None = None,
    near: int | None = None,
    at_start: bool = False,
    limit_col: str | None = None,
    prune_above: int = PRUNE_ABOVE,
) -> DataFrame:
    """Rank documents for a table of queries (qid, query[, exclude]).

    mode: "all" terms, "any" term, "phrase" (the whole query in a row) or "prefix" (every term is
    a prefix, all needed).  `near` asks for all terms with at most that many tokens between,
    `fields` keeps hits in those fields only, `at_start` hits on the first token of a field, and
    an `exclude` column names terms a document must not hold.  Query text is tokenised like the
    documents; a query without terms has no hits.  Of queries with the same qid one counts.  Returns qid,
    doc_id, score, rank; scores equal to 12 digits are ties, which go to the lower id.  A search of more than
    `prune_above` hits rules out ranges by their bounds; the result is the same.
    """
    queries = queries.dropDuplicates(["qid"])
    if mode not in ("all", "any", "phrase", "prefix"):
        raise ValueError(f"unknown mode {mode!r}")
    if near is not None and mode != "all":
        raise ValueError("near needs mode 'all'")
    totals = _totals(index.terms)
    barred = _barred(queries, index) if "exclude" in queries.columns else None
    if mode in ("phrase", "prefix"):
        if mode == "phrase":
            words = materialise(_located(_words(queries), index.buckets), "words")
            scored = _phrase_scores(_phrase_hits(index, words, _view(index, words, fields, False), at_start), totals)
        else:
            units = materialise(_term_units(queries), "prefix-units")
            found = prefix_terms(index, units.select(F.col("term").alias("prefix")))
            scored = _prefix_scores(index, units, _view(index, found, fields, at_start), totals)
        if barred is not None:
            scored = scored.join(barred, ["qid", "doc_id"], "left_anti")
        best = _best(scored, queries, k, limit_col)
    else:
        # Written, so that its size is known: a small one goes to the dictionary, which is then not shuffled.
        units = materialise(_located(_term_units(queries), index.buckets), "units")
        view = _view(index, units, fields, at_start)
        plain = fields is None and not at_start
        counts = index.terms.select("term", F.col("n_docs").alias("n")) if plain else view.groupBy("term").agg(F.sum("n").alias("n"))
        asked = units.join(counts, "term").withColumn("idf", F.col("weight") * _idf(totals.n_docs, F.col("n")))
        asked = materialise(asked, "asked")
        complete = mode == "all"
        scores = _any_scores if not complete else _all_scores if near is None else _near_scores(near)
        best = _block_search(index, queries, asked, view, totals, complete, scores, k, limit_col, barred, prune_above)
    return _shown(best)


def _shown(best: DataFrame) -> DataFrame:
    """The result's columns, with the score to as many digits as it is shown with."""
    score = F.floor((F.col("points") + SHOWN // 2) / SHOWN) / float(POINTS // SHOWN)
    return best.select("qid", "doc_id", score.alias("score"), "rank")


def _of_phrases(queries: DataFrame, column: str, index: TextIndex) -> DataFrame:
    """(qid, no, doc_id, tf, len): hits of each query's phrases, an array column; one without terms is none."""
    phrases = queries.select("qid", F.posexplode(column).alias("no", "query")).select(F.struct("qid", "no").alias("qid"), "query")
    words = materialise(_located(_words(phrases), index.buckets), "words")
    return _phrase_hits(index, words, index.postings, False)


def match(queries: DataFrame, index: TextIndex, k: int = DEFAULT_K, limit_col: str | None = None) -> DataFrame:
    """Rank documents for queries that combine units of several kinds.

    Columns, each of them optional and null where a query has none: `query` (text, all terms), `prefix` (text, a prefix
    per term), `phrases` (array of texts), and what a document must not hold: `exclude` (text, any of its terms),
    `exclude_phrases` (array of texts).  A document must hold all units, and its score sums theirs; texts
    without terms ask for nothing, and a query that asks for no unit at all has no hits.  Returns what `search` does.
    """
    queries = queries.dropDuplicates(["qid"])
    totals, parts = _totals(index.terms), []
    if "query" in queries.columns:
        asked = materialise(_located(_term_units(queries), index.buckets), "units")
        asked = asked.join(index.terms.select("term", F.col("n_docs").alias("n")), "term")
        asked = materialise(asked.withColumn("idf", F.col("weight") * _idf(totals.n_docs, F.col("n"))), "asked")
        on = _on(index.buckets)
        ranges = materialise(_ranges(index.postings, asked, on, totals, True), "ranges")
        parts.append(_all_scores(_open(index.postings, asked, ranges, on), totals))
    if "prefix" in queries.columns:
        units = _term_units(queries.select("qid", F.col("prefix").alias("query")))
        parts.append(_prefix_scores(index, materialise(units, "prefix-units"), index.postings, totals))
    if "phrases" in queries.columns:
        scored = _phrase_scores(_of_phrases(queries, "phrases", index), totals)
        parts.append(scored.select("qid.qid", "doc_id", "points"))
    every = reduce(DataFrame.union, parts)

    def asks(column: str) -> Column:
        return (F.size(tokens(column)) > 0).cast("int") if column in queries.columns else F.lit(0)

    phrases = F.lit(0)
    if "phrases" in queries.columns:
        phrases = F.size(F.filter(F.coalesce("phrases", F.array().cast("array<string>")), lambda p: F.size(tokens(p)) > 0))
    need = queries.select("qid", (asks("query") + asks("prefix") + phrases).alias("need"))
    whole = every.groupBy("qid", "doc_id").agg(F.sum("points").alias("points"), F.count("*").alias("n"))
    scored = whole.join(need, "qid").filter("n = need").select("qid", "doc_id", "points")
    if "exclude" in queries.columns:
        scored = scored.join(_barred(queries, index), ["qid", "doc_id"], "left_anti")
    if "exclude_phrases" in queries.columns:
        barred = _of_phrases(queries, "exclude_phrases", index).select("qid.qid", "doc_id")
        scored = scored.join(barred, ["qid", "doc_id"], "left_anti")
    return _shown(_best(scored, queries, k, limit_col))


def search_entities(hits: DataFrame, entities: DataFrame, id_col: str = "id") -> DataFrame:
    """Put the stored row beside every hit; hits whose row is gone drop out."""
    return hits.join(entities, hits["doc_id"] == entities[id_col]).drop("doc_id")
