"""Similarity join on word shingles with PartEnum signatures, and the classes its links form.

Two sets of sizes r and s with similarity `of` / 100 or more differ in at most
h = (r + s) (100 - of) / (100 + of) features.  Sizes are parted into bands that each reach as far as a
set of their least size can match; a set joins the band it lies in and the next, so every pair that may
match meets in the band of its larger set.  There the feature domain is parted into n1 groups of n2 parts.
Of a pair that matches, some group differs in at most k2 of its parts, so among the subsets of n2 - k2
parts of that group one is equal in both: its features' hash is the shared signature.  Large sets take
n2 = 1 and k2 = 0, small ones n2 = 3 and k2 = 1, which keeps enough features in a signature.

A signature without features is left out where it is not needed: a set with e groups that have an empty
subset agrees with any match in at least g groups, and if e < g one of them is not empty.  Only sets with
e >= g give their empty signatures too.  So no link is lost.

Members of a signature's bucket meet its first (counts and minima are summed on the map side; within an Arrow batch
before any shuffle).  Most sets that meet are not alike.  So each has a sketch, of about one bit a feature: whether an odd
number of its features fall on the bit.  Two sets differ in as many features as their sketches in bits, or more, so pairs
whose sketches differ too much have no link, and only others are compared on the whole sets: first each set with the least
of the firsts it may link with.  All that meet one first are a group, which holds every bucket with that first.  The
sketches of groups that are then not all in one component are compared with each other; sets that may link, and
those they may link with in turn, are a cluster, and all sets of a cluster are compared.  Both is done in cells of two
blocks of bounded features and sets each, whole sets by products of incidence matrices, and only a forest of what was found leaves
the task.  So hot groups of near copies never give all pairs.  Equal sets are one class from the start.

Words are lower-cased (A-Z) runs without white space; a text shorter than a shingle is one shingle, one without
words has no set and links with nothing.  Null counts as empty.  Rows are numbered and each has a set of its own,
also rows that share a doc_id or have none; a component is named by the smallest doc_id in it, null if none has one.
Features are 48-bit hashes.  An empty table gives an empty result; extra columns do no harm.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, by_bytes, forest, grouped, mix, scratch, table, windows_hash, written
from .components import components, roots

_ROW = np.uint64(48)
_FEATURE = np.uint64((1 << 48) - 1)
_KEY = ~np.uint64(0xFFFF)  # 48 bits of a signature; pairs that meet by chance are compared like all others
_SALT = np.array([0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165], dtype=np.uint64)
SMALL = 8
BLOCK_ITEMS, BLOCK_SETS, COLUMNS = 1 << 18, 1024, 2048
BYTES = 6  # that hold a feature
WORD = 64  # bits; a sketch has so many at least
SKETCH_BLOCKS = 4  # blocks of sets whose sketches are one block
NEAR_WORDS = 1 << 20  # of sketches that are compared at a time
BATCH = 1 << 20  # bytes of text of which signatures and sets are made at a time, as a worker keeps the memory it once took


class Features:
    """The sets of a batch: `items` holds row << 48 | feature, ascending and distinct."""

    def __init__(self, texts, width: int):
        words = Words(texts, lower=True)
        counts = words.counts()
        hashes = [windows_hash(words.hashes, n) for n in range(1, width + 1)]
        full = hashes[-1]
        row = np.repeat(np.arange(len(counts)), counts)[: len(full)]
        inside = np.arange(len(full)) + width <= words.starts[row + 1]
        rows, values = [row[inside]], [full[inside]]
        for n in range(1, width):
            short = np.flatnonzero(counts == n)
            rows.append(short)
            values.append(hashes[n - 1][words.starts[short]])
        row = np.concatenate(rows).astype(np.uint64)
        value = np.concatenate(values) >> np.uint64(16)
        items = np.sort((row << _ROW) | value)
        if len(items):
            items = items[np.append(True, items[1:] != items[:-1])]
        self.items = items
        self.rows = (items >> _ROW).astype(np.int64)
        self.values = items & _FEATURE
        self.sizes = np.bincount(self.rows, minlength=len(counts))
        self.starts = np.append(0, np.cumsum(self.sizes))

    def digests(self) -> list[np.ndarray]:
        """Two 64-bit hashes of every set."""
        out = []
        for salt in _SALT[:2]:
            sums = np.append(np.uint64(0), np.cumsum(mix(self.values + salt)))
            out.append((sums[self.starts[1:]] - sums[self.starts[:-1]]).view(np.int64))
        return out

    def sketches(self) -> pa.Array:
        """Of every set bits, as many as features or up to twice that, in 64-bit words: odd where an odd number of features fall."""
        bits = 1 << np.ceil(np.log2(np.maximum(self.sizes, WORD))).astype(np.int64)
        starts = np.append(0, np.cumsum(bits))
        at = starts[self.rows] + (self.values.astype(np.int64) & (bits - 1)[self.rows])
        odd = (np.bincount(at, minlength=starts[-1]) & 1).astype(np.uint8)
        words = np.packbits(odd, bitorder="little").view("<i8")
        return pa.ListArray.from_arrays(pa.array((starts // WORD).astype(np.int32)), pa.array(words))


class Bands:
    """Bands of sizes, and for each the groups and parts its signatures use."""

    def __init__(self, of: int, largest: int):
        lows = [1]
        while lows[-1] <= largest:
            lows.append(lows[-1] * 100 // of + 1)
        lows.append(lows[-1] * 100 // of + 1)
        self.lows = np.array(lows)
        self.of = of
        highs = self.lows[1:] - 1
        self.differ = 2 * highs * (100 - of) // (100 + of)
        self.small = self.differ <= SMALL
        spare = 3 + self.differ // 100
        self.groups = np.where(self.small, (self.differ + 2) // 2, self.differ + 1 + spare)
        self.groups[self.differ == 0] = 1
        self.parts = np.where(self.small & (self.differ > 0), 3, 1)

    def band(self, sizes: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.lows, sizes, "right") - 1

    def agreeing(self, sizes: np.ndarray, band: np.ndarray) -> np.ndarray:
        """The least number of groups in which a set of this size agrees with any match."""
        other = np.minimum(self.lows[band + 1] - 1, sizes * 100 // self.of)
        differ = (sizes + other) * (100 - self.of) // (100 + self.of)
        return self.groups[band] - np.where(self.parts[band] == 3, differ // 2, differ)


def _signatures(f: Features, bands: Bands, chosen: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """(signature, row) of the chosen rows in the band `step` above their own."""
    chosen = chosen[f.sizes[chosen] > 0]
    if not len(chosen):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    band = bands.band(f.sizes[chosen]) + step
    parts = bands.groups[band] * bands.parts[band]
    first = np.zeros(len(f.sizes), dtype=np.int64)
    first[chosen] = np.cumsum(parts) - parts
    wanted = np.zeros(len(f.sizes), dtype=bool)
    wanted[chosen] = True
    all_parts = np.zeros(len(f.sizes), dtype=np.uint64)
    all_parts[chosen] = parts
    use = wanted[f.rows]
    rows, values = f.rows[use], f.values[use]
    # Parts split the domain evenly in the order of the features, so a set's features come part by part.
    part = ((values >> np.uint64(16)) * all_parts[rows] >> np.uint64(32)).astype(np.int64)
    total = int(parts.sum())
    count = np.bincount(first[rows] + part, minlength=total)
    ends = np.append(0, np.cumsum(count))
    sums = np.append(np.uint64(0), np.cumsum(mix(values)))
    sums = sums[ends[1:]] - sums[ends[:-1]]
    owner = np.repeat(np.arange(len(chosen)), parts)
    place = (np.arange(total) - first[chosen][owner]).astype(np.uint64)
    tag = (band[owner].astype(np.uint64) << np.uint64(32)) * _SALT[0]
    wide = bands.parts[band] == 3
    agreeing = bands.agreeing(f.sizes[chosen], band)
    out, rows_out = [], []

    def add(made: list, of: np.ndarray) -> None:
        """Signatures of groups with whether they are empty; these only where a match might agree in no other."""
        empty = np.logical_or.reduce([e for _, e in made])
        needed = np.bincount(of[empty], minlength=len(chosen)) >= agreeing
        for signature, is_empty in made:
            keep = ~is_empty | needed[of]
            out.append(signature[keep])
            rows_out.append(chosen[of[keep]])

    one = ~wide[owner]
    add([(mix(sums[one] + place[one] * _SALT[1] + tag[one]), count[one] == 0)], owner[one])
    three = np.flatnonzero(~one)[::3]
    pairs = ((three, three + 1), (three, three + 2), (three + 1, three + 2))
    made = [
        (
            mix(sums[x] * _SALT[2] + sums[y] * _SALT[3] + (place[three] + np.uint64(i)) * _SALT[1] + tag[three]),
            count[x] + count[y] == 0,
        )
        for i, (x, y) in enumerate(pairs)
    ]
    add(made, owner[three])
    return np.concatenate(out), np.concatenate(rows_out)


def numbered_rows(docs: DataFrame) -> DataFrame:
    """The rows with a number `__llm_row`, written once so that it stays the same for every step."""
    return written(docs.withColumn("__llm_row", F.monotonically_increasing_id()), "numbered-rows", compression="zstd")


def _input(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("__llm_row").alias("doc"), "text")


def set_sizes(rows: DataFrame, width: int) -> DataFrame:
    """(doc, size, digest1, digest2) of every row's set."""

    def run(batches):
        for batch in by_bytes(batches, limit=BATCH):
            f = Features(batch["text"], width)
            one, two = f.digests()
            yield pa.RecordBatch.from_arrays(
                [batch["doc"], pa.array(f.sizes.astype(np.int32)), pa.array(one), pa.array(two)],
                names=["doc", "size", "digest1", "digest2"],
            )

    return _input(rows).mapInArrow(run, "doc long, size int, digest1 long, digest2 long")


def signatures(rows: DataFrame, width: int, of: int, largest: int) -> DataFrame:
    """(key, doc, first, sig).  `first` names an earlier row of the batch with the same signature.

    Rows without `first` have the signature as key.  Others, which need not meet anything else, have it in
    `sig` and a key that spreads them.  Of equal sets in a batch only one gives signatures.
    """
    bands = Bands(of, largest)

    def run(batches):
        for batch in by_bytes(batches, limit=BATCH):
            f = Features(batch["text"], width)
            one, two = f.digests()
            docs_here = batch["doc"].to_numpy(zero_copy_only=False)
            order = np.lexsort((docs_here, two, one))
            again = np.append(False, (one[order[1:]] == one[order[:-1]]) & (two[order[1:]] == two[order[:-1]]))
            chosen = np.sort(order[~again])
            made = [_signatures(f, bands, chosen, step) for step in (0, 1)]
            sig = (np.concatenate([m[0] for m in made]) & _KEY).view(np.int64)
            doc = docs_here[np.concatenate([m[1] for m in made])]
            order = np.lexsort((doc, sig))
            sig, doc = sig[order], doc[order]
            begins = np.flatnonzero(np.append(True, sig[1:] != sig[:-1])) if len(sig) else np.zeros(0, np.int64)
            lead = np.repeat(begins, np.diff(np.append(begins, len(sig))))
            local = lead != np.arange(len(sig))
            key = np.where(local, mix(sig.view(np.uint64) + doc.astype(np.uint64)).view(np.int64), sig)
            for at in range(0, len(sig), 1 << 18):
                part = slice(at, at + (1 << 18))
                mine = ~local[part]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(key[part]),
                        pa.array(doc[part]),
                        pa.array(doc[lead[part]], mask=mine),
                        pa.array(sig[part], mask=mine),
                    ],
                    names=["key", "doc", "first", "sig"],
                )

    return _input(rows).mapInArrow(run, "key long, doc long, first long, sig long")


def packed(values: np.ndarray) -> np.ndarray:
    """The 48-bit features as bytes, six for each."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :BYTES]).reshape(-1)


def unpacked(raw: list[bytes]) -> np.ndarray:
    """The features of packed sets, one set after the other."""
    data = np.frombuffer(b"".join(raw), np.uint8).reshape(-1, BYTES)
    wide = np.zeros((len(data), 8), np.uint8)
    wide[:, :BYTES] = data
    return wide.view("<u8").reshape(-1)


def _marked(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of these numbers (doc).  The numbers go to the texts, one bit for each, as texts are much larger."""
    bits = ids.groupBy(F.bitmap_bucket_number("doc").alias("range")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("doc")).alias("bits")
    )
    at = F.bitmap_bit_position("__llm_row")
    byte = F.conv(F.hex(F.substr("bits", (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    ranged = rows.withColumn("range", F.bitmap_bucket_number("__llm_row")).join(written(bits, "marks"), "range")
    return ranged.where(F.getbit(byte, (at % 8).cast("int")) == 1)


def _sets(rows: DataFrame, places: DataFrame, width: int) -> DataFrame:
    """The rows of `places` (doc and other columns) with the size and items of that document's set.

    Sets are made from the texts of these documents only.  The texts, which compress better than sets, go to their places,
    unless these are few; a set goes from there to where it is compared.
    """
    columns = [c for c in places.columns if c != "doc"]
    lists = places.groupBy("doc").agg(F.collect_list(F.struct(*columns)).alias("places"))

    def run(batches):
        for batch in by_bytes(batches, limit=BATCH):
            f = Features(batch["text"], width)
            raw = packed(f.values).tobytes()
            borders = (f.starts * BYTES).tolist()
            items = [raw[i:j] for i, j in zip(borders[:-1], borders[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch["doc"], pa.array(f.sizes.astype(np.int32)), pa.array(items, pa.binary()), batch["places"]],
                names=["doc", "size", "items", "places"],
            )

    texts = _input(_marked(rows, places.select("doc"))).join(lists, "doc")
    schema = f"doc long, size int, items binary, places {lists.schema['places'].dataType.simpleString()}"
    made = texts.select("doc", "text", "places").mapInArrow(run, schema)
    return made.select("doc", "size", "items", F.explode("places").alias("p")).select("doc", "size", "items", "p.*")


def set_sketches(rows: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """(doc, size, sketch) of the sets of these numbers (doc)."""

    def run(batches):
        for batch in by_bytes(batches, limit=BATCH):
            f = Features(batch["text"], width)
            yield pa.RecordBatch.from_arrays(
                [batch["doc"], pa.array(f.sizes.astype(np.int32)), f.sketches()], names=["doc", "size", "sketch"]
            )

    return _input(_marked(rows, ids)).mapInArrow(run, "doc long, size int, sketch array<long>")


def may_link(of: int) -> Column:
    """Whether two sets (size_a, sketch_a, size_b, sketch_b) may link, by their sizes and by the bits in which their sketches differ.

    The longer sketch is folded to the shorter; one that is more than twice as long rules nothing out.
    """
    least, most = (f(F.size("sketch_a"), F.size("sketch_b")) for f in (F.least, F.greatest))

    def folded(x: str) -> Column:
        halves = F.zip_with(F.slice(x, F.lit(1), least), F.slice(x, least + 1, least), lambda p, q: p.bitwiseXOR(q))
        return F.when(F.size(x) == least, F.col(x)).otherwise(halves)

    differing = F.zip_with(folded("sketch_a"), folded("sketch_b"), lambda p, q: F.bit_count(p.bitwiseXOR(q)))
    bits = F.aggregate(differing, F.lit(0), lambda total, n: total + n)
    sizes = F.expr(f"100 * least(size_a, size_b) >= {of} * greatest(size_a, size_b)")
    return sizes & ((most > 2 * least) | (bits * (100 + of) <= (F.col("size_a") + F.col("size_b")) * (100 - of)))


def _blocks(size: str, times: int = 1) -> Column:
    """How many blocks hold these sets, of about BLOCK_ITEMS features and BLOCK_SETS sets at most each, or `times` as much."""
    return F.greatest(F.ceil(F.sum(size) / (times * BLOCK_ITEMS)), F.ceil(F.count("*") / (times * BLOCK_SETS))).cast("int")


def _in_cells(members: DataFrame, by: str, times: int = 1) -> DataFrame:
    """(doc, component, `by`, i, j, side): the places of members (id, component, size) in cells of two blocks of their group.

    Groups whose members are all in one component have no cells.
    """
    blocks = members.groupBy(by).agg(
        _blocks("size", times).alias("blocks"), F.min("component").alias("low"), F.max("component").alias("high")
    )
    mixed = blocks.where("low < high").select(by, "blocks")
    placed = members.join(mixed, by).withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    return placed.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).select(
        F.col("id").alias("doc"), "component", by, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
        (F.col("own") <= F.col("other")).cast("int").alias("side"),
    )


def _first_links(pairs: DataFrame, rows: DataFrame, width: int, of: int) -> DataFrame:
    """The pairs (a, b, size_b), of which each `b` has one, that are links: their whole sets are as similar as asked.

    The sets b of one `a` meet in blocks with a copy of a's set in each, so that a set goes to one block and no pair carries two sets.
    """
    blocks = written(pairs.groupBy("a").agg(_blocks("size_b").alias("blocks")), "first-blocks")
    block = F.pmod(F.xxhash64("b"), F.col("blocks")).cast("int")
    others = pairs.join(blocks, "a").select(F.col("b").alias("doc"), "a", block.alias("block"))
    firsts = blocks.select(F.col("a").alias("doc"), "a", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    sets = _sets(rows, written(others.union(firsts), "first-places"), width)

    def run(batches):
        for group in grouped(batches, ("a", "block")):
            found = _like_first(group, of)
            if found is not None:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], names=["a", "b"])

    return sets.repartition("a", "block").sortWithinPartitions("a", "block").mapInArrow(run, "a long, b long")


def _like_first(group: pa.Table, of: int):
    """(a, b) of the links between a's set and the others of a block."""
    doc, size, a = (group[c].to_numpy() for c in ("doc", "size", "a"))
    items = unpacked(group["items"].combine_chunks().to_pylist())
    row = np.repeat(np.arange(len(doc)), size)
    first = int(np.flatnonzero(doc == a)[0])
    mine = items[row == first]  # ascending
    at = np.searchsorted(mine, items)
    same = np.bincount(row[mine[np.minimum(at, len(mine) - 1)] == items], minlength=len(doc))
    links = 100 * same >= of * (size.astype(np.int64) + size[first] - same)
    links[first] = False
    return (a[links], doc[links]) if links.any() else None


def _cell_links(cells: DataFrame, of: int) -> DataFrame:
    """(a, b): of the components that a cell's links join a forest.  Cells come one after the other."""

    def run(batches):
        for cell in grouped(batches, ("cluster", "i", "j")):
            found = _linked(cell, of)
            if found is not None:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], names=["a", "b"])

    return cells.mapInArrow(run, "a long, b long")


def _near_links(cells: DataFrame, of: int) -> DataFrame:
    """(a, b): a forest of the sets of a cell that are in different components and may link by their sketches."""

    def run(batches):
        for cell in grouped(batches, ("lead", "i", "j")):
            found = _near(cell, of)
            if found is not None:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], names=["a", "b"])

    return cells.mapInArrow(run, "a long, b long")


def _near(cell: pa.Table, of: int):
    ids, component, side, size = (cell[c].to_numpy() for c in ("doc", "component", "side", "size"))
    if len(ids) < 2 or component.min() == component.max():
        return None
    size = size.astype(np.int64)
    sketches = cell["sketch"].combine_chunks()
    words, bits = sketches.value_lengths().to_numpy(), sketches.flatten().to_numpy().view(np.uint64)
    starts = np.cumsum(words) - words
    across = cell["i"][0].as_py() != cell["j"][0].as_py()
    found = []
    for n in np.unique(words).tolist():
        # Each sketch of this length with all of its own length and those of twice that, folded.
        mine, longer, far = np.flatnonzero(words == n), np.flatnonzero(words == 2 * n), np.flatnonzero(words > 2 * n)
        own = bits[starts[mine][:, None] + np.arange(n)]
        halves = bits[starts[longer][:, None] + np.arange(2 * n)]
        every, held = np.concatenate([mine, longer, far]), np.concatenate([own, halves[:, :n] ^ halves[:, n:]])
        step = max(1, NEAR_WORDS // (len(held) * n))
        for at in range(0, len(mine), step):
            here = mine[at : at + step]
            differ = np.zeros((len(here), len(every)), np.int64)
            differ[:, : len(held)] = np.bitwise_count(own[at : at + step, None, :] ^ held[None, :, :]).sum(axis=2, dtype=np.int64)
            both = size[here][:, None] + size[every][None, :]
            least = np.minimum(size[here][:, None], size[every][None, :])
            near = (100 * least >= of * (both - least)) & (differ * (100 + of) <= both * (100 - of))
            near &= component[here][:, None] != component[every][None, :]
            if across:
                near &= side[here][:, None] != side[every][None, :]
            p, q = np.nonzero(near)
            found.append((here[p], every[q]))
    p, q = (np.concatenate(x) for x in zip(*found, strict=True))
    if not len(p):
        return None
    root, leaf = forest(len(ids), p, q)
    return ids[root], ids[leaf]


def _linked(cell: pa.Table, of: int):
    ids, component, side, size = (cell[c].to_numpy() for c in ("id", "component", "side", "size"))
    if len(ids) < 2 or component.min() == component.max():
        return None
    features = unpacked(cell["items"].combine_chunks().to_pylist())
    _, column, count = np.unique(features, return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(ids)), size)
    # Features of one set alone are in no intersection.
    shared = count[column] > 1
    row, column = row[shared], np.unique(column[shared], return_inverse=True)[1]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    same = np.zeros((len(ids), len(ids)), dtype=np.float32)
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        lo, hi = np.searchsorted(column, (first, first + COLUMNS))
        held = np.zeros((len(ids), COLUMNS), dtype=np.float32)
        held[row[lo:hi], column[lo:hi] - first] = 1
        same += held @ held.T
    both = (size[:, None] + size[None, :]).astype(np.float64)
    links = np.triu(100 * same >= of * (both - same), 1) & (component[:, None] != component[None, :])
    if cell["i"][0].as_py() != cell["j"][0].as_py():
        links &= side[:, None] != side[None, :]
    p, q = np.nonzero(links)
    if not len(p):
        return None
    names, code = np.unique(component, return_inverse=True)
    root, leaf = forest(len(names), code[p], code[q])
    return names[root], names[leaf]


def near_components(rows: DataFrame, width: int, of: int) -> DataFrame:
    """(doc, size, component) for every numbered row; the component is named by the smallest number that links reach."""
    every = written(set_sizes(rows, width), "set-sizes")
    sized = every.where("size > 0")
    same = sized.groupBy("size", "digest1", "digest2").agg(F.min("doc").alias("rep"), F.count("*").alias("n"))
    reps = written(
        sized.join(same.where("n > 1").drop("n"), ["size", "digest1", "digest2"], "left").select(
            "doc", "size", F.coalesce("rep", "doc").alias("rep")
        ),
        "set-reps",
    )
    largest = reps.agg(F.max("size")).first()[0]
    if largest is None:
        return every.select("doc", "size", F.col("doc").alias("component"))
    made = signatures(rows, width, of, largest)
    # One shuffle of (key, doc) serves the counts and the join: with the same columns and filters, Spark
    # computes it once.
    mine = made.where("first is null and key is not null and doc is not null").select("key", "doc").repartition("key")
    first = mine.groupBy("key").agg(F.min("doc").alias("a"), F.count("*").alias("n"))
    shared = mine.join(first.where("n > 1"), "key").where("doc != a")
    local = made.where("first is not null").select("sig", "doc", F.col("first").alias("a"), F.lit(True).alias("local"))
    buckets = shared.select(F.col("key").alias("sig"), "doc", "a", F.lit(False).alias("local")).union(local)
    buckets = written(buckets, "buckets")

    by_rep = reps.select("doc", "rep")
    # Those that met an earlier one of their batch also meet that one's first, of the same signature.
    inner = buckets.where("local").select("sig", "doc", F.col("a").alias("early"))
    early = written(inner.select("early").distinct(), "early")
    outer = buckets.where("not local").select("sig", F.col("doc").alias("early"), "a").join(early, "early", "left_semi")
    met = buckets.select("a", "doc").union(inner.join(outer, ["sig", "early"]).select("a", "doc")).distinct()
    met = (
        met.join(by_rep.select(F.col("doc").alias("a"), F.col("rep").alias("lead")), "a")
        .join(by_rep.select("doc", F.col("rep").alias("id")), "doc")
        .where("lead != id").select("lead", "id").distinct()
    )
    met = written(met, "met")
    sketches = written(set_sketches(rows, met.select(F.explode(F.array("lead", "id")).alias("doc")), width), "sketches")

    # One first for each set; what is then still apart goes to the cells, where a set travels with others, not by the pair.
    a, b = (sketches.select(F.col("doc").alias(x), F.col("size").alias(f"size_{x}"), F.col("sketch").alias(f"sketch_{x}")) for x in "ab")
    pairs = met.select(F.least("lead", "id").alias("a"), F.greatest("lead", "id").alias("b")).distinct()
    pairs = pairs.join(a, "a").join(b, "b").where(may_link(of)).groupBy("b").agg(F.min("a").alias("a"), F.max("size_b").alias("size_b"))
    links = written(_first_links(written(pairs, "pairs"), rows, width, of), "links")
    found = roots(links)

    # Groups with members in several components: compare across those.
    label = found.select("id", "component")
    members = met.union(met.select("lead", F.col("lead").alias("id")).distinct())
    members = members.join(sketches.select(F.col("doc").alias("id"), "size"), "id").join(label, "id", "left")
    members = written(members.select("lead", "id", "size", F.coalesce("component", "id").alias("component")), "members")
    cells = written(_in_cells(members, "lead", SKETCH_BLOCKS), "near-places").join(sketches, "doc")
    near = _near_links(cells.repartition("lead", "i", "j").sortWithinPartitions("lead", "i", "j"), of)
    near = written(near.distinct(), "near")
    if near.take(1):
        # Sets that may link are one cluster; it is compared in cells of two bounded blocks.
        ids = near.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        member = ids.join(members.select("id", "size", "component").distinct(), "id").join(
            components(near).withColumnRenamed("component", "cluster"), "id", "left"
        )
        member = written(member.select("id", "size", "component", F.coalesce("cluster", "id").alias("cluster")), "clustered")
        cells = written(_in_cells(member, "cluster"), "cell-places")
        cells = _sets(rows, cells, width).withColumnRenamed("doc", "id")
        cells = cells.repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j")
        more = written(_cell_links(cells, of), "cell-links")
        if more.take(1):
            # Components that cells joined, by the names they had before.
            joined = components(more).select(F.col("id").alias("component"), F.col("component").alias("least"))
            ends = more.select(F.explode(F.array("a", "b")).alias("id")).distinct()
            names = found.union(ends.select("id", F.col("id").alias("component")))
            found = names.join(joined, "component", "left").select("id", F.coalesce("least", "component").alias("component"))
    component = by_rep.join(found.select(F.col("id").alias("rep"), "component"), "rep", "left").select(
        "doc", F.coalesce("component", "rep").alias("component")
    )
    return every.join(component, "doc", "left").select("doc", "size", F.coalesce("component", "doc").alias("component"))


def _named(rows: DataFrame, width: int, of: int) -> DataFrame:
    """(doc, doc_id, size, component, component_id): every row with its component and that one's smallest doc_id."""
    with scratch(rows.sparkSession):
        found = written(near_components(rows, width, of), "components", keep=True)
    ids = rows.select(F.col("__llm_row").alias("doc"), "doc_id")
    least = found.join(ids, "doc").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return found.join(ids, "doc").join(least, "component").select("doc", "doc_id", "size", "component", "component_id")


def keep_one(docs: DataFrame, width: int = 5, of: int = 80) -> DataFrame:
    """The documents without near duplicates: of each class the row of the smallest doc_id stays.

    Rows without a doc_id stand behind those with one; of rows with the same the first by number stays.  Rows without
    words all stay.
    """
    rows = numbered_rows(docs)
    found = _named(rows, width, of)
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "doc")
    stay = found.groupBy("component").agg(F.min(place)["doc"].alias("stays"))
    gone = found.join(stay, "component").where("doc != stays").select(F.col("doc").alias("__llm_row"))
    return rows.join(written(gone, "near-copies"), "__llm_row", "left_anti").select(*[f"`{c}`" for c in docs.columns])


def op9_jaccard_join(spark: SparkSession, sf_dir: str, width: int = 4, of: int = 85) -> DataFrame:
    rows = numbered_rows(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return _named(rows, width, of).select("doc_id", F.col("size").cast("long").alias("n_shingles"), "component_id")
