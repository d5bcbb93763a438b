"""A Merkle manifest of a dataset: a DAG of digests, addressed by content, and proofs by descent from its root.

Every row is a leaf, H(doc_id, source, lang, n_chars, text); H is SHA-256 in lowercase hex over its inputs in a
row, each field written as `-` if null, else as its length in UTF-8 bytes, a colon and its value.  The leaves of a
lang ascend by doc_id (null first, ties by digest).  While more than one node is left, every ARITY in a row become
their H; what is left is the lang's subroot.  Subroots, ordered by lang (null first, by bytes), give the root likewise.

`build` stores one record (digest, children) per distinct inner node, in one table whatever the level or lang.
`prove` answers requests (tree, rank) for leaves.  All requests start at the root's digest; at each step the next
digit of the rank, in base ARITY, selects a child of the record found by digest, and the others are the step's path
segment.  Requests below one node go down together, as one row, so no record is asked for once per leaf; the paths
are given back reversed, from the leaf up.  `fold` computes a root from a leaf and such a path.

Only DataFrame functions are used.  Documents go by as digests, texts are never shuffled.  Rows that repeat
whole are leaves of their own, equal records are stored once.  An empty table has no leaves and no root.  Columns
other than the five do no harm.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written
from .numbering import numbered
from .toxicity import fold as crc_fold

BITS = 3
ARITY = 1 << BITS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PATH = "array<struct<left:string,right:string>>"
_TOP = ""  # the tree of the subroots; a lang's tree has its name behind a sign


@dataclass(frozen=True)
class Manifest:
    """leaves (tree, rank, leaf, and what was carried), trees (tree, n, digest), records (digest, children)."""

    leaves: DataFrame
    trees: DataFrame
    records: DataFrame


def hashed(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def leaf_digest(text: Column | None = None) -> Column:
    """A row's leaf; with another text in place of its own if one is given."""

    def field(name: str) -> Column:
        value = (F.col("text") if text is None else text) if name == "text" else F.col(name)
        value = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return hashed(F.concat(*[field(name) for name in FIELDS]))


def tree_of(lang: str = "lang") -> Column:
    """Name of a lang's tree, never null; names sort as langs do, null first."""
    return F.coalesce(F.concat(F.lit("="), F.col(lang)), F.lit("-"))


def _height(n: str, most: int) -> Column:
    """Levels above the leaves of a tree with n of them."""
    return reduce(lambda a, b: a + b, [(F.col(n) > ARITY**k).cast("int") for k in range(most)], F.lit(0))


def _levels(n: int) -> int:
    levels = 0
    while n > ARITY**levels:
        levels += 1
    return levels


def _grow(nodes: DataFrame, most: int) -> tuple[DataFrame, list[DataFrame]]:
    """Roots (tree, digest) of all trees of nodes (tree, rank, digest, left), and their records by level.

    `left` is the number of nodes of the tree on the level, at most `most`.
    """
    roots, records = [nodes.where("left = 1").select("tree", "digest")], []
    for _ in range(_levels(most)):
        nodes = (
            nodes.where("left > 1")
            .groupBy("tree", F.shiftright("rank", BITS).alias("rank"))
            .agg(F.array_sort(F.collect_list(F.struct("rank", "digest"))).alias("run"), F.max("left").alias("left"))
            .select(
                "tree", "rank", F.col("run.digest").alias("children"),
                F.shiftright(F.col("left") + (ARITY - 1), BITS).alias("left"),
            )
            .withColumn("digest", hashed(F.concat_ws("", "children")))
        )
        nodes = written(nodes, "merkle-level")
        records.append(nodes.select("digest", "children"))
        roots.append(nodes.where("left = 1").select("tree", "digest"))
    return reduce(DataFrame.union, roots), records


def build(docs: DataFrame, carry: dict[str, Column] | None = None) -> Manifest:
    """The manifest of the documents; `carry` names more columns to keep with the leaves."""
    carry = carry or {}
    rows = docs.select(
        "doc_id", tree_of().alias("tree"), leaf_digest().alias("leaf"), *[c.alias(k) for k, c in carry.items()],
        F.monotonically_increasing_id().alias("row"),
    )
    rows = written(rows, "merkle-leaves")
    leaves = numbered(rows, "rank", ["doc_id", "leaf", "row"], ["tree"]).drop("row")
    leaves = written(leaves, "merkle-ranked")
    sizes = leaves.groupBy("tree").agg(F.count("*").alias("n"))
    trees = written(numbered(sizes, "place", ["tree"]), "merkle-sizes")
    largest, langs = trees.agg(F.max("n"), F.count("*")).first()
    nodes = leaves.join(trees.select("tree", F.col("n").alias("left")), "tree")
    subroots, records = _grow(nodes.select("tree", "rank", F.col("leaf").alias("digest"), "left"), largest or 0)
    trees = written(trees.join(subroots, "tree"), "merkle-trees")
    top = trees.select(F.lit(_TOP).alias("tree"), F.col("place").alias("rank"), "digest", F.lit(langs).alias("left"))
    root, above = _grow(top, langs)
    trees = trees.unionByName(
        root.select("tree", F.lit(langs).cast("long").alias("n"), F.lit(0).cast("long").alias("place"), "digest")
    )
    empty = rows.limit(0).select(F.col("leaf").alias("digest"), F.array("leaf").alias("children"))
    stored = reduce(DataFrame.union, [*records, *above], empty)
    stored = stored.groupBy("digest").agg(F.first("children").alias("children"))
    return Manifest(leaves, written(trees, "merkle-roots"), written(stored, "merkle-records"))


def _segment(children: str, digit: Column) -> Column:
    """The children before and after the selected one."""
    before = F.concat_ws("", F.slice(F.col(children), F.lit(1), digit))
    after = F.concat_ws("", F.slice(F.col(children), digit + 2, F.lit(ARITY)))
    return F.struct(before.alias("left"), after.alias("right"))


def _digit(rank: str) -> Column:
    return F.col(rank).bitwiseAND(ARITY - 1).cast("int")


def _descend(requests: DataFrame, roots: DataFrame, records: DataFrame, most: int) -> DataFrame:
    """Requests (tree, rank, ...) with digest and path, root first, from roots (tree, n, digest, path)."""
    levels = _levels(most)
    roots = roots.withColumn("height", _height("n", levels))
    lone = requests.join(roots.where("height = 0").select("tree", "digest", "path"), "tree")
    if not levels:
        return lone
    wanted = [None, requests.select("tree", F.shiftright("rank", BITS).alias("rank")).distinct()]
    for _ in range(levels - 1):
        wanted.append(wanted[-1].select("tree", F.shiftright("rank", BITS).alias("rank")).distinct())
    at = roots.where(F.col("height") == levels).select("tree", F.lit(0).cast("long").alias("rank"), "digest", "path")
    for height in range(levels - 1, 0, -1):
        asked = wanted[height].select("tree", F.shiftright("rank", BITS).alias("rank"), F.col("rank").alias("child"))
        found = at.join(asked, ["tree", "rank"]).join(records, "digest").select(
            "tree", F.col("child").alias("rank"), F.get("children", _digit("child")).alias("digest"),
            F.array_append("path", _segment("children", _digit("child"))).alias("path"),
        )
        enter = roots.where(F.col("height") == height).select("tree", F.lit(0).cast("long"), "digest", "path")
        at = written(found.union(enter), "merkle-step")
    # Records of the lowest nodes join once a node, and only then their leaves.
    runs = at.join(records, "digest").select("tree", F.col("rank").alias("run"), "children", "path")
    asked = requests.withColumn("run", F.shiftright("rank", BITS))
    found = asked.join(runs, ["tree", "run"]).select(
        *requests.columns, F.get("children", _digit("rank")).alias("digest"),
        F.array_append("path", _segment("children", _digit("rank"))).alias("path"),
    )
    return found.unionByName(lone)


def prove(manifest: Manifest, requests: DataFrame) -> DataFrame:
    """Requests (tree, rank, ...) with digest, subroot, root, and path: siblings (left, right) from the leaf up.

    Ranks that no leaf has drop out.
    """
    trees = manifest.trees
    known = trees.where(F.col("tree") != _TOP)
    top = trees.where(F.col("tree") == _TOP).withColumn("path", F.array().cast(_PATH))
    largest, langs = known.agg(F.max("n"), F.count("*")).first()
    asked = known.join(requests.select("tree").distinct(), "tree", "left_semi")
    places = asked.select(F.lit(_TOP).alias("tree"), F.col("place").alias("rank"), F.col("tree").alias("name"))
    reached = _descend(places, top, manifest.records, langs)
    subroots = reached.select(F.col("name").alias("tree"), "digest", "path")
    subroots = written(subroots.join(known.select("tree", "n"), "tree"), "merkle-subroots")
    found = _descend(requests, subroots, manifest.records, largest or 0)
    ends = subroots.select("tree", F.col("digest").alias("subroot"))
    root = top.agg(F.max("digest")).scalar()
    return found.join(ends, "tree").where("digest is not null").withColumns({"root": root, "path": F.reverse("path")})


def fold(leaf: Column, path: str = "path") -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, leaf, lambda below, s: hashed(F.concat(s["left"], below, s["right"])))


def proof_digest(path: str = "path") -> Column:
    """H of all siblings of a path, in its order."""
    return hashed(F.concat_ws("", F.transform(path, lambda s: F.concat(s["left"], s["right"]))))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    # Null ids are never tampered with.
    touched = F.coalesce(crc_fold(3) == 0, F.lit(False))
    changed = F.when(touched, leaf_digest(F.translate("text", _UPPER, _LOWER)))
    manifest = build(docs, {"changed": changed})
    proofs = prove(manifest, manifest.leaves)
    return proofs.select(
        "doc_id", "leaf", "subroot", "root", proof_digest().alias("proof_sha256"),
        fold(F.coalesce("changed", "leaf")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


def _sql(levels: int = 9) -> str:
    """The same in SQL, level by level; trees of up to 8 ** levels leaves."""

    def field(name: str) -> str:
        return f"coalesce(strlen({name}::VARCHAR) || ':' || {name}::VARCHAR, '-')"

    def leaf(text: str) -> str:
        fields = [field(n) if n != "text" else f"coalesce(strlen({text}) || ':' || {text}, '-')" for n in FIELDS]
        return f"sha256({' || '.join(fields)})"

    crc = """4294967295 - list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''),
      lambda c: ascii(c)::BIGINT)), lambda a, b: list_reduce(list_concat([xor(a, b)], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
      lambda x, y: xor(x >> 1, 3988292384 * (x & 1))))"""

    def climb(name: str, keys: str) -> list[str]:
        """CTEs {name}1 ... of nodes (keys, rank, digest, many) above {name}0."""
        out = []
        for k in range(levels):
            out.append(f"""{name}_runs{k} AS (SELECT {keys}, rank // 8 AS rank, list(digest ORDER BY rank) AS children
  FROM {name}{k} GROUP BY ALL),
{name}{k + 1} AS (SELECT {keys}, rank, CASE WHEN count(*) OVER (PARTITION BY {keys}) = 1 AND len(children) = 1
    THEN children[1] ELSE sha256(array_to_string(children, '')) END AS digest FROM {name}_runs{k})""")
        return out

    def path(name: str, keys: str, before: str) -> list[str]:
        """CTEs {name}_at1 ... that fold each leaf with its siblings level by level."""
        out, last = [], before
        for k in range(levels):
            left = "array_to_string(children[1:p], '')"
            right = "array_to_string(children[p + 2:], '')"
            out.append(f"""{name}_at{k} AS (SELECT * EXCLUDE (p, children, folded, proof, spot), spot // 8 AS spot,
    proof || {left} || {right} AS proof,
    CASE WHEN len(children) = 1 AND spot // 8 = 0 AND p = 0 THEN folded
      ELSE sha256({left} || folded || {right}) END AS folded
  FROM (SELECT l.*, r.children, l.spot % 8 AS p FROM {last} l JOIN {name}_runs{k} r
    ON {' AND '.join(f'l.{c} = r.{c}' for c in keys.split(', '))} AND l.spot // 8 = r.rank))""")
            last = f"{name}_at{k}"
        return out

    ctes = [
        f"""base AS (SELECT doc_id, coalesce('=' || lang, '-') AS tree, {leaf('text')} AS leaf,
    CASE WHEN ({crc}) % 3 = 0 THEN {leaf(f"translate(text, '{_UPPER}', '{_LOWER}')")} END AS changed FROM documents)""",
        """ranked AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS rank,
    dense_rank() OVER (ORDER BY tree) - 1 AS place FROM base)""",
        "low0 AS (SELECT tree, rank, leaf AS digest FROM ranked)",
        *climb("low", "tree"),
        f"""high0 AS (SELECT 0 AS top, dense_rank() OVER (ORDER BY tree) - 1 AS rank, digest FROM low{levels})""",
        *climb("high", "top"),
        "asked AS (SELECT *, 0 AS top, rank AS spot, coalesce(changed, leaf) AS folded, '' AS proof FROM ranked)",
        *path("low", "tree", "asked"),
        f"placed AS (SELECT * REPLACE (place AS spot) FROM low_at{levels - 1})",
        *path("high", "top", "placed"),
    ]
    return f"""WITH {', '.join(ctes)}
SELECT doc_id, leaf, s.digest AS subroot, r.digest AS root, sha256(proof) AS proof_sha256, folded AS folded_root,
  folded = r.digest AS verified
FROM high_at{levels - 1} a JOIN low{levels} s USING (tree) JOIN high{levels} r ON true"""


ORACLE = {"op11_merkle": _sql()}
