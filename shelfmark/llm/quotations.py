"""Quoted passages linked to the messages they quote, in DataFrame operations only.

A line's quote level is the number of `>` marks it begins with.  Lines of one level in a row are a passage; those
of level 0 are the message's own body.  Passages are stripped of their marks, white space made single, A-Z
lowered, and hashed.  A quoted passage links to the latest earlier message of the same conversation whose body, or one
line of it, has the same hash, a whole body first.  A message replies to what its passage of the least level
links to.  Replies make trees; a tree is a conversation of its own, in the order of turns, in which every message
follows the one it answers.

The latest earlier message is found inside blocks of turns and carried over from block to block, and trees by doubling,
so no conversation, hash or tree has to pass through one task.  Null text counts as empty and has no passage; messages
with null conversation or turn link with nothing and are trees of their own; rows that share conversation and
turn share their link.  An empty table gives an empty result; extra columns do no harm.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WHITE, table, written

TURNS = 1024
_MARKS = "^(?:[ ]?>)+[ ]?"


def _normal(text):
    """Single spaces, A-Z lowered."""
    upper, lower = (bytes(range(a, a + 26)).decode() for a in (65, 97))
    return F.trim(F.translate(F.regexp_replace(text, f"[{WHITE}]+", " "), upper, lower))


def _hash(text):
    return F.md5(text.cast("binary"))


def with_passages(messages: DataFrame) -> DataFrame:
    """Adds `_passages`: (level, text) in the order of the message, without quote marks."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    marked = messages.withColumn("_lines", lines)
    level = lambda x: F.length(F.regexp_replace(F.regexp_extract(x, _MARKS, 0), "[^>]", ""))
    marked = marked.withColumn("_levels", F.transform("_lines", level))
    begins = F.filter(
        F.sequence(F.lit(0), F.size("_levels") - 1),
        lambda i: (i == 0) | (F.get("_levels", i) != F.get("_levels", i - 1)),
    )
    marked = marked.withColumn("_begins", begins)

    def passage(begin, k):
        stop = F.coalesce(F.get("_begins", k + 1), F.size("_lines"))
        own = F.slice("_lines", begin + 1, stop - begin)
        bare = F.transform(own, lambda x: F.regexp_replace(x, _MARKS, ""))
        return F.struct(F.get("_levels", begin).alias("level"), F.array_join(bare, "\n").alias("text"))

    return marked.withColumn("_passages", F.transform("_begins", passage)).drop("_lines", "_levels", "_begins")


def _body():
    own = F.filter("_passages", lambda p: p["level"] == 0)
    return F.array_join(F.transform(own, lambda p: p["text"]), "\n")


def _latest_earlier(events: DataFrame) -> DataFrame:
    """For every quote (conv_id, hash, turn) the latest earlier turn that has the hash as `turn_of`."""
    key = ["conv_id", "hash"]
    events = events.withColumn("_block", F.floor(F.col("turn") / TURNS))
    inside = Window.partitionBy(*key, "_block").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    original = F.when(F.col("original"), F.col("turn"))
    before = Window.partitionBy(*key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = events.groupBy(*key, "_block").agg(F.max(original).alias("_last"))
    carried = carried.withColumn("_carried", F.max("_last").over(before)).drop("_last")
    found = events.withColumn("_near", F.max(original).over(inside)).where("not original")
    return found.join(carried, [*key, "_block"]).select(*key, "turn", F.coalesce("_near", "_carried").alias("turn_of"))


def links(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, level, place, turn_of) of every quoted passage that is not empty; `turn_of` may be null."""
    known = messages.where("conv_id is not null and turn is not null").select("conv_id", "turn", "_passages", "_body")
    body = _normal(F.col("_body"))
    whole = known.select("conv_id", "turn", body.alias("text"), F.lit(1).alias("rank"))
    lines = known.select("conv_id", "turn", F.explode(F.split("_body", "\n")).alias("text"), F.lit(0).alias("rank"))
    lines = lines.withColumn("text", _normal(F.col("text")))
    originals = (
        whole.union(lines).where("text != ''")
        .groupBy("conv_id", "turn", _hash(F.col("text")).alias("hash")).agg(F.max("rank").alias("rank"))
    )
    quotes = (
        known.select("conv_id", "turn", F.posexplode("_passages").alias("place", "p"))
        .where("p.level > 0")
        .select("conv_id", "turn", "place", "p.level", _normal(F.col("p.text")).alias("text"))
        .where("text != ''")
        .withColumn("hash", _hash(F.col("text")))
        .drop("text")
    )
    asked = quotes.select("conv_id", "hash", "turn").distinct().withColumn("original", F.lit(False))
    found = [
        _latest_earlier(
            originals.where(which).select("conv_id", "hash", "turn", F.lit(True).alias("original")).unionByName(asked)
        ).withColumnRenamed("turn_of", name)
        for which, name in (("rank = 1", "_whole"), ("rank = 0", "_line"))
    ]
    key = ["conv_id", "hash", "turn"]
    return quotes.join(found[0], key).join(found[1], key).select(
        "conv_id", "turn", "level", "place", F.coalesce("_whole", "_line").alias("turn_of")
    )


def trees(replies: DataFrame) -> DataFrame:
    """(conv_id, turn, root, depth) from distinct (conv_id, turn, reply_to), by doubling."""
    up = replies.select(
        "conv_id", "turn",
        F.coalesce("reply_to", "turn").alias("root"),
        F.col("reply_to").isNotNull().cast("long").alias("depth"),
    )
    # Only messages whose tree is not yet known go on; those that have reached their root stand aside.
    active, done = written(up, "reply-steps"), None
    while True:
        every = active if done is None else done.unionByName(active)
        above = every.select(
            "conv_id", F.col("turn").alias("root"), F.col("root").alias("_root"), F.col("depth").alias("_depth")
        )
        joined = written(
            active.join(above, ["conv_id", "root"]).select(
                "conv_id", "turn", F.col("_root").alias("root"), (F.col("depth") + F.col("_depth")).alias("depth"),
                (F.col("_root") != F.col("root")).alias("moved"),
            ),
            "reply-steps",
        )
        arrived = joined.where("not moved").drop("moved")
        done = arrived if done is None else done.unionByName(arrived)
        active = joined.where("moved").drop("moved")
        if not active.take(1):
            return done


def _positions(rows: DataFrame) -> DataFrame:
    """Adds `position` from 0 in the tree, by turn, counted in blocks of turns."""
    tree = ["conv_id", "root"]
    rows = rows.withColumn("_block", F.floor(F.col("turn") / TURNS))
    before = Window.partitionBy(*tree).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(*tree, "_block").agg(F.count("*").alias("_n"))
    counts = counts.withColumn("_first", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = Window.partitionBy(*tree, "_block").orderBy("turn")
    return (
        rows.withColumn("_place", F.row_number().over(inside) - 1)
        .join(counts, [*tree, "_block"])
        .withColumn("position", (F.col("_first") + F.col("_place")).cast("long"))
        .drop("_block", "_place", "_first")
    )


def link_quotations(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, role, body, n_quotes, n_linked, reply_to, root, depth, position) of every message."""
    parsed = with_passages(messages.select("conv_id", "turn", "role", "text")).drop("text").withColumn("_body", _body())
    parsed = written(parsed, "passages")
    linked = written(links(parsed), "quote-links")
    replies = linked.groupBy("conv_id", "turn").agg(
        F.count("*").alias("n_quotes"),
        F.count("turn_of").alias("n_linked"),
        F.min(F.when(F.col("turn_of").isNotNull(), F.struct("level", "place", "turn_of"))).alias("best"),
    )
    known = parsed.where("conv_id is not null and turn is not null").select("conv_id", "turn").distinct()
    per_turn = written(
        known.join(replies, ["conv_id", "turn"], "left").select(
            "conv_id", "turn", "n_quotes", "n_linked", F.col("best.turn_of").alias("reply_to")
        ),
        "replies",
    )
    placed = per_turn.join(trees(per_turn.select("conv_id", "turn", "reply_to")), ["conv_id", "turn"])
    own = parsed.select("conv_id", "turn", "role", F.col("_body").alias("body"))
    found = _positions(own.join(placed, ["conv_id", "turn"]))
    alone = own.where("conv_id is null or turn is null").select(
        "*", *[F.lit(None).cast("long").alias(c) for c in ("n_quotes", "n_linked", "reply_to")],
        F.col("turn").alias("root"), F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("position"),
    )
    zero = F.lit(0).cast("long")
    return found.unionByName(alone).select(
        "conv_id", "turn", "role", "body",
        F.coalesce("n_quotes", zero).alias("n_quotes"), F.coalesce("n_linked", zero).alias("n_linked"),
        "reply_to", "root", "depth", "position",
    )


def as_replies(conversations: DataFrame, levels: int = 2) -> DataFrame:
    """The conversations as mail would carry them: every turn quotes the turn before it, and what that quoted.

    The last `levels` turns are quoted, each one level deeper, line by line.
    """
    text = F.coalesce("text", F.lit(""))
    single = conversations.groupBy("conv_id", "turn").agg(F.min(text).alias("_earlier"))
    out = conversations.withColumn("text", text)
    for level in range(1, levels + 1):
        earlier = single.select("conv_id", (F.col("turn") + level).alias("turn"), "_earlier")
        mark = "> " * level
        quoted = F.concat(F.lit("\n" + mark), F.regexp_replace("_earlier", "\n", "\n" + mark))
        out = out.join(earlier, ["conv_id", "turn"], "left")
        out = out.withColumn("text", F.concat("text", F.coalesce(quoted, F.lit("")))).drop("_earlier")
    return out


def op3_quotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = link_quotations(as_replies(table(spark, sf_dir, "conversations")))
    return found.select(
        "conv_id", "turn", "role", F.sha2("body", 256).alias("body_sha256"),
        "n_quotes", "n_linked", "reply_to", "root", "depth", "position",
    )


ORACLE = {
    "op3_quotations": r"""
        WITH m AS (
            SELECT conv_id, turn, role, coalesce(text, '') AS text,
                   trim(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) != '' AS has_words
            FROM conversations),
        q AS (
            SELECT m.*, a.has_words AS one, b.has_words AS two,
                   CASE WHEN a.has_words THEN a.turn WHEN b.has_words THEN b.turn END AS reply_to
            FROM m LEFT JOIN m a ON a.conv_id = m.conv_id AND a.turn = m.turn - 1
                   LEFT JOIN m b ON b.conv_id = m.conv_id AND b.turn = m.turn - 2),
        r AS (
            SELECT *, max(CASE WHEN reply_to IS NULL THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn) AS root FROM q)
        SELECT conv_id, turn, role, sha256(text) AS body_sha256,
               coalesce(one, false)::BIGINT + coalesce(two, false)::BIGINT AS n_quotes,
               coalesce(one, false)::BIGINT + coalesce(two, false)::BIGINT AS n_linked,
               reply_to, root,
               row_number() OVER (PARTITION BY conv_id, root ORDER BY turn) - 1 AS depth,
               row_number() OVER (PARTITION BY conv_id, root ORDER BY turn) - 1 AS position
        FROM r"""
}
