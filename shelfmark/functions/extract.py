"""Front matter and the fields of articles and sources, as column transforms over a corpus."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import ARTICLE_LISTS, ARTICLE_STRINGS, SOURCE_LISTS, SOURCE_STRINGS
from .text import as_column, trim_blanks, with_once

MARKER = "---"
PREVIEW_BYTES = 1000

# Block-list items are joined to their key's line with this character.
_ITEM = "\u0001"
_KEY_LINE = rf"\A([A-Za-z_][A-Za-z0-9_-]*):(?:[ \t]+([^{_ITEM}].*?)|[ \t]*({_ITEM}.*?))?[ \t]*\z"
_IDLE_LINE = r"\A[ \t]*(#.*)?\z"
_QUOTED = r"""\A("[^"\\]*"|'([^']|'')*')\z"""
# A plain value starts with no YAML indicator and holds no mapping or comment mark.
_PLAIN = rf"""\A([^\s\-?:,\[\]{{}}#&*!|>'"%@`{_ITEM}]|-[^\s{_ITEM}])[^{_ITEM}]*\z"""
_NOT_PLAIN = r":(\s|\z)|\s#"
_FLOW_LIST = r"\A\[(.*)\]\z"
_NULLS = ("", "~", "null", "Null", "NULL")


def split_front_matter(docs: DataFrame, content: str = "content") -> DataFrame:
    """Add fm_text (null without front matter) and body."""
    parts = F.split(F.col(content), MARKER, 3)
    has = F.col(content).startswith(MARKER) & (F.size(parts) == 3)
    return docs.withColumns(
        {
            "fm_text": F.when(has, parts[1]),
            "body": F.when(has, trim_blanks(parts[2])).otherwise(F.col(content)),
        }
    )


# --- values of the flat subset, in native expressions -------------------------------------


def _is_scalar(value: Column, in_flow: bool = False) -> Column:
    plain = value.rlike(_PLAIN) & ~value.rlike(_NOT_PLAIN)
    if in_flow:
        plain = plain & ~value.rlike(r"[\[\]{},]")
    return value.rlike(_QUOTED) | plain


def _items(value: Column) -> Column:
    """Items of a block or flow list; null for a scalar."""
    inner = F.trim(F.regexp_extract(value, _FLOW_LIST, 1))
    return F.when(
        value.startswith(_ITEM),
        F.transform(F.split(F.substring(value, 2, 1 << 30), _ITEM), lambda v: F.trim(v)),
    ).when(
        value.rlike(_FLOW_LIST),
        F.when(inner == "", F.array().cast("array<string>")).otherwise(
            F.transform(F.split(inner, ","), lambda v: F.trim(v))
        ),
    )


def _is_flat(value: Column) -> Column:
    return (
        F.when(value == "", F.lit(True))
        .when(
            value.startswith(_ITEM),
            F.forall(_items(value), lambda v: _is_scalar(v)),
        )
        .when(
            value.rlike(_FLOW_LIST),
            F.forall(_items(value), lambda v: _is_scalar(v, in_flow=True)),
        )
        .otherwise(_is_scalar(value))
    )


def _text_of(value: Column) -> Column:
    """Text of a scalar: quotes off, a null is ''."""
    inner = F.substr(value, F.lit(2), F.length(value) - 2)
    return (
        F.when(value.rlike(_QUOTED) & value.startswith("'"), F.replace(inner, F.lit("''"), F.lit("'")))
        .when(value.rlike(_QUOTED), inner)
        .when(value.isin(*_NULLS), F.lit(""))
        .otherwise(value)
    )


def json_text(text: Column) -> Column:
    """JSON string of a text."""
    listed = F.to_json(F.array(text))
    return F.substr(listed, F.lit(2), F.length(listed) - 2)


def _json_scalar(value: Column) -> Column:
    return (
        F.when(value.rlike(_QUOTED), json_text(_text_of(value)))
        .when(value.isin(*_NULLS), F.lit("null"))
        .when(value.rlike(r"\A(true|True|TRUE|false|False|FALSE)\z"), F.lower(value))
        .when(value.rlike(r"\A-?(0|[1-9][0-9]*)\z"), value)
        .when(value.rlike(r"\A-?(0|[1-9][0-9]*)\.[0-9]+\z"), F.regexp_replace(value, r"\.?0+\z", ""))
        .when(value.rlike(r"\A0x[0-9a-fA-F]{1,15}\z"), F.conv(F.substr(value, F.lit(3)), 16, 10))
        .when(value.rlike(r"\A0o[0-7]{1,20}\z"), F.conv(F.substr(value, F.lit(3)), 8, 10))
        .when(
            value.rlike(r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}\z"),
            F.concat(F.lit('"'), value, F.lit('T00:00:00Z"')),
        )
        .otherwise(json_text(value))
    )


def _json_of(value: Column) -> Column:
    items = F.array_join(F.transform(_items(value), _json_scalar), ",")
    return F.when(
        value.startswith(_ITEM) | value.rlike(_FLOW_LIST),
        F.concat(F.lit("["), items, F.lit("]")),
    ).otherwise(_json_scalar(value))


# --- front matter beyond the flat subset ---------------------------------------------------


def _front_matter_type(strings: Sequence[str], lists: Sequence[str]) -> T.StructType:
    text, texts = T.StringType(), T.ArrayType(T.StringType())
    return T.StructType(
        [T.StructField(name, text) for name in strings]
        + [T.StructField(name, texts) for name in lists]
        + [T.StructField("rest", T.MapType(text, text)), T.StructField("parse_error", text)]
    )


def _json_value(node):
    """A node's value for JSON; plain scalars follow the rules of `_json_scalar`."""
    import yaml

    if isinstance(node, yaml.MappingNode):
        return {str(key.value): _json_value(value) for key, value in node.value}
    if isinstance(node, yaml.SequenceNode):
        return [_json_value(item) for item in node.value]
    text = node.value
    if node.style is not None:
        return text
    if text == "" or text in _NULLS:
        return None
    if re.fullmatch("true|True|TRUE|false|False|FALSE", text):
        return text.lower() == "true"
    if re.fullmatch("-?(0|[1-9][0-9]*)", text):
        return int(text)
    if re.fullmatch(r"-?(0|[1-9][0-9]*)\.[0-9]+", text):
        number = float(text)
        return int(number) if number.is_integer() else number
    if re.fullmatch("0x[0-9a-fA-F]{1,15}|0o[0-7]{1,20}", text):
        return int(text, 0)
    if re.fullmatch("[0-9]{4}-[0-9]{2}-[0-9]{2}", text):
        return f"{text}T00:00:00Z"
    return text


def _load_yaml(text: str, strings: Sequence[str], lists: Sequence[str]) -> dict:
    """Decode one mapping; fields of the wrong type are left out and noted as an error."""
    import yaml

    row = dict.fromkeys(strings, "") | dict.fromkeys(lists) | {"rest": {}, "parse_error": None}
    loader = yaml.SafeLoader(text)
    root = loader.get_single_node()
    if root is None:
        return row
    if not isinstance(root, yaml.MappingNode):
        if root.tag != "tag:yaml.org,2002:null":
            row["parse_error"] = "front matter is no mapping"
        return row
    keys = [key.value for key, _ in root.value]
    if len(set(map(str, keys))) < len(keys):
        row["parse_error"] = "key given twice"
        return row

    def text_of(node):
        return "" if node.tag == "tag:yaml.org,2002:null" else node.value

    for key, node in root.value:
        is_null = node.tag == "tag:yaml.org,2002:null"
        is_list = isinstance(node, yaml.SequenceNode) and all(
            isinstance(item, yaml.ScalarNode) for item in node.value
        )
        if key.value in strings and isinstance(node, yaml.ScalarNode):
            row[key.value] = text_of(node)
        elif key.value in lists and (is_list or is_null):
            row[key.value] = None if is_null else [text_of(item) for item in node.value]
        elif key.value in strings or key.value in lists:
            row["parse_error"] = f"wrong type for {key.value}"
        else:
            row["rest"][str(key.value)] = json.dumps(
                _json_value(node), ensure_ascii=False, separators=(",", ":")
            )
    return row


def _yaml_udf(strings: Sequence[str], lists: Sequence[str]):
    schema = _front_matter_type(strings, lists)

    @F.pandas_udf(schema)
    def load(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        empty = dict.fromkeys(schema.names)
        for texts in batches:
            rows = []
            for text in texts:
                if text is None:
                    rows.append(empty)
                    continue
                try:
                    rows.append(_load_yaml(text, strings, lists))
                except ImportError:
                    rows.append(empty | {"parse_error": "front matter needs a YAML reader"})
                except Exception as error:  # every malformed document is a row, not a failed job
                    rows.append(empty | {"parse_error": f"malformed: {type(error).__name__}"})
            yield pd.DataFrame(rows, columns=schema.names)

    return load


def extract_front_matter(
    docs: DataFrame,
    strings: Sequence[str],
    lists: Sequence[str],
    yaml_fallback: bool = True,
) -> DataFrame:
    """Add `fm`: the named string and list fields, other keys in `rest` as JSON, parse_error.

    Flat front matter (scalars, quoted scalars, flow and block lists of scalars) is read by native
    expressions in the scan; only the text of other documents is handed to a YAML reader, in Arrow
    batches.  Missing strings are '', missing lists null.
    """
    schema = _front_matter_type(strings, lists)
    joined = F.regexp_replace("fm_text", r"\r?\n[ \t]*-[ \t]+", _ITEM)
    lines = F.split(F.coalesce(joined, F.lit("")), r"\r?\n")
    entries = F.transform(
        F.filter(lines, lambda line: ~line.rlike(_IDLE_LINE)),
        lambda line: F.struct(
            F.regexp_extract(line, _KEY_LINE, 1).alias("key"),
            F.concat(
                F.regexp_extract(line, _KEY_LINE, 2), F.regexp_extract(line, _KEY_LINE, 3)
            ).alias("value"),
        ),
    )
    staged = with_once(docs, "_entries", entries)
    staged = with_once(
        staged,
        "_is",
        F.struct(
            (
                ~F.coalesce(F.col("fm_text"), F.lit("")).contains(_ITEM)
                & F.forall("_entries", lambda e: (e["key"] != "") & _is_flat(e["value"]))
            ).alias("flat"),
            (F.size("_entries") > F.size(F.array_distinct(F.col("_entries.key")))).alias("twice"),
        ),
    )
    usable = F.when(F.col("_is.flat") & ~F.col("_is.twice"), F.col("_entries")).otherwise(
        F.filter("_entries", lambda e: F.lit(False))
    )
    staged = with_once(staged, "_map", F.map_from_entries(usable))

    def is_list(v: Column) -> Column:
        return v.startswith(_ITEM) | v.rlike(_FLOW_LIST)

    def of_wrong_type(key: Column, v: Column) -> Column:
        listed = is_list(v)
        return F.when(key.isin(*strings), listed).otherwise(
            key.isin(*lists) & ~listed & ~v.isin(*_NULLS)
        )

    texts = F.transform_values(
        F.map_filter("_map", lambda k, v: k.isin(*strings) & ~is_list(v)), lambda k, v: _text_of(v)
    )
    listed = F.transform_values(
        F.map_filter("_map", lambda k, v: k.isin(*lists)),
        lambda k, v: F.transform(_items(v), _text_of),
    )
    rest = F.transform_values(
        F.map_filter("_map", lambda k, v: ~k.isin(*strings, *lists)), lambda k, v: _json_of(v)
    )
    wrong = F.map_keys(F.map_filter("_map", of_wrong_type))
    staged = with_once(
        staged,
        "_read",
        F.struct(
            texts.alias("texts"), listed.alias("lists"), rest.alias("rest"), wrong.alias("wrong")
        ),
    )
    native = F.struct(
        *[F.coalesce(F.col("_read.texts")[name], F.lit("")).alias(name) for name in strings],
        *[F.col("_read.lists")[name].alias(name) for name in lists],
        F.col("_read.rest").alias("rest"),
        F.when(F.col("_is.twice"), F.lit("key given twice"))
        .when(
            F.size("_read.wrong") > 0,
            F.concat(F.lit("wrong type for "), F.array_join("_read.wrong", ", ")),
        )
        .alias("parse_error"),
    ).cast(schema)
    if yaml_fallback:
        staged = staged.withColumn(
            "_loaded", _yaml_udf(strings, lists)(F.when(~F.col("_is.flat"), F.col("fm_text")))
        )
    else:
        unread = dict.fromkeys(schema.names, F.lit(None))
        unread["parse_error"] = F.lit("front matter is not flat")
        staged = staged.withColumn(
            "_loaded", F.struct(*[v.alias(n) for n, v in unread.items()]).cast(schema)
        )
    loaded = F.col("_loaded")
    other = F.struct(
        *[F.coalesce(loaded[name], F.lit("")).alias(name) for name in strings],
        *[loaded[name].alias(name) for name in lists],
        F.coalesce(loaded["rest"], F.create_map().cast("map<string,string>")).alias("rest"),
        loaded["parse_error"].alias("parse_error"),
    )
    chosen = F.when(F.col("_is.flat"), native)
    return with_once(staged, "fm", chosen.otherwise(other)).drop(
        "_entries", "_is", "_map", "_read", "_loaded"
    )


# --- single fields ------------------------------------------------------------------------


def file_name(path: Column | str) -> Column:
    return F.substring_index(as_column(path), "/", -1)


def heading_title(body: Column | str) -> Column:
    """Text of the first line that starts with '# '; '' without one."""
    return trim_blanks(F.regexp_extract(as_column(body), r"(?:\A|\n)# ([^\n]*)", 1))


def article_title(title: Column, body: Column, path: Column) -> Column:
    return F.coalesce(
        F.nullif(title, F.lit("")),
        F.nullif(heading_title(body), F.lit("")),
        F.regexp_replace(file_name(path), r"\.[^.]*\z", ""),
    )


def category(rel_path: Column | str) -> Column:
    return F.regexp_extract(as_column(rel_path), r"(?s)\A(.*)/[^/]+\z", 1)


def source_topic(related: Column, path: Column) -> Column:
    from_name = F.substring_index(F.regexp_replace(file_name(path), r"\.md\z", ""), "--", 1)
    return F.when(related == "", from_name).otherwise(related)


def default_id(given: Column, url: Column) -> Column:
    """The given id; else one made from the url, the same on every run."""
    return F.when(given == "", F.concat(F.lit("src-"), F.md5(url))).otherwise(given)


def default_created(given: Column, now: str | None = None) -> Column:
    """The given text; else the batch time, RFC 3339 in UTC."""
    clock = (
        F.lit(now)
        if now is not None
        else F.date_format(
            F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()),
            "yyyy-MM-dd'T'HH:mm:ss'Z'",
        )
    )
    return F.when(given == "", clock).otherwise(given)


def tags_to_json(tags: Column | str) -> Column:
    return F.coalesce(F.to_json(as_column(tags)), F.lit("null"))


def tags_from_json(text: Column | str) -> Column:
    return F.from_json(as_column(text), "array<string>")


def meta_json(fields: dict[str, Column], rest: Column) -> Column:
    """One JSON object of the fields (JSON texts) and `rest`, which wins; keys in order."""
    base = F.create_map(*[part for name, col in fields.items() for part in (F.lit(name), col)])
    own = F.map_filter(base, lambda k, v: ~F.map_contains_key(rest, k))
    entries = F.array_sort(F.map_entries(F.map_concat(own, rest)))
    pairs = F.transform(entries, lambda e: F.concat(json_text(e["key"]), F.lit(":"), e["value"]))
    return F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))


def embedding_text(title: Column, summary: Column, body: Column) -> Column:
    """Title, summary and the first 1000 bytes of the body; a cut character becomes U+FFFD."""
    preview = F.make_valid_utf8(
        F.substring(body.cast("binary"), 1, PREVIEW_BYTES).cast("string")
    )

    def added(text: Column, given: Column) -> Column:
        return F.when(given != "", F.concat(F.lit(" "), text)).otherwise(F.lit(""))

    return F.concat(title, added(summary, summary), added(preview, body))


# --- whole records ------------------------------------------------------------------------


def normalize_articles(docs: DataFrame, yaml_fallback: bool = True) -> DataFrame:
    """(path, rel_path, content) to article rows; malformed front matter leaves a note only."""
    fm = F.col("fm")
    rel_path = F.col("rel_path")
    parsed = extract_front_matter(
        split_front_matter(docs), ARTICLE_STRINGS, ARTICLE_LISTS, yaml_fallback
    ).withColumn("title", article_title(fm["title"], F.col("body"), rel_path))
    text = {name: json_text(fm[name]) for name in ("id", "author", "summary")}
    meta = {
        "id": text["id"],
        "title": json_text(F.col("title")),
        "author": text["author"],
        "summary": text["summary"],
        "tags": tags_to_json(fm["tags"]),
        "category": json_text(category(rel_path)),
    }
    return parsed.select(
        F.when(fm["id"] == "", rel_path).otherwise(fm["id"]).alias("id"),
        "title",
        rel_path.alias("path"),
        fm["author"].alias("author"),
        fm["summary"].alias("summary"),
        fm["tags"].alias("tags"),
        meta_json(meta, fm["rest"]).alias("meta_json"),
        category(rel_path).alias("category"),
        F.col("body").alias("content"),
        fm["parse_error"].alias("parse_error"),
    )


def normalize_sources(docs: DataFrame, now: str | None = None, yaml_fallback: bool = True) -> DataFrame:
    """(path, content) to source rows with path and parse_error; nothing is dropped."""
    fm = F.col("fm")
    parsed = extract_front_matter(
        split_front_matter(docs), SOURCE_STRINGS, SOURCE_LISTS, yaml_fallback
    )
    summary = F.when(fm["summary"] == "", trim_blanks("body")).otherwise(fm["summary"])
    return parsed.select(
        "path",
        fm["id"].alias("given_id"),
        default_id(fm["id"], fm["url"]).alias("id"),
        fm["url"].alias("url"),
        fm["title"].alias("title"),
        source_topic(fm["related_article"], F.col("path")).alias("topic"),
        summary.alias("summary"),
        fm["language"].alias("language"),
        fm["model"].alias("model"),
        default_created(fm["created"], now).alias("created_at"),
        fm["tags"].alias("tags"),
        fm["parse_error"].alias("parse_error"),
    )
