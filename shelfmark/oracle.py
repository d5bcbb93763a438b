"""The registered queries in SQL, over views of the same tables."""

from __future__ import annotations


def _tok(text: str) -> str:
    return f"regexp_extract_all(strip_accents(lower({text})), '[\\p{{L}}\\p{{N}}]+')"


def _trim(text: str) -> str:
    blank = r"[\t\n\x0B\f\r \x{85}\x{A0}\p{Z}]+"
    return f"regexp_replace({text}, '^{blank}|{blank}$', '', 'g')"


_LINE = "split_part(text, chr(10), 1)"
_REST = f"substr(text, length({_LINE}) + 2)"
_ARTICLE_FIELDS = {"title": _LINE, "content": _REST}
_SOURCE_FIELDS = {"summary": "text", "title": _LINE, "topic": "source"}
_BENCH = "SELECT item_id AS qid, text AS query FROM benchmark"


def _corpus(fields: dict[str, str], only: str = "true") -> str:
    """CTEs post (term, doc_id, field, pos), len and tot."""
    lists = " UNION ALL ".join(
        f"SELECT doc_id, '{name}' AS field, {_tok(text)} AS t FROM documents"
        for name, text in fields.items()
    )
    return f"""lists AS ({lists}),
len AS (SELECT doc_id, sum(len(t)) AS dl FROM lists GROUP BY doc_id),
tot AS (SELECT count(*)::DOUBLE AS n_docs, avg(dl) AS mean FROM len),
every AS (SELECT doc_id, field, unnest(t) AS term, generate_subscripts(t, 1) - 1 AS pos FROM lists),
post AS (SELECT * FROM every WHERE {only})"""


_TERM_UNITS = f"""units AS (SELECT qid, unit, count(*) AS weight FROM
  (SELECT qid, unnest({_tok('query')}) AS unit FROM queries) GROUP BY ALL)"""
_TERM_HITS = """hits AS (SELECT term AS unit, doc_id, count(*) AS tf FROM post
  WHERE term IN (SELECT unit FROM units) GROUP BY ALL)"""
_IDF = """asked AS (SELECT u.*, n, weight * CASE WHEN ln((n_docs - n + 0.5) / (n + 0.5)) <= 0
    THEN 1e-6 ELSE ln((n_docs - n + 0.5) / (n + 0.5)) END AS idf
  FROM units u JOIN (SELECT unit, count(*) AS n FROM hits GROUP BY unit) USING (unit), tot)"""


def _ranked(every_unit: bool, scored: str = "", where: str = "true", k: str = "10") -> str:
    need = "n_units = need" if every_unit else "true"
    source = scored or "hits JOIN asked USING (unit)"
    return f"""need AS (SELECT qid, count(*) AS need FROM units GROUP BY qid),
found AS (SELECT qid, doc_id, count(*) AS n_units,
    sum(floor(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean)) * 1e12 + 0.5)::BIGINT)::BIGINT AS points
  FROM {source} JOIN len USING (doc_id), tot GROUP BY qid, doc_id),
ranked AS (SELECT qid, doc_id, points,
    row_number() OVER (PARTITION BY qid ORDER BY points DESC, doc_id) AS rank
  FROM found JOIN need USING (qid) WHERE {need} AND {where})
SELECT qid, doc_id, ((points + 500000) // 1000000) / 1e6 AS score, rank FROM ranked JOIN queries USING (qid) WHERE rank <= {k}"""


def _search(every_unit: bool, fields=None, only: str = "true", queries: str = _BENCH, **more) -> str:
    return f"""WITH queries AS ({queries}), {_corpus(fields or _ARTICLE_FIELDS, only)},
{_TERM_UNITS}, {_TERM_HITS}, {_IDF}, {_ranked(every_unit, **more)}"""


def _excluding() -> str:
    return f"""WITH queries AS ({_BENCH}), {_corpus(_ARTICLE_FIELDS)},
{_TERM_UNITS}, {_TERM_HITS}, {_IDF},
barred AS (SELECT DISTINCT qid, doc_id FROM
  (SELECT qid, {_tok('query')}[-1] AS term FROM queries) JOIN post USING (term)),
{_ranked(False, where="(qid, doc_id) NOT IN (SELECT (qid, doc_id) FROM barred)")}"""


def _phrase() -> str:
    return f"""WITH queries AS ({_BENCH}), {_corpus(_ARTICLE_FIELDS)},
lists2 AS (SELECT qid, {_tok('query')} AS t FROM queries),
words AS (SELECT qid, len(t) AS m, unnest(t) AS term, generate_subscripts(t, 1) - 1 AS off FROM lists2),
units AS (SELECT DISTINCT qid, qid AS unit, 1 AS weight FROM words),
hits AS (SELECT qid AS unit, doc_id, count(*) AS tf FROM
  (SELECT qid, doc_id, field, pos - off AS start FROM words JOIN post USING (term)
   GROUP BY ALL HAVING count(*) = max(m)) GROUP BY ALL),
{_IDF}, {_ranked(True)}"""


def _prefix() -> str:
    return f"""WITH queries AS ({_BENCH}), {_corpus(_ARTICLE_FIELDS)}, {_TERM_UNITS},
pairs AS (SELECT DISTINCT u.unit, v.term FROM (SELECT DISTINCT unit FROM units) u
  JOIN (SELECT DISTINCT term FROM post) v ON starts_with(v.term, u.unit)),
hits AS (SELECT unit, doc_id, count(*) AS tf FROM pairs JOIN post USING (term) GROUP BY ALL),
{_IDF}, {_ranked(True)}"""


def _mixed_units() -> str:
    """Hits of a term, a prefix and a two-word phrase, summed, without documents that hold another phrase."""
    words = f"SELECT item_id AS qid, {_tok('text')} AS w FROM benchmark"

    def pair(first: int) -> str:
        return f"""SELECT qid, a.doc_id, count(*) AS tf FROM q JOIN post a ON a.term = w[{first}]
  JOIN post b ON b.term = w[{first + 1}] AND b.doc_id = a.doc_id AND b.field = a.field AND b.pos = a.pos + 1 GROUP BY ALL"""

    return f"""WITH q AS ({words}), {_corpus(_ARTICLE_FIELDS)},
hits AS (SELECT qid, 1 AS kind, doc_id, count(*) AS tf FROM q JOIN post ON term = w[3] GROUP BY ALL
  UNION ALL SELECT qid, 2, doc_id, count(*) FROM q JOIN post ON starts_with(term, left(w[4], 2)) GROUP BY ALL
  UNION ALL SELECT qid, 3, doc_id, tf FROM ({pair(1)})),
barred AS ({pair(5)}),
n AS (SELECT qid, kind, count(*) AS n FROM hits GROUP BY ALL),
asked AS (SELECT *, CASE WHEN ln((n_docs - n + 0.5) / (n + 0.5)) <= 0 THEN 1e-6
  ELSE ln((n_docs - n + 0.5) / (n + 0.5)) END AS idf FROM n, tot),
found AS (SELECT qid, doc_id, count(*) AS kinds,
  sum(floor(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean)) * 1e12 + 0.5)::BIGINT)::BIGINT AS points
  FROM hits JOIN asked USING (qid, kind) JOIN len USING (doc_id) GROUP BY qid, doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY points DESC, doc_id) AS rank FROM found
  WHERE kinds = 3 AND (qid, doc_id) NOT IN (SELECT (qid, doc_id) FROM barred))
SELECT qid, doc_id, ((points + 500000) // 1000000) / 1e6 AS score, rank FROM ranked WHERE rank <= 10"""


def _near(distance: int, queries: str = _BENCH) -> str:
    span = distance + 1
    return f"""WITH queries AS ({queries}), {_corpus(_ARTICLE_FIELDS)},
{_TERM_UNITS}, {_TERM_HITS}, {_IDF},
needs AS (SELECT qid, count(*) AS need1 FROM units GROUP BY qid),
full_docs AS (SELECT qid, doc_id, max(need1) AS need1 FROM hits JOIN units USING (unit) JOIN needs USING (qid)
  GROUP BY qid, doc_id HAVING count(*) = max(need1)),
places AS (SELECT qid, post.doc_id, field, pos, term, need1 FROM full_docs JOIN units USING (qid)
  JOIN post ON post.term = units.unit AND post.doc_id = full_docs.doc_id),
starts AS (SELECT *, count(DISTINCT term) OVER (PARTITION BY qid, doc_id, field ORDER BY pos
    RANGE BETWEEN CURRENT ROW AND {span} FOLLOWING) = need1 AS ok FROM places),
close AS (SELECT *, max(ok::INT) OVER (PARTITION BY qid, doc_id, field ORDER BY pos
    RANGE BETWEEN {span} PRECEDING AND CURRENT ROW) AS hit FROM starts),
group_hits AS (SELECT qid, doc_id, term AS unit, count(*) AS tf FROM close WHERE hit = 1 GROUP BY ALL),
{_ranked(True, scored="group_hits JOIN asked USING (qid, unit)")}"""


def _article_results() -> str:
    return f"""SELECT qid, rank, doc_id AS id, split_part(d.text, chr(10), 1) AS title,
  d.source AS summary, '["' || d.lang || '"]' AS tags
FROM ({_search(True)}) JOIN documents d USING (doc_id)"""


# --- articles -----------------------------------------------------------------------------

_BODY = f"""CASE WHEN source = 'src3' THEN text WHEN source = 'src7' THEN {_trim('text')}
  WHEN lang = 'fr' THEN {_trim("'# Titre ' || doc_id || ' ' || chr(10) || chr(10) || text")}
  ELSE {_trim('text')} END"""
_HEADING = _trim(r"regexp_extract(body, '(?:^|\n)# ([^\n]*)', 1)")
_FM = f"""fm AS (SELECT doc_id, lang, source, n_chars,
  source || '/' || lang || '/doc.' || doc_id || '.md' AS path,
  source NOT IN ('src3', 'src7') AS has,
  CASE WHEN has AND lang IN ('en', 'fr') THEN 'a-' || doc_id ELSE '' END AS id,
  CASE WHEN has AND lang = 'en' THEN 'Note ' || doc_id
       WHEN has AND lang = 'de' THEN 'Ding ' || doc_id ELSE '' END AS title,
  CASE WHEN has AND lang = 'en' THEN 'O''Hara' ELSE '' END AS author,
  CASE WHEN has AND lang = 'en' THEN 'About: ' || source
       WHEN has AND lang = 'de' THEN 'two lines' || chr(10) ELSE '' END AS summary,
  CASE WHEN NOT has THEN 'null' WHEN lang = 'en' THEN '["en","x y"]'
       WHEN lang = 'fr' THEN '["fr","' || source || '"]'
       WHEN lang = 'de' THEN '["de"]' ELSE 'null' END AS tags,
  CASE WHEN NOT has THEN '' WHEN lang = 'en' THEN 'draft,year' WHEN lang = 'fr' THEN 'category'
       WHEN lang = 'de' THEN '' ELSE 'listed' END AS rest_keys,
  source = 'src7' AS malformed, {_BODY} AS body FROM documents),
art AS (SELECT *, coalesce(nullif(title, ''), nullif({_HEADING}, ''), 'doc.' || doc_id) AS full_title,
  CASE WHEN id = '' THEN path ELSE id END AS full_id FROM fm)"""


def _embed_text() -> str:
    return f"""WITH {_FM},
chars AS (SELECT doc_id, unnest(string_split(left(body, 1000), '')) AS c,
    generate_subscripts(string_split(left(body, 1000), ''), 1) AS i FROM art WHERE body <> ''),
sums AS (SELECT *, sum(strlen(c)) OVER (PARTITION BY doc_id ORDER BY i) AS upto FROM chars),
cut AS (SELECT doc_id, string_agg(CASE WHEN upto <= 1000 THEN c WHEN upto - strlen(c) < 1000
    THEN chr(65533) ELSE '' END, '' ORDER BY i) AS preview FROM sums GROUP BY doc_id)
SELECT path, full_title || CASE WHEN summary <> '' THEN ' ' || summary ELSE '' END
  || coalesce(' ' || preview, '') AS text FROM art LEFT JOIN cut USING (doc_id)"""


# --- sources ------------------------------------------------------------------------------

_URL = "'https://example.org/' || md5(text)"
_INBOX = f"""inbox AS (SELECT doc_id, lang || '/' || source || '--' || lpad(doc_id::VARCHAR, 12, '0') || '.md' AS path,
  source = 'src7' AS bad,
  CASE WHEN bad THEN 'src-' || md5('') ELSE 's-' || doc_id END AS id,
  CASE WHEN bad OR source = 'src2' THEN '' ELSE {_URL} END AS url,
  CASE WHEN lang = 'en' AND NOT bad THEN 'on-' || source ELSE source END AS topic,
  CASE WHEN source = 'src4' THEN '' ELSE {_trim('text')} END AS summary,
  CASE WHEN bad THEN '' ELSE lang END AS language FROM documents)"""
_ROUTED = f"""{_INBOX},
known AS (SELECT {_URL} AS url, 's-' || min(doc_id) AS stored_id FROM documents
  WHERE doc_id IN (SELECT doc_id FROM labels) GROUP BY text),
refused AS (SELECT path, CASE WHEN bad THEN 'error' ELSE 'skipped' END AS outcome,
  CASE WHEN bad THEN 'malformed' WHEN url = '' THEN 'no_url' ELSE 'no_summary' END AS reason,
  NULL::VARCHAR AS existing_id FROM inbox WHERE bad OR url = '' OR summary = ''),
asked AS (SELECT i.*, stored_id, first_value(id) OVER (PARTITION BY url ORDER BY path) AS first_id,
  row_number() OVER (PARTITION BY url ORDER BY path) AS nth
  FROM inbox i LEFT JOIN known USING (url) WHERE NOT (bad OR url = '' OR summary = '')),
outcomes AS (SELECT path, CASE WHEN stored_id IS NULL AND nth = 1 THEN 'processed' ELSE 'skipped' END AS outcome,
  CASE WHEN stored_id IS NULL AND nth = 1 THEN '' ELSE 'exists' END AS reason,
  CASE WHEN stored_id IS NULL AND nth = 1 THEN NULL ELSE coalesce(stored_id, first_id) END AS existing_id
  FROM asked UNION ALL SELECT * FROM refused)"""
_INGEST_RUN = f"""WITH {_ROUTED.replace("FROM documents" + chr(10) + "  WHERE doc_id IN (SELECT doc_id FROM labels) GROUP BY text", "FROM documents WHERE false GROUP BY text")}
SELECT o.path, outcome, reason, existing_id, CASE WHEN outcome = 'processed' THEN i.id END AS id,
  CASE WHEN outcome = 'processed' THEN url END AS url, CASE WHEN outcome = 'processed' THEN topic END AS topic,
  CASE WHEN outcome = 'processed' THEN (len({_tok('summary')}) + len({_tok('topic')}))::BIGINT END AS n_tokens,
  CASE WHEN outcome = 'processed' THEN 64 END AS dim FROM outcomes o JOIN inbox i USING (path)"""
_SOURCES = f"""src AS (SELECT 's-' || min(doc_id) AS id, {_URL} AS url, {_LINE} AS title,
  arg_min(source, doc_id) AS topic, arg_min(lang, doc_id) AS language FROM documents GROUP BY text)"""


def _upsert(second: str) -> str:
    row = "lang || '-' || n_chars AS id, md5(text) AS u, source AS topic, doc_id AS seq"
    return f"""WITH turns AS (
  SELECT 0 AS b, {row} FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)
  UNION ALL SELECT 1, {row} FROM documents),
marked AS (SELECT *, max((b, seq)) OVER (PARTITION BY id) AS last_id,
  max((b, seq)) OVER (PARTITION BY u) AS last_u FROM turns)
SELECT id, u AS {second}, topic, seq FROM marked WHERE last_id = (b, seq) AND last_u = (b, seq)"""


# --- vectors ------------------------------------------------------------------------------

_CENTROIDS = """cells AS (SELECT label, unnest(embedding) AS x,
    generate_subscripts(embedding, 1) AS pos FROM embeddings),
means AS (SELECT label, pos, avg(x::DOUBLE)::FLOAT AS x FROM cells GROUP BY ALL),
cent AS (SELECT label AS qid, label, list(x ORDER BY pos) AS mean FROM means GROUP BY label)"""
_COSINE = "round(list_cosine_similarity(embedding::DOUBLE[], mean::DOUBLE[]), 6)"


def _knn(condition: str, k: str = "10") -> str:
    return f"""WITH {_CENTROIDS},
scored AS (SELECT qid, vec_id AS id, {_COSINE.replace(", 6)", ", 12)")} AS score FROM embeddings e JOIN cent c ON {condition}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM scored)
SELECT qid, id, round(score, 6) AS score, rank FROM ranked WHERE rank <= {k}"""


def _hashed(table: str, key: str, dim: int = 64) -> str:
    """Slots of the hashed embedding: key, slot, x."""
    return f"""SELECT {key}, slot, (s / sqrt(sum(s * s) OVER (PARTITION BY {key})))::FLOAT AS x FROM (
  SELECT {key}, h // 2 AS slot, sum(CASE WHEN h % 2 = 0 THEN 1 ELSE -1 END)::DOUBLE AS s FROM (
    SELECT {key}, ('0x' || substr(md5(t), 1, 8))::BIGINT % {2 * dim} AS h FROM (
      SELECT {key}, unnest({_tok('text')}) AS t FROM {table})) GROUP BY ALL)"""


def _semantic(asked: str) -> str:
    """Hits of the requests that `asked` gives as (qid, topic, most)."""
    return f"""WITH q AS ({_hashed('benchmark', 'item_id')}), d AS ({_hashed('documents', 'doc_id')}),
asked AS ({asked}),
norm AS (SELECT doc_id, source, sqrt(sum(x::DOUBLE * x)) AS nd FROM d JOIN documents USING (doc_id) GROUP BY ALL),
qnorm AS (SELECT item_id, sqrt(sum(x::DOUBLE * x)) AS nq FROM q GROUP BY item_id),
dots AS (SELECT item_id, doc_id, sum(q.x::DOUBLE * d.x) AS dot FROM q JOIN d USING (slot) GROUP BY ALL),
pairs AS (SELECT qid, most, doc_id AS id, round(coalesce(dot, 0) / (nq * nd), 12) AS score
  FROM asked JOIN qnorm ON item_id = qid JOIN norm ON topic IN ('', source) LEFT JOIN dots USING (item_id, doc_id)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM pairs)
SELECT qid, id, round(score, 6) AS score, rank FROM ranked WHERE rank <= most"""


_SEMANTIC = _semantic("SELECT item_id AS qid, '' AS topic, 10 AS most FROM benchmark")
_SEMANTIC_LIMITS = _semantic("""SELECT item_id AS qid,
  CASE WHEN item_id % 5 = 1 THEN 'src' || item_id % 20 ELSE '' END AS topic,
  CASE WHEN item_id * 7 % 40 > 4 THEN item_id * 7 % 40 - 4 ELSE 10 END AS most
  FROM benchmark WHERE item_id % 5 < 3""")
_REFUSED = """SELECT item_id AS qid,
  CASE WHEN item_id % 5 = 4 THEN 'no_query' ELSE 'wrong_vector' END AS reason FROM benchmark WHERE item_id % 5 >= 3"""

_DECODE = """WITH raw AS (SELECT doc_id, hex(from_base64(md5(text))) AS h FROM documents),
parts AS (SELECT doc_id, i AS pos, substr(h, 8 * i + 1, 8) AS p FROM raw, range(6) r(i)),
bits AS (SELECT doc_id, pos,
  ('0x' || substr(p, 7, 2) || substr(p, 5, 2) || substr(p, 3, 2) || substr(p, 1, 2))::BIGINT AS b FROM parts),
fields AS (SELECT doc_id, pos, b >> 31 AS s, (b >> 23) & 255 AS e, b & 8388607 AS m FROM bits),
kinds AS (SELECT *, CASE WHEN e = 255 AND m = 0 THEN 'inf' WHEN e = 255 THEN 'nan'
  WHEN e = 0 AND m = 0 THEN 'zero' ELSE 'number' END AS kind FROM fields)
SELECT doc_id, pos, kind, CASE WHEN kind = 'number' THEN 1.0::DOUBLE - 2 * s END AS sign,
  CASE WHEN kind <> 'number' THEN NULL WHEN e = 0 THEN round(log2(m) - 149, 6)
    ELSE round(log2(1 + m / 8388608.0::DOUBLE) + e - 127, 6) END AS log2 FROM kinds"""

_ULID = """WITH ids AS (SELECT doc_id, '0' || substr(upper(md5(text)), 1, 25) AS u FROM documents),
bits AS (SELECT doc_id, substr(list_aggregate(list_transform(string_split(u, ''),
  lambda c: right('00000' || bin(('0x' || c)::BIGINT), 5)), 'string_agg', ''), 3) AS b FROM ids),
hexed AS (SELECT doc_id, lower(list_aggregate(list_transform(range(32),
  lambda i: substr('0123456789abcdef', (1 + 8 * substr(b, 4 * i + 1, 1)::INT + 4 * substr(b, 4 * i + 2, 1)::INT
    + 2 * substr(b, 4 * i + 3, 1)::INT + substr(b, 4 * i + 4, 1)::INT)::INT, 1)), 'string_agg', '')) AS x FROM bits)
SELECT doc_id, substr(x, 1, 8) || '-' || substr(x, 9, 4) || '-' || substr(x, 13, 4) || '-'
  || substr(x, 17, 4) || '-' || substr(x, 21, 12) AS uuid FROM hexed"""

_INFO = """SELECT source AS key, coalesce(max(l.n), count(*))::VARCHAR AS value FROM documents
LEFT JOIN (SELECT source, count(*) AS n FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)
  GROUP BY source) l USING (source) GROUP BY source"""

_ROUTES = """WITH r AS (SELECT doc_id, CASE WHEN lang = 'fr' THEN '' ELSE source END AS query,
  CASE WHEN lang = 'de' THEN md5(text) ELSE '' END AS embedding, n_chars - 1000 AS l FROM documents)
SELECT doc_id, CASE WHEN embedding <> '' THEN 'vector' WHEN query <> '' THEN 'text' ELSE 'rejected' END AS route,
  CASE WHEN l > 0 THEN l ELSE 10 END AS "limit",
  CASE WHEN regexp_full_match(split_part(embedding, 'a', 1), '[+-]?[0-9]+')
    AND try_cast(split_part(embedding, 'a', 1) AS INT) > 0
    THEN split_part(embedding, 'a', 1)::BIGINT ELSE 100 END AS list_limit FROM r"""


def oracle_sql() -> dict[str, str]:
    text_tokens = f"SELECT doc_id, {_tok('text')} AS t FROM documents"
    in_labels = "(SELECT doc_id FROM labels)"
    return {
        "bm25_all": _search(True),
        "bm25_any": _search(False),
        "bm25_exclude": _excluding(),
        "bm25_limits": _search(
            False,
            queries="SELECT item_id AS qid, text AS query, length(text) // 50 - 3 AS l FROM benchmark",
            k="(CASE WHEN l > 0 THEN l ELSE 10 END)",
        ),
        "phrase": _phrase(),
        "prefix": _prefix(),
        "field_filter": _search(False, only="field = 'title'"),
        "field_start": _search(False, only="pos = 0"),
        "near": _near(40),
        "near_words": _near(6, f"SELECT item_id AS qid, array_to_string({_tok('text')}[2:3], ' ') AS query FROM benchmark"),
        "prefix_terms": f"""WITH words AS (SELECT DISTINCT unnest({_tok('text')}) AS w FROM benchmark),
prefixes AS (SELECT DISTINCT left(w, n) AS prefix FROM words, range(1, 6) r(n) WHERE length(w) >= n),
terms AS (SELECT DISTINCT unnest({_tok('text')}) AS term FROM documents)
SELECT prefix, count(*) AS n, min(term) AS "first", max(term) AS "last" FROM prefixes JOIN terms
  ON starts_with(term, prefix) GROUP BY prefix""",
        "mixed_units": _mixed_units(),
        "source_text_search": _search(
            True, _SOURCE_FIELDS, queries="SELECT DISTINCT source AS qid, source AS query FROM documents"
        ),
        "article_results": _article_results(),
        "term_stats": f"""SELECT term, count(*) AS n_docs, sum(tf)::BIGINT AS n_occurrences FROM
  (SELECT term, doc_id, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM ({text_tokens}))
   GROUP BY ALL) GROUP BY term""",
        "doc_stats": f"SELECT doc_id, len(t)::BIGINT AS n_tokens FROM ({text_tokens})",
        "corpus_stats": f"""SELECT count(*) AS n_docs, sum(len(t))::BIGINT AS n_tokens,
  round(avg(len(t)), 4) AS mean_tokens FROM ({text_tokens})""",
        "knn_all": _knn("true"),
        "knn_label": _knn("e.label = c.label"),
        "scroll_label": """SELECT label, vec_id AS id, 1.0::DOUBLE AS score, rank FROM (SELECT *,
  row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rank FROM embeddings) WHERE rank <= 10""",
        "pair_cosine": f"WITH {_CENTROIDS} SELECT vec_id AS id, {_COSINE} AS score FROM embeddings JOIN cent USING (label)",
        "decode_vectors": _DECODE,
        "embed_docs": f"SELECT doc_id, slot, round(x::DOUBLE, 6) AS x FROM ({_hashed('documents', 'doc_id')}) WHERE x <> 0",
        "embed_strict": f"SELECT doc_id, 64 AS dim FROM ({text_tokens}) WHERE len(t) > 0",
        "semantic_search": _SEMANTIC,
        "semantic_limits": _SEMANTIC_LIMITS,
        "refused_requests": _REFUSED,
        "vector_requests": _knn("c.label % 2 = 0 OR e.label = c.label", k="qid + 3"),
        "payloads": f"""WITH {_SOURCES} SELECT id AS uuid, id, url, title, topic, language, '' AS model,
  '2025-01-01T00:00:00Z' AS created_at FROM src""",
        "ulid_to_uuid": _ULID,
        "front_matter": f"""WITH {_FM} SELECT doc_id, id, title, author, summary, tags, rest_keys,
  malformed, md5(body) AS body_md5 FROM fm""",
        "article_rows": f"""WITH {_FM} SELECT path, full_id AS id, full_title AS title,
  source || '/' || lang AS category, tags FROM art""",
        "meta_json": f"""WITH {_FM} SELECT path, id, full_title AS title, author, summary,
  CASE WHEN has AND lang = 'fr' THEN 'own' ELSE source || '/' || lang END AS category,
  CASE WHEN has AND lang = 'en' THEN n_chars::VARCHAR END AS year,
  CASE WHEN has AND lang = 'en' THEN 'true' END AS draft,
  nullif(tags, 'null') AS tags,
  CASE WHEN rest_keys = 'listed' THEN '[1,"b"]' END AS listed FROM art""",
        "tags_text": f"""WITH {_FM} SELECT path, tags AS tags_json, CASE WHEN tags = 'null' THEN ''
  ELSE replace(replace(replace(tags, '["', ''), '"]', ''), '","', ' ') END AS tags_text FROM art""",
        "embed_text": _embed_text(),
        "source_fields": f"""WITH {_INBOX} SELECT path, id, url, topic, language,
  '2025-01-01T00:00:00Z' AS created_at, md5(summary) AS summary_md5 FROM inbox""",
        "ingest_outcomes": f"WITH {_ROUTED} SELECT * FROM outcomes",
        "ingest_report": f"WITH {_ROUTED} SELECT outcome, reason, count(*) AS n FROM outcomes GROUP BY ALL",
        "ingest_totals": f"""WITH {_ROUTED} SELECT count(*) FILTER (outcome = 'processed') AS processed,
  count(*) FILTER (outcome = 'skipped') AS skipped, count(*) FILTER (outcome = 'error') AS errors FROM outcomes""",
        "consumed_files": f"""WITH {_ROUTED} SELECT path FROM outcomes
WHERE outcome = 'processed' OR reason = 'exists'""",
        "dry_run": f"""WITH {_INBOX} SELECT path, id, url, topic FROM inbox
WHERE NOT (bad OR url = '' OR summary = '')""",
        "valid_records": "SELECT doc_id, source <> 'src2' AND text <> '' AS valid FROM documents",
        "request_routes": _ROUTES,
        "upsert_two_keys": _upsert("url"),
        "upsert_articles": _upsert("path"),
        "upsert_vectors": """SELECT 'v-' || md5(label::VARCHAR) AS uuid, max(vec_id) AS id,
  max(vec_id) AS seq, label, round(arg_max(embedding[1], vec_id)::DOUBLE, 4) AS first_value,
  max(len(embedding))::INT AS n FROM embeddings GROUP BY label""",
        "rejected_vectors": "SELECT vec_id AS id FROM embeddings WHERE vec_id % 7 = 0 OR vec_id % 11 = 0",
        "failed_embeddings": """SELECT doc_id, length(text) % 5 <> 0 AS embedded,
  CASE WHEN length(text) % 5 <> 0 THEN length(text) END AS n FROM documents""",
        "article_payloads": f"""WITH {_FM} SELECT full_id AS uuid, full_id AS id, full_title AS title, path,
  source || '/' || lang AS category FROM art""",
        "source_results": f"""WITH {_SOURCES}, long AS (SELECT {_URL} AS url, max(length(text)) AS n FROM documents GROUP BY text)
SELECT topic AS qid, id, id AS source_id, n::DOUBLE AS score, url, title, topic, language, '' AS model,
  '2025-01-01T00:00:00Z' AS created_at, 1 AS rank FROM src JOIN long USING (url)""",
        "store_cycle": f"""WITH first AS (SELECT max(doc_id) AS doc_id, {_URL} AS url FROM documents GROUP BY text),
rows AS (SELECT doc_id, url FROM first WHERE doc_id % 3 <> 0
  UNION ALL SELECT doc_id, 'https://example.org/new/' || doc_id FROM documents WHERE doc_id % 3 = 0)
SELECT 's-' || doc_id AS id, url, 1 AS vectors, 1 AS entries FROM rows WHERE doc_id % 5 <> 0""",
        "index_report": """SELECT name, n, '' AS "value" FROM (VALUES ('skipped', 0), ('errors', 0), ('sources', 0)) v(name, n)
UNION ALL SELECT unnest(['indexed', 'articles']), count(*), '' FROM documents UNION ALL SELECT 'version', 1, 'second'""",
        "indexed_articles": f"""WITH {_FM} SELECT full_id AS id, path, full_title AS title, 1 AS vectors,
  (len({_tok('body')}) + len({_tok('full_title')}) + len({_tok('summary')})
    + CASE WHEN tags = 'null' THEN 0 ELSE len({_tok('tags')}) END)::BIGINT AS n_tokens FROM art""",
        "ingest_run": _INGEST_RUN,
        "json_records": """SELECT CASE WHEN source <> 'src7' THEN 's-' || doc_id END AS id,
  CASE WHEN source <> 'src7' THEN md5(text) END AS url,
  CASE WHEN source <> 'src7' THEN CASE WHEN lang <> 'en' THEN source ELSE '' END END AS topic,
  CASE WHEN source <> 'src7' THEN '' END AS model, CASE WHEN source <> 'src7' THEN md5(text) END AS summary_md5,
  CASE WHEN source <> 'src7' THEN '["' || lang || '"]' END AS tags,
  CASE WHEN source = 'src7' THEN '{"id": "s-' || doc_id END AS bad FROM documents""",
        "json_requests": """SELECT CASE WHEN k <> 1 THEN md5(text) END AS query,
  CASE WHEN k <> 1 THEN 't' || item_id ELSE '{"query": "' || md5(text) || '", "topic": "t' || item_id || '", "limit": "many"}' END AS topic,
  CASE WHEN k > 1 THEN item_id END AS "limit", k <> 1 AS valid FROM (SELECT *, item_id % 4 AS k FROM benchmark)""",
        "delete_ids": f"SELECT doc_id AS id, source FROM documents WHERE doc_id NOT IN {in_labels}",
        "lookup_id": f"""WITH {_SOURCES} SELECT id, url, topic FROM src
WHERE id IN (SELECT 's-' || doc_id FROM labels)""",
        "lookup_url": f"""WITH {_SOURCES} SELECT id, url, topic FROM src
WHERE url IN (SELECT {_URL} FROM documents WHERE doc_id IN {in_labels})""",
        "lookup_articles": f"""WITH {_FM} SELECT full_id AS id, path, full_title AS title FROM art
WHERE id IN (SELECT 'a-' || doc_id FROM labels)""",
        "list_topics": """SELECT id, topic, rank FROM (SELECT doc_id AS id, source AS topic,
  row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rank FROM documents) WHERE rank <= 10""",
        "list_all": "SELECT doc_id AS id, source AS topic FROM documents ORDER BY doc_id LIMIT 100",
        "counts": """SELECT 'sources' AS name, count(DISTINCT text) AS n FROM documents
UNION ALL SELECT 'articles', count(*) FROM documents""",
        "info": _INFO,
        "info_get": f"""SELECT k.key, coalesce(i.value, '') AS value FROM
  (SELECT source AS key FROM documents UNION SELECT lang FROM documents) k LEFT JOIN ({_INFO}) i USING (key)""",
        "health": """SELECT 'ok' AS status, count(DISTINCT text) AS source_count, count(*) AS article_count,
  max(doc_id)::VARCHAR AS version FROM documents""",
    }
