"""Registered queries over the test tables, with the SQL that DuckDB answers them by.

`pages` are registered Markdown documents (personal ones on www hosts, else of the source named by
their host), `documents` are manual pages and the texts that are searched, `conversations` are
documents whose turns are sections.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.functions.patterns import Pattern
from docloom.operators import admin, catalog, outline, resolve, scope, search

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _register(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    host = F.regexp_extract("url", "://([^/?#]*)", 1)
    logical = F.regexp_replace(F.regexp_replace(F.regexp_extract("url", "://[^/?#]*/?([^?#]*)", 1), r"\.html$", ""), "/$", "")
    personal = host.startswith("www.")
    return _read(spark, sf_dir, "pages").select(
        F.element_at(F.split(logical, "/"), -1).alias("name"), logical.alias("logical_path"), F.lit("markdown").alias("kind"),
        F.when(personal, "documents").otherwise("source").alias("origin"), F.when(~personal, host).alias("source_name"),
        F.when(~personal, F.length(host) % 3 - 1).cast("int").alias("source_priority"), F.lit(None).cast("string").alias("manual_section"), F.col("url").alias("path"),
    )


def _manual_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    section = F.when(F.col("lang") == "en", "1").when(F.col("lang") == "de", "3").when(F.col("lang") == "fr", "8").otherwise("5")
    return _read(spark, sf_dir, "documents").select(
        F.col("source").alias("name"), section.alias("manual_section"), F.col("doc_id").cast("string").alias("path"), (F.col("doc_id") % 7).alias("root_ord"), (F.col("n_chars") % 4).alias("locale_rank")
    )


def _catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    manuals = catalog.first_manual_pages(_manual_files(spark, sf_dir)).select(
        "name", F.col("name").alias("logical_path"), F.lit("manual").alias("kind"), F.lit("manual-path").alias("origin"), "manual_section", "path"
    )
    return catalog.merge_catalog(_markdown(spark, sf_dir), manuals)


_SQL_CATALOG = r"""
WITH page AS (SELECT url, regexp_extract(url, '://([^/?#]*)', 1) AS host,
    regexp_replace(regexp_replace(regexp_extract(url, '://[^/?#]*/?([^?#]*)', 1), '\.html$', ''), '/$', '') AS lp FROM pages),
man AS (SELECT source AS name, CASE lang WHEN 'en' THEN '1' WHEN 'de' THEN '3' WHEN 'fr' THEN '8' ELSE '5' END AS manual_section, doc_id::VARCHAR AS path,
    doc_id % 7 AS root_ord, n_chars % 4 AS locale_rank FROM documents),
manual_index AS (SELECT * EXCLUDE n FROM (SELECT *, row_number() OVER (PARTITION BY name, manual_section ORDER BY root_ord, locale_rank, path) AS n FROM man) WHERE n = 1),
raw_catalog AS (
  SELECT string_split(lp, '/')[-1] AS name, lp AS logical_path, 'markdown' AS kind, CASE WHEN starts_with(host, 'www.') THEN 'documents' ELSE 'source' END AS origin,
    CASE WHEN NOT starts_with(host, 'www.') THEN host END AS source_name, CASE WHEN NOT starts_with(host, 'www.') THEN (length(host) % 3 - 1)::INT END AS source_priority,
    NULL::VARCHAR AS manual_section, url AS path FROM page
  UNION ALL SELECT name, name, 'manual', 'manual-path', NULL, NULL, manual_section, path FROM manual_index),
catalog AS (
  SELECT CASE WHEN kind = 'manual' THEN 'manual/' || manual_section || '/' || name WHEN origin = 'source' THEN 'sources/' || source_name || '/' || logical_path ELSE 'documents/' || logical_path END AS catalog_path,
    *, CASE WHEN kind = 'manual' THEN 2 WHEN origin = 'documents' THEN 0 WHEN source_priority > 0 THEN 1 ELSE 3 END AS precedence_class FROM raw_catalog)
"""

_register("catalog_list", _SQL_CATALOG + "SELECT * FROM catalog")(_catalog)


@_register("manual_index", _SQL_CATALOG + """SELECT name, manual_section, path, root_ord, locale_rank::BIGINT AS locale_rank,
  (CASE manual_section WHEN '1' THEN 1 WHEN '8' THEN 5 WHEN '3' THEN 6 WHEN '5' THEN 12 END)::BIGINT AS section_rank FROM manual_index""")  # fmt: skip
def _manual_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = catalog.first_manual_pages(_manual_files(spark, sf_dir))
    return rows.withColumn("section_rank", F.col("section_rank").cast("long"))


@_register("catalog_coverage", _SQL_CATALOG + """SELECT (SELECT string_agg(DISTINCT manual_section, ',' ORDER BY manual_section) FROM catalog) AS sections,
  (SELECT string_agg(DISTINCT source_name, ',' ORDER BY source_name) FROM catalog) AS sources, bool_or(origin = 'documents') AS personal, count(*) FILTER (kind = 'manual') AS scope_total FROM catalog""")  # fmt: skip
def _coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = catalog.coverage(_catalog(spark, sf_dir), catalog.CatalogQuery(pattern="x", kind="manual"))
    return row.select(F.array_join("sections", ",").alias("sections"), F.array_join("sources", ",").alias("sources"), "personal", "scope_total")


def _sql_find(pattern: str) -> str:
    p = pattern.lower()
    score = lambda c: f"""CASE WHEN lower({c}) = '{p}' THEN 0 + CASE WHEN {c} = '{pattern}' THEN 0 ELSE 1 END
      WHEN ends_with(lower({c}), '/{p}') THEN 10 + CASE WHEN ends_with({c}, '/{pattern}') THEN 0 ELSE 1 END
      WHEN starts_with(lower({c}), '{p}') THEN 20 + CASE WHEN starts_with({c}, '{pattern}') THEN 0 ELSE 1 END
      WHEN contains(lower({c}), '{p}') THEN 30 + CASE WHEN contains({c}, '{pattern}') THEN 0 ELSE 1 END ELSE 42 END"""  # noqa: E731
    candidates = ["name", "logical_path"] + (["catalog_path"] if "/" in pattern else [])
    return f""", scored AS (SELECT *, least({', '.join(map(score, candidates))}) AS sc FROM catalog),
    found AS (SELECT *, row_number() OVER (ORDER BY sc, lower(logical_path), logical_path, lower(name), name, precedence_class, source_priority DESC NULLS LAST, source_name NULLS FIRST,
      manual_section NULLS FIRST, origin, path) AS ordinal, count(*) OVER () AS total FROM scored WHERE sc < 40)
    SELECT * EXCLUDE sc, (sc // 10)::INT AS relevance, (sc % 10)::INT AS spelling FROM found"""


for _name, _pattern, _limit, _offset in (("catalog_find_literal", "2", None, 0), ("catalog_find_path", "en/5", None, 0), ("catalog_find_case", "SRC1", None, 0), ("catalog_page", "1", 15, 10)):
    _register(_name, _SQL_CATALOG + _sql_find(_pattern) + (f" WHERE ordinal > {_offset} AND ordinal <= {_offset + _limit}" if _limit else ""))(
        lambda spark, sf_dir, p=_pattern, n=_limit, o=_offset: catalog.find(_catalog(spark, sf_dir), catalog.CatalogQuery(pattern=p, limit=n, offset=o))
    )


@_register("catalog_find_regex", _SQL_CATALOG + r"""SELECT * FROM (SELECT *, 5 AS relevance, 2 AS spelling, row_number() OVER (ORDER BY lower(logical_path), logical_path, lower(name), name, precedence_class,
  source_priority DESC NULLS LAST, source_name NULLS FIRST, manual_section NULLS FIRST, origin, path) AS ordinal, count(*) OVER () AS total
  FROM catalog WHERE regexp_matches(name, '(?i)^[0-9]*7$') OR regexp_matches(logical_path, '(?i)^[0-9]*7$'))""")  # fmt: skip
def _find_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.find(_catalog(spark, sf_dir), catalog.CatalogQuery(pattern="^[0-9]*7$", syntax="regex", limit=None))


@_register("catalog_scope", _SQL_CATALOG + "SELECT catalog_path, path FROM catalog WHERE kind = 'manual' AND manual_section = '3'")
def _scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.in_scope(_catalog(spark, sf_dir), catalog.CatalogQuery(kind="manual", manual_section="3")).select("catalog_path", "path")


@_register("catalog_addresses", _SQL_CATALOG + """SELECT catalog_path, path, kind AS parsed_kind, origin AS parsed_origin0, source_name AS parsed_source, logical_path AS parsed_path, manual_section AS parsed_section
  FROM (SELECT catalog_path, path, kind, CASE WHEN kind = 'manual' THEN 'manual' ELSE origin END AS origin, source_name, logical_path, manual_section FROM catalog)""")  # fmt: skip
def _addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = catalog.parse_address(F.col("catalog_path"))
    return _catalog(spark, sf_dir).select("catalog_path", "path", a["kind"].alias("parsed_kind"), a["origin"].alias("parsed_origin0"), a["source_name"].alias("parsed_source"), a["logical_path"].alias("parsed_path"), a["manual_section"].alias("parsed_section"))


@_register("finder_tree", _SQL_CATALOG + """, p AS (SELECT string_split(catalog_path, '/') AS parts FROM catalog),
  f AS (SELECT array_to_string(parts[1:n], '/') AS folder FROM p, unnest(range(1, len(parts))) t(n))
  SELECT folder, count(*) AS documents, len(string_split(folder, '/'))::BIGINT AS depth FROM f GROUP BY folder""")  # fmt: skip
def _tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.folder_tree(_catalog(spark, sf_dir))


@_register("catalog_grouped_text", _SQL_CATALOG + """SELECT CASE WHEN kind = 'manual' THEN 'manual/' || manual_section WHEN origin = 'source' THEN 'sources/' || source_name ELSE 'documents' END AS namespace,
  string_agg(logical_path, chr(10) ORDER BY logical_path) AS body, count(*) AS documents FROM catalog GROUP BY 1""")  # fmt: skip
def _grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.catalog_text(_catalog(spark, sf_dir), grouped=True)


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selectors: the last path component of every page, and every manual's name."""
    pages = _markdown(spark, sf_dir).where("name <> ''").select(F.col("name").alias("selector"))
    names = pages.unionByName(_read(spark, sf_dir, "documents").select(F.col("source").alias("selector"))).where("selector IS NOT NULL").distinct()
    return names.select("selector", F.col("selector").alias("name"), F.lit(0).alias("cand_ord"))


_SQL_RESOLVE = _SQL_CATALOG + r""", s AS (SELECT name AS selector FROM raw_catalog WHERE kind = 'markdown' AND name <> '' UNION SELECT source FROM documents WHERE source IS NOT NULL),
c AS (SELECT s.selector, catalog.*, catalog.logical_path = s.selector AS is_exact FROM s JOIN catalog ON kind = 'markdown' AND name = s.selector AND (logical_path = s.selector OR ends_with(logical_path, '/' || s.selector))
  UNION ALL SELECT s.selector, catalog.*, true FROM s JOIN catalog ON kind = 'manual' AND name = s.selector),
k AS (SELECT *, CASE WHEN kind = 'manual' THEN 1 WHEN origin = 'documents' OR source_priority > 0 THEN 0 ELSE 2 END AS phase FROM c),
r AS (SELECT *, dense_rank() OVER (PARTITION BY selector ORDER BY phase, CASE WHEN origin = 'documents' THEN 0 ELSE 1 END, source_priority DESC NULLS LAST, source_name NULLS FIRST, is_exact DESC,
  CASE WHEN kind = 'manual' THEN CASE manual_section WHEN '1' THEN 1 WHEN '8' THEN 5 WHEN '3' THEN 6 ELSE 12 END ELSE 0 END) AS place FROM k)
"""


@_register("resolve_names", _SQL_RESOLVE + """, b AS (SELECT selector, count(DISTINCT catalog_path) AS n, min(catalog_path) AS w FROM r WHERE place = 1 GROUP BY selector)
SELECT s.selector, coalesce(n > 1, false) AS ambiguous, CASE WHEN n = 1 THEN w END AS winner, coalesce(n, 0) AS n_choices FROM s LEFT JOIN b USING (selector)""")  # fmt: skip
def _resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.resolve(_catalog(spark, sf_dir), _names(spark, sf_dir))


@_register("resolve_precedence", _SQL_RESOLVE + "SELECT selector, catalog_path, path, phase::BIGINT AS phase, place FROM r")
def _precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.ranked(resolve.candidates(_catalog(spark, sf_dir), _names(spark, sf_dir))).select("selector", "catalog_path", "path", "phase", "place")


QUERIES["resolve_all_names"], SQL["resolve_all_names"] = QUERIES["resolve_names"], SQL["resolve_names"]
QUERIES["resolve_all_precedence"], SQL["resolve_all_precedence"] = QUERIES["resolve_precedence"], SQL["resolve_precedence"]


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc_key"), "text")


_SQL_LINES = r"""WITH l AS (SELECT doc_id AS doc_key, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents)
"""


@_register("line_index", _SQL_LINES + """SELECT doc_key, line_no::BIGINT AS line_no, text,
  coalesce(sum(octet_length(encode(text)) + 1) OVER (PARTITION BY doc_key ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_byte FROM l""")  # fmt: skip
def _line_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.line_index(_texts(spark, sf_dir))


def _sql_hits(re2: str) -> str:
    return _SQL_LINES + f""", h AS (SELECT doc_key, line_no::BIGINT AS line_no, text, len(regexp_extract_all(text, '{re2}'))::BIGINT AS occurrence_count FROM l)
    , hits AS (SELECT *, row_number() OVER (PARTITION BY doc_key ORDER BY line_no) AS ordinal FROM h WHERE occurrence_count > 0)
    """


_LICENCE = Pattern("license")
_PATTERNS = {
    "search_literal_hits": (_LICENCE, "(?i)license"),
    "search_regex_hits": (Pattern("licen[sc]e|token = .[0-9a-f]{8}", syntax="regex"), "(?i)licen[sc]e|token = .[0-9a-f]{8}"),
    "search_sensitive_hits": (Pattern("The", case="sensitive"), "The"),
    "search_smart_hits": (Pattern("éou", case="smart"), "(?i)éou"),
    "search_anchored_hits": (Pattern("^the .*[.]$", syntax="regex"), "(?i)^the .*[.]$"),
    "search_escaped_hits": (Pattern("$$$", case="smart"), r"\$\$\$"),
}
for _name, (_p, _re2) in _PATTERNS.items():
    _register(_name, _sql_hits(_re2) + "SELECT * FROM hits")(lambda spark, sf_dir, p=_p: search.hits(_texts(spark, sf_dir), p))


@_register("search_word_hits", _SQL_LINES + r"""SELECT doc_key, line_no::BIGINT AS line_no FROM l WHERE regexp_matches(text, '(?i)(^|[^\pL\pN_\pM\p{Pc}])the([^\pL\pN_\pM\p{Pc}]|$)')""")
def _word_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.hits(_texts(spark, sf_dir), Pattern("the", word=True)).select("doc_key", "line_no")


@_register("search_context", _sql_hits("(?i)license") + """SELECT h.doc_key, h.ordinal, l.line_no::BIGINT AS line_no, l.text, l.line_no = h.line_no AS matched
  FROM hits h JOIN l ON l.doc_key = h.doc_key AND l.line_no BETWEEN h.line_no - 2 AND h.line_no + 2""")  # fmt: skip
def _context(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _texts(spark, sf_dir).where(_LICENCE.matches(F.col("text")))
    return search.context(search.hits(docs, _LICENCE), search.numbered_lines(docs), 2)


@_register("search_page", _sql_hits("(?i)license") + """SELECT * FROM (SELECT doc_key, ordinal, line_no, occurrence_count, row_number() OVER (ORDER BY doc_key, ordinal) AS position, count(*) OVER () AS total,
  CASE WHEN count(*) OVER () > 25 THEN 25::BIGINT END AS next_offset FROM hits) WHERE position > 5 AND position <= 25""")  # fmt: skip
def _page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.page(search.hits(_texts(spark, sf_dir), _LICENCE), 20, 5).select("doc_key", "ordinal", "line_no", "occurrence_count", "position", "total", "next_offset")


@_register("search_occurrences", _sql_hits("(?i)license") + r""", o AS (SELECT doc_key, line_no, ordinal, text, unnest(range(1, occurrence_count + 1)) AS nth, regexp_split_to_array(text, '(?i)license') AS b FROM hits)
  SELECT doc_key, line_no, ordinal, nth::BIGINT AS nth, substr(text, (7 * (nth - 1) + length(array_to_string(b[1:nth], '')) + 1)::BIGINT, 7) AS matched, (7 * (nth - 1) + length(array_to_string(b[1:nth], '')) + 1)::BIGINT AS "column",
    octet_length(encode(substr(text, 1, (7 * (nth - 1) + length(array_to_string(b[1:nth], '')))::BIGINT)))::BIGINT AS start_byte,
    (octet_length(encode(substr(text, 1, (7 * (nth - 1) + length(array_to_string(b[1:nth], '')))::BIGINT))) + 7)::BIGINT AS end_byte FROM o""")  # fmt: skip
def _occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.occurrences(search.hits(_texts(spark, sf_dir), _LICENCE), _LICENCE)


@_register("scope_search_page", _sql_hits("(?i)license") + """, s AS (SELECT doc_key, row_number() OVER (ORDER BY doc_key % 17, doc_key) - 1 AS place FROM (SELECT DISTINCT doc_id AS doc_key FROM documents))
  SELECT * FROM (SELECT hits.doc_key, hits.ordinal, row_number() OVER (ORDER BY place, ordinal) AS position, count(*) OVER () AS total FROM hits JOIN s USING (doc_key)) WHERE position > 10 AND position <= 40""")  # fmt: skip
def _scope_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _texts(spark, sf_dir)
    order = F.row_number().over(Window.orderBy(F.col("doc_key") % 17, "doc_key")) - 1
    return scope.paged_search(search.hits(docs, _LICENCE), docs.select("doc_key").distinct().withColumn("place", order), 30, 10).select("doc_key", "ordinal", "position", "total")


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations with their bytes in the conversation's text, one line break between."""
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    size = F.octet_length("text").cast("long")
    rows = _read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_key"), "conv_id", "turn", "role", "text", F.coalesce(F.sum(size + 1).over(before), F.lit(0)).alias("start"))
    return rows.withColumn("stop", F.col("start") + F.octet_length("text")).drop("conv_id")


_SQL_TURNS = """WITH t AS (SELECT conv_id AS doc_key, turn, role, text, coalesce(sum(octet_length(encode(text)) + 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM conversations),
turns AS (SELECT *, start + octet_length(encode(text)) AS stop FROM t)
"""


@_register("search_owner_asof", _SQL_TURNS + """, a AS (SELECT doc_key, unnest(range(0, (max(stop) + 1)::BIGINT, 97)) AS pos FROM turns GROUP BY doc_key),
  j AS (SELECT a.doc_key, a.pos, n.turn, n.stop FROM a ASOF JOIN turns n ON a.doc_key = n.doc_key AND a.pos >= n.start)
  SELECT doc_key, pos, turn AS node FROM j WHERE pos < stop""")  # fmt: skip
def _owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = _turns(spark, sf_dir)
    asked = nodes.groupBy("doc_key").agg(F.max("stop").alias("end")).select("doc_key", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("end", F.lit(0)).cast("long"), F.lit(97).cast("long"))).alias("pos"))
    return search.owners(asked, nodes.select("doc_key", "start", "stop", F.col("turn").alias("node")))


@_register("prefix_max_intervals", """SELECT user_id AS doc_key, event_id, start, stop, max(stop) OVER (PARTITION BY user_id ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS greatest_stop
  FROM (SELECT user_id, event_id, epoch_us(ts) // 1000000 + event_id % 2 AS start, epoch_us(ts) // 1000000 + event_id % 2 + (event_id * 7919) % 100000 + event_id % 97 AS stop FROM events)""")  # fmt: skip
def _prefix_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    start = F.unix_seconds(F.col("ts").cast("timestamp")) + e % 2
    rows = _read(spark, sf_dir, "events").select(F.col("user_id").alias("doc_key"), "event_id", start.alias("start"), (start + (e * 7919) % 100000 + e % 97).alias("stop"))
    return search.running_ends(rows)


@_register("outline_conversations", """SELECT conv_id AS doc_key, turn AS ord, role AS title, row_number() OVER (PARTITION BY conv_id ORDER BY turn)::VARCHAR AS path FROM conversations""")
def _outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_key"), F.col("turn").alias("ord"), F.col("role").alias("title"), F.lit(1).alias("level"))
    return outline.section_paths(outline.number_sections(rows)).select("doc_key", "ord", "title", "path")


@_register("outline_levels", """WITH RECURSIVE s AS (SELECT conv_id, turn, (turn % 3 + 1)::INT AS level FROM conversations),
  p AS (SELECT a.conv_id, a.turn, a.level, (SELECT max(b.turn) FROM s b WHERE b.conv_id = a.conv_id AND b.turn < a.turn AND b.level < a.level) AS up FROM s a),
  n AS (SELECT *, row_number() OVER (PARTITION BY conv_id, up ORDER BY turn) AS nth FROM p),
  w AS (SELECT conv_id, turn, nth::VARCHAR AS path FROM n WHERE up IS NULL UNION ALL SELECT n.conv_id, n.turn, w.path || '.' || n.nth::VARCHAR FROM n JOIN w ON n.conv_id = w.conv_id AND n.up = w.turn)
  SELECT conv_id AS doc_key, turn AS ord, path FROM w""")  # fmt: skip
def _outline_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_key"), F.col("turn").alias("ord"), (F.col("turn") % 3 + 1).cast("int").alias("level"))
    return outline.section_paths(outline.number_sections(rows)).select("doc_key", "ord", "path")


@_register("excerpt_suppression", """WITH s AS (SELECT o_custkey AS doc_key, o_orderkey AS ord, [o_orderkey % 3 + 1, o_orderkey % 5 + 1, o_orderkey % 2 + 1][1:(o_orderkey % 3)::INT + 1] AS coords, CASE WHEN o_orderkey % 7 = 0 THEN 1 END AS e FROM orders)
  SELECT doc_key, ord, array_to_string(coords, '.') AS path FROM s c WHERE NOT EXISTS (SELECT 1 FROM s a WHERE a.doc_key = c.doc_key AND a.e IS NULL AND c.coords[1:len(a.coords)] = a.coords AND (len(c.coords) > len(a.coords) OR c.e IS NOT NULL))""")  # fmt: skip
def _suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    coords = F.slice(F.array(k % 3 + 1, k % 5 + 1, k % 2 + 1), F.lit(1), (k % 3 + 1).cast("int"))
    rows = _read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_key"), k.alias("ord"), coords.alias("coords"), F.when(k % 7 == 0, 1).alias("entry_ix"))
    return outline.suppress_descendants(rows).select("doc_key", "ord", F.array_join(F.col("coords").cast("array<string>"), ".").alias("path"))


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as entries of documents of twenty: an option named after the first word of the part."""
    first = F.lower(F.element_at(F.split("p_name", " "), 1))
    return _read(spark, sf_dir, "part").select(
        (F.col("p_partkey") % 20).alias("doc_key"), F.col("p_partkey").alias("ord"), F.lit("document-entry").alias("kind"), F.concat(F.lit("1/e"), F.col("p_partkey").cast("string")).alias("path"),
        F.concat(F.lit("option-"), first, F.lit("-"), F.col("p_partkey").cast("string")).alias("id"), F.lit("option").alias("role"), F.when(F.col("p_partkey") % 2 == 0, "sensitive").otherwise("insensitive").alias("case_policy"),
        F.array(F.concat(F.lit("--"), F.when(F.col("p_partkey") % 3 == 0, F.upper(first)).otherwise(first)), F.concat(F.lit("-"), F.substring(first, 1, 1))).alias("names"),
    )


_SQL_ENTRIES = """WITH n AS (SELECT p_partkey % 20 AS doc_key, p_partkey AS ord, '1/e' || p_partkey AS path, 'option-' || lower(string_split(p_name, ' ')[1]) || '-' || p_partkey AS id, p_partkey % 2 = 0 AS sensitive,
  unnest(['--' || CASE WHEN p_partkey % 3 = 0 THEN upper(string_split(p_name, ' ')[1]) ELSE lower(string_split(p_name, ' ')[1]) END, '-' || lower(substr(p_name, 1, 1))]) AS name FROM part)
"""


@_register("explain_alias_tiers", _SQL_ENTRIES + """, s AS (SELECT d.doc_key, v.selector FROM (SELECT DISTINCT doc_key FROM n) d, (VALUES ('--steel'), ('STEEL'), ('1/e7'), ('b'), ('--nothing'), ('small'), ('-S')) v(selector)),
  m AS (SELECT s.doc_key, s.selector, 1 AS tier, n.ord FROM s JOIN n ON n.doc_key = s.doc_key AND n.path = s.selector
    UNION SELECT s.doc_key, s.selector, 2, n.ord FROM s JOIN n ON n.doc_key = s.doc_key AND n.id = s.selector
    UNION SELECT s.doc_key, s.selector, 3, n.ord FROM s JOIN n ON n.doc_key = s.doc_key AND (n.name = s.selector OR NOT sensitive AND lower(n.name) = lower(s.selector))
    UNION SELECT s.doc_key, s.selector, 4, n.ord FROM s JOIN n ON n.doc_key = s.doc_key AND (ltrim(n.name, '-') = s.selector OR NOT sensitive AND lower(ltrim(n.name, '-')) = lower(s.selector))),
  b AS (SELECT *, min(tier) OVER (PARTITION BY doc_key, selector) AS best FROM m)
  SELECT doc_key, selector, tier::BIGINT AS tier, ord, count(*) OVER (PARTITION BY doc_key, selector) AS n_choices FROM b WHERE tier = best""")  # fmt: skip
def _tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = _entries(spark, sf_dir)
    wanted = [("--steel",), ("STEEL",), ("1/e7",), ("b",), ("--nothing",), ("small",), ("-S",)]
    asked = nodes.select("doc_key").distinct().select("doc_key", F.explode(F.array(*[F.lit(w) for (w,) in wanted])).alias("selector")).withColumn("sel_ord", F.lit(0))
    return outline.select_nodes(nodes, asked).select("doc_key", "selector", "tier", "ord", "n_choices")


@_register("ambiguous_names", _SQL_ENTRIES + """, a AS (SELECT doc_key, lower(name) AS selector, ord FROM n UNION SELECT doc_key, lower(ltrim(name, '-')), ord FROM n),
  g AS (SELECT doc_key, selector, string_agg(ord::VARCHAR, ',' ORDER BY ord) AS candidates FROM a GROUP BY doc_key, selector HAVING count(*) > 1)
  SELECT doc_key, candidates, min(selector) AS selector FROM g GROUP BY doc_key, candidates""")  # fmt: skip
def _ambiguous(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outline.ambiguous_names(_entries(spark, sf_dir)).select("doc_key", F.array_join(F.col("candidates").cast("array<string>"), ",").alias("candidates"), "selector")


@_register("duplicate_ids", "SELECT p_size::BIGINT AS doc_key, p_brand AS id, p_type AS role, count(*) AS n FROM part GROUP BY ALL HAVING count(*) > 1")
def _duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "part").select(F.col("p_size").cast("long").alias("doc_key"), F.col("p_brand").alias("id"), F.col("p_type").alias("role"))
    return outline.duplicate_ids(rows)


@_register("dangling_links", "SELECT o_custkey % 100 AS doc_key, o_orderkey AS ord, 'c' || (o_custkey + o_orderkey % 3 * 100) AS target_id FROM orders WHERE o_custkey + o_orderkey % 3 * 100 NOT IN (SELECT c_custkey FROM customer)")
def _dangling(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = _read(spark, sf_dir, "orders").select((F.col("o_custkey") % 100).alias("doc_key"), F.col("o_orderkey").alias("ord"), F.concat(F.lit("c"), (F.col("o_custkey") + F.col("o_orderkey") % 3 * 100).cast("string")).alias("target_id"), F.lit("section").alias("kind"))
    nodes = _read(spark, sf_dir, "customer").select((F.col("c_custkey") % 100).alias("doc_key"), F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"))
    return outline.dangling_links(links, nodes).select("doc_key", "ord", "target_id")


def _links(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = _read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_key"), F.octet_length("text").cast("long").alias("n_bytes"), "doc_id", "n_chars")
    to = F.array(F.col("doc_id") * 2 + F.col("n_chars") % 2, F.expr("doc_id div 3"))
    links = docs.select(F.col("doc_key").alias("from_key"), F.posexplode(to).alias("link_ord", "to")).select("from_key", F.col("to").cast("string").alias("to_key"), F.lit("document").alias("kind"), "link_ord")
    return docs.select("doc_key", "n_bytes"), links


_SQL_LINKS = """WITH RECURSIVE l AS (SELECT doc_id AS f, doc_id * 2 + n_chars % 2 AS t FROM documents UNION SELECT doc_id, doc_id // 3 FROM documents),
"""


@_register("scope_distances", _SQL_LINKS + """w AS (SELECT 3::BIGINT AS k, 0 AS d UNION SELECT l.t, w.d + 1 FROM w JOIN l ON l.f = w.k WHERE w.d < 6)
  SELECT k::VARCHAR AS doc_key, min(d)::BIGINT AS depth FROM w GROUP BY k""")  # fmt: skip
def _distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, links = _links(spark, sf_dir)
    return scope.distances(spark.createDataFrame([("3",)], "doc_key string"), links, 6)


_SQL_SCOPE = _SQL_LINKS + """w AS (SELECT 3::BIGINT AS k, 0 AS d UNION SELECT l.t, w.d + 1 FROM w JOIN l ON l.f = w.k WHERE w.d < 3),
s AS (SELECT k, min(d) AS d FROM w WHERE k IN (SELECT doc_id FROM documents) GROUP BY k)
"""


@_register("scope_documents", _SQL_SCOPE + "SELECT k::VARCHAR AS doc_key, d::INT AS depth FROM s")
def _scope_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scope.closure(*_links(spark, sf_dir), scope.ScopeQuery(("3",), True, 3, 256)).documents.select("doc_key", "depth")


@_register("scope_edges", _SQL_SCOPE + "SELECT DISTINCT f::VARCHAR AS from_key, t::VARCHAR AS to_key FROM l WHERE f IN (SELECT k FROM s) AND t IN (SELECT k FROM s)")
def _scope_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scope.closure(*_links(spark, sf_dir), scope.ScopeQuery(("3",), True, 3, 256)).edges.select("from_key", "to_key")


@_register("scope_frontier", _SQL_SCOPE + "SELECT DISTINCT f::VARCHAR AS from_key, t::VARCHAR AS to_key, 'document' AS kind, 'max-depth' AS reason FROM l JOIN s ON l.f = s.k WHERE s.d = 3 AND t NOT IN (SELECT k FROM s)")
def _scope_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scope.closure(*_links(spark, sf_dir), scope.ScopeQuery(("3",), True, 3, 256)).frontier


@_register("char_page", """SELECT doc_id, substr(text, least(300, length(text)) + 1, 500) AS page, least(300, length(text))::BIGINT AS start, least(least(300, length(text)) + 500, length(text))::BIGINT AS stop, length(text)::BIGINT AS total,
  CASE WHEN least(300, length(text)) + 500 < length(text) THEN (least(300, length(text)) + 500)::BIGINT END AS next_start FROM documents""")  # fmt: skip
def _char_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "documents").select("doc_id", T.char_page(F.col("text"), 300, 500).alias("p")).select("doc_id", F.col("p.text").alias("page"), "p.start", "p.stop", "p.total", "p.next_start")


@_register("slugify_titles", r"""SELECT page_id, regexp_replace(regexp_replace(lower(regexp_extract(html, '<h1>(.*?)</h1>', 1)), '[^\pL\pN_]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM pages""")
def _slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "pages").select("page_id", T.slug(F.regexp_extract("html", "<h1>(.*?)</h1>", 1)).alias("slug"))


@_register("relative_links", r"""SELECT page_id, CASE WHEN page_id % 3 = 0 THEN string_split(p, '/')[1] || '/x' WHEN page_id % 3 = 1 THEN 'y/z' END AS target FROM (SELECT page_id, regexp_extract(url, '://[^/?#]*/([a-z]+/[0-9]+)', 1) AS p FROM pages)""")
def _relative(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = F.regexp_extract("url", "://[^/?#]*/([a-z]+/[0-9]+)", 1)
    reference = F.when(F.col("page_id") % 3 == 0, "./x").when(F.col("page_id") % 3 == 1, "../y/./z").otherwise("../../w")
    return _read(spark, sf_dir, "pages").select("page_id", T.relative_path(base, reference).alias("target"))


@_register("sanitize_terminal", r"""SELECT doc_id, regexp_replace(text, '[\x00-\x1F\x7F-\x{9F}]', chr(65533), 'g') AS shown FROM documents""")
def _sanitized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "documents").select("doc_id", T.sanitize_terminal(F.col("text")).alias("shown"))


@_register("escape_markdown", r"""WITH e AS (SELECT doc_id, regexp_replace(replace(text, '&', '&amp;'), '([\\`*\[\]<>$_])', '\\\1', 'g') AS t FROM documents),
  w AS (SELECT doc_id, regexp_replace(t, '([\pL\pN])\\_([\pL\pN])', '\1_\2', 'g') AS t FROM e)
  SELECT doc_id, regexp_replace(t, '([\pL\pN])\\_([\pL\pN])', '\1_\2', 'g') AS escaped FROM w""")
def _escaped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "documents").select("doc_id", T.escape_markdown(F.col("text")).alias("escaped"))


@_register("link_targets", r"""SELECT p_partkey, replace(regexp_replace(p_name || '(' || p_size || ')', '([\\()])', '\\\1', 'g'), ' ', '%20') AS target FROM part""")
def _targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "part").select("p_partkey", T.link_target(F.concat("p_name", F.lit("("), F.col("p_size").cast("string"), F.lit(")"))).alias("target"))


@_register("content_fingerprints", "SELECT doc_id, sha256(text) AS fingerprint FROM documents")
def _fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "documents").select("doc_id", T.content_fingerprint(F.col("text")).alias("fingerprint"))


_SQL_HOST_NAMES = """WITH n AS (SELECT p_partkey AS selector, p_name || CASE p_partkey % 3 WHEN 0 THEN '.md' ELSE '' END AS name FROM part)
  SELECT selector, 0 AS cand_ord, name FROM n UNION ALL
  SELECT selector, k, name || CASE k WHEN 1 THEN '.EXE' ELSE '.bat' END FROM n, (VALUES (1), (2)) x(k) WHERE selector % 3 <> 0"""


@_register("host_names", _SQL_HOST_NAMES)
def _host_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat("p_name", F.when(F.col("p_partkey") % 3 == 0, ".md").otherwise(""))
    names = _read(spark, sf_dir, "part").select(F.col("p_partkey").alias("selector"), name.alias("name"))
    return resolve.host_names(names, resolve.command_suffixes(".EXE; bat;.exe;a/b"))


@_register("tldr_pages", """SELECT topic, platform, language, url FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY list_position(['linux', 'common', 'osx'], platform), list_position(['fr_CA', 'fr', 'en'], language), page_id % 2) AS place FROM (
  SELECT page_id, page_id // 8 AS topic, ['linux', 'common', 'osx', 'plan9'][page_id % 4 + 1] AS platform, ['en', 'fr', 'de'][page_id % 3 + 1] AS language, url FROM pages) WHERE platform <> 'plan9' AND language <> 'de') WHERE place = 1""")
def _tldr_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (F.col("page_id") % n + 1).cast("int"))
    cached = _read(spark, sf_dir, "pages").select(
        F.expr("page_id div 8").alias("topic"), pick(["linux", "common", "osx", "plan9"], 4).alias("platform"), pick(["en", "fr", "de"], 3).alias("language"),
        (F.col("page_id") % 2).alias("cache_ord"), F.lit(0).alias("dir_ord"), "url",
    )
    languages = resolve.tldr_languages({"LANG": "fr_CA.UTF-8"})
    return resolve.tldr_pages(cached, resolve.tldr_platforms("linux"), languages).select("topic", "platform", "language", "url")


@_register("doctor_summary", """WITH c AS (SELECT event_type AS code, CASE WHEN sum(value) > 3 * count(*) * avg(value) / 2 THEN 'error' WHEN max(user_id) % 2 = 0 THEN 'warning' ELSE 'ok' END AS status FROM events GROUP BY event_type)
  SELECT count(*) FILTER (status = 'ok') AS ok, count(*) FILTER (status = 'warning') AS warnings, count(*) FILTER (status = 'error') AS errors,
  CASE WHEN bool_or(status = 'error') THEN 'error' WHEN bool_or(status = 'warning') THEN 'warning' ELSE 'healthy' END AS outcome FROM c""")  # fmt: skip
def _doctor(spark: SparkSession, sf_dir: str) -> DataFrame:
    checks = _read(spark, sf_dir, "events").groupBy(F.col("event_type").alias("code")).agg(
        F.when(F.sum("value") > 3 * F.count(F.lit(1)) * F.avg("value") / 2, "error").when(F.max("user_id") % 2 == 0, "warning").otherwise("ok").alias("status")
    )
    return admin.summary(checks)


_SQL_SOURCES = """WITH a AS (SELECT source AS name, sum(n_chars)::BIGINT % 4 AS k FROM documents WHERE source IS NOT NULL GROUP BY source),
  c AS (SELECT name, 'f' || (k % 2) AS fingerprint FROM a WHERE k <> 0), i AS (SELECT name, 'f' || (k // 2) AS fingerprint FROM a WHERE k <> 1)
"""


def _sources(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Configured and installed sources: what all documents of a source sum up to tells which lists it is in."""
    k = F.col("k")
    found = _read(spark, sf_dir, "documents").where("source IS NOT NULL").groupBy(F.col("source").alias("name")).agg((F.sum("n_chars") % 4).alias("k"))
    configured = found.where(k != 0).select("name", F.concat(F.lit("f"), (k % 2).cast("string")).alias("fingerprint"))
    installed = found.where(k != 1).select("name", F.concat(F.lit("f"), F.expr("k div 2").cast("string")).alias("fingerprint"))
    return configured, installed


@_register("sources_inspection", _SQL_SOURCES + """SELECT coalesce(c.name, i.name) AS name, CASE WHEN c.name IS NULL THEN 'orphaned' WHEN i.name IS NULL THEN 'missing' WHEN i.fingerprint <> c.fingerprint THEN 'stale' ELSE 'ready' END AS status FROM c FULL JOIN i ON c.name = i.name""")
def _inspection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return admin.inspect_sources(*_sources(spark, sf_dir))


@_register("prune_orphans", _SQL_SOURCES + "SELECT name FROM i WHERE name NOT IN (SELECT name FROM c)")
def _prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    return admin.orphans(*_sources(spark, sf_dir)).select("name")


@_register("source_selection", """SELECT catalog_path FROM (SELECT regexp_extract(url, '://[^/?#]*/([^?#]*)', 1) AS catalog_path FROM pages) WHERE (catalog_path = 'en' OR starts_with(catalog_path, 'en/') OR starts_with(catalog_path, 'fr/')) AND NOT starts_with(catalog_path, 'en/1/') AND catalog_path <> 'fr/414'""")
def _selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "pages").select(F.regexp_extract("url", "://[^/?#]*/([^?#]*)", 1).alias("catalog_path"))
    return admin.selected(rows, "catalog_path", ["en", "fr"], ["en/1", "fr/414"])


@_register("case_collisions", "SELECT lower(p_name) AS folded, count(DISTINCT CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE p_name END) AS spellings FROM part GROUP BY 1 HAVING count(DISTINCT CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE p_name END) > 1")
def _collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "part").select(F.when(F.col("p_partkey") % 2 == 0, F.upper("p_name")).otherwise(F.col("p_name")).alias("path"))
    return admin.case_collisions(rows)


def _conversation_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation as a Markdown document: a title and a section a turn."""
    turns = _read(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(F.lit("## "), "role", F.lit("\n\n- `--turn-"), F.col("turn").cast("string"), F.lit("`: the turn\n\nlicense "), F.col("turn").cast("string"), F.lit("\n\n````\n"), "text", F.lit("\n````")).alias("part"))
    whole = turns.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "part"))), lambda x: x["part"]), "\n\n").alias("text"))
    return whole.select(F.col("conv_id").cast("string").alias("doc_key"), F.lit("markdown").alias("format"), F.encode(F.concat(F.lit("# Conversation\n\n"), "text"), "utf-8").alias("content"))


@_register("markdown_outline", """WITH t AS (SELECT conv_id::VARCHAR AS doc_key, role, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS k FROM conversations)
  SELECT doc_key, n::VARCHAR AS path, 'document-section' AS kind, role || CASE WHEN k > 1 THEN '-' || k ELSE '' END AS id, role AS title FROM t
  UNION ALL SELECT doc_key, n || '/e1', 'document-entry', 'option-turn-' || turn, '--turn-' || turn FROM t""")  # fmt: skip
def _markdown_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docloom.plans.index import index

    return index(_conversation_markdown(spark, sf_dir)).nodes.select("doc_key", "path", "kind", "id", "title")


@_register("markdown_search_owners", """WITH t AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, ['license ' || turn] || string_split(text, chr(10)) AS lines FROM conversations),
  l AS (SELECT conv_id, n, unnest(lines) AS text, generate_subscripts(lines, 1) AS k FROM t)
  SELECT conv_id::VARCHAR AS doc_key, n::VARCHAR AS node, row_number() OVER (PARTITION BY conv_id ORDER BY n, k) AS ordinal, text FROM l WHERE contains(lower(text), 'license')""")
def _markdown_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docloom.plans.engine import Engine
    from docloom.plans.index import index

    return Engine(spark, None, None)._hits(index(_conversation_markdown(spark, sf_dir)), _LICENCE).select("doc_key", "node", "ordinal", "text")


@_register("markdown_excerpts", """SELECT conv_id::VARCHAR AS doc_key, n::VARCHAR AS path, '*Outline ' || n || '*' || chr(10) || chr(10) || '<a id="' || id || '"></a>' || chr(10) || '## ' || role || chr(10) || chr(10) || '- <a id="option-turn-' || turn || '"></a>`--turn-' || turn || '`: the turn' || chr(10) || chr(10) || 'license ' || turn || chr(10) || chr(10) || '```' || chr(10) || body || chr(10) || '```' AS text
  FROM (SELECT *, text AS body, role || CASE WHEN k > 1 THEN '-' || k ELSE '' END AS id FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS k FROM conversations))""")  # fmt: skip
def _excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docloom.plans import render
    from docloom.plans.index import index

    parsed = index(_conversation_markdown(spark, sf_dir))
    return render.excerpt_markdown(parsed.nodes.where("kind = 'document-section'"), parsed.documents).select("doc_key", "path", "text")


@_register("manual_outline", """SELECT conv_id::VARCHAR AS doc_key, row_number() OVER (PARTITION BY conv_id ORDER BY turn)::VARCHAR AS path, role || '-' || row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS id, upper(role) AS title FROM conversations""")
def _manual_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docloom.plans.index import index

    turns = _read(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(F.lit(".SH "), F.upper("role"), F.lit("\nSee\n.BR tar (1)\nfor \\fBmore\\fP.\n"), F.regexp_replace(F.replace("text", F.lit("\\"), F.lit("\\e")), "(?m)^", r"\\&")).alias("part"))
    whole = turns.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "part"))), lambda x: x["part"]), "\n").alias("text"))
    raw = whole.select(F.col("conv_id").cast("string").alias("doc_key"), F.lit("roff").alias("format"), F.encode(F.concat(F.lit(".TH X 1\n"), "text"), "utf-8").alias("content"))
    return index(raw).nodes.select("doc_key", "path", "id", "title")


@_register("tldr_examples", """SELECT p_partkey::VARCHAR AS topic, p_name AS title, 'run ' || p_size || ' times' AS description, 'do --count ' || p_size AS text, 'file' AS placeholder FROM part""")
def _tldr(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docloom.plans.index import tldr_rows

    size = F.col("p_size").cast("string")
    pages = _read(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("topic"), F.concat(F.lit("# "), "p_name", F.lit("\n\n> A part.\n\n- run "), size, F.lit(" times:\n\n`do {{[-c|--count]}} "), size, F.lit(" {{file}}`\n")).alias("text"))
    e = F.col("examples")[0]
    return tldr_rows(pages).select("topic", "title", e["description"].alias("description"), F.rtrim(e["parts"][0]["value"]).alias("text"), e["parts"][1]["value"].alias("placeholder"))
