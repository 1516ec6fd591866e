"""Queries that look names of a whole table up in whole texts, or up to spelling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradewind import dictionaries as D
from tradewind.operators import fuzzy, matching, preferences
from tradewind.plans import articles as A
from tradewind.plans import relations as R
from tradewind.plans.articles import q
from tradewind.plans.registry import query
from tradewind.plans.relations import NOW_SQL
from tradewind.session import spread, table
from tradewind.sources.adapters import PROCESSED, REGION_PICK, SIGNAL_PICK, SUPPLIERS, processed, suppliers

NAMES = """names AS (SELECT 'doc-' || CAST(doc_id AS VARCHAR) AS name_id, array_to_string(list_slice(string_split(string_split(text, chr(10))[1], ' '), 1, 1 + doc_id % 6), ' ') AS name FROM documents WHERE text IS NOT NULL UNION ALL SELECT public_id, canonical_name FROM suppliers),
looked AS (SELECT min(name_id) AS name_id, lower(trim(name, ' ' || chr(9) || chr(13))) AS low FROM names GROUP BY ALL)"""


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A name a document, the first one to six words of its first line, and every supplier's; equal names once, under the least id."""
    docs = table(spark, sf_dir, "documents").where("text is not null")
    words = F.split(F.element_at(F.split("text", "\n"), 1), " ")
    own = docs.select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("name_id"), F.array_join(F.slice(words, F.lit(1), (1 + F.col("doc_id") % 6).cast("int")), " ").alias("name"))
    both = own.unionByName(suppliers(spark, sf_dir).select(F.col("public_id").alias("name_id"), F.col("canonical_name").alias("name")))
    return both.groupBy(F.lower(F.trim("name", F.lit(" \t\r"))).alias("name")).agg(F.min("name_id").alias("name_id"))


@query(SUPPLIERS, NAMES, sql="SELECT doc_id AS id, name_id FROM documents JOIN looked ON length(low) >= 3 AND regexp_matches(low, '[0-9a-z]|[^\\x00-\\x7f]') AND contains(lower(text), low) AND regexp_matches(lower(text), '(^|[^0-9a-z])' || regexp_escape(low) || '([^0-9a-z]|$)')")
def names_in_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every name of a table that grows with the documents, in every whole document that holds it as whole words."""
    texts = spread(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"))
    return matching.names_in_texts(texts, names(spark, sf_dir)).select("id", "name_id")


#: DuckDB counts edits of bytes, so letters beyond ASCII become control characters, one each.
_letters = "ßàáâäçèéêëíîïñóôöùúûü"
_flat = f"translate(lower(trim(name)), '{_letters}', {' || '.join(f'chr({1 + k if k < 8 else k + 6})' for k in range(len(_letters)))})"


@query(f"""lines AS (SELECT doc_id, array_to_string(list_slice(string_split(string_split(text, chr(10))[1], ' '), 1, 1 + doc_id % 3), ' ') AS name FROM documents WHERE text IS NOT NULL),
companies AS (SELECT doc_id AS company_id, name FROM lines WHERE doc_id % 2 = 0),
asked AS (SELECT doc_id AS request_id, CASE WHEN doc_id % 5 = 0 THEN translate(name, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') WHEN doc_id % 5 < 3 THEN substr(name, 1, CAST(doc_id % 7 AS BIGINT)) || 'x' || substr(name, CAST(doc_id % 7 AS BIGINT) + 3) ELSE name END AS name FROM lines),
known AS (SELECT lower(trim(name)) AS low, {_flat} AS flat, arg_min(name, company_id) AS company_name, min(company_id) AS company_id FROM companies WHERE trim(name) <> '' GROUP BY 1, 2),
wanted AS (SELECT DISTINCT lower(trim(name)) AS low, {_flat} AS flat FROM asked WHERE trim(name) <> ''),
near AS (SELECT w.low, k.low AS other, company_id, company_name, CAST(1 AS DOUBLE) - CAST(levenshtein(w.flat, k.flat) AS DOUBLE) / greatest(length(w.low), length(k.low)) AS ratio FROM wanted w JOIN known k ON abs(length(w.low) - length(k.low)) * 4 <= greatest(length(w.low), length(k.low)) AND levenshtein(w.flat, k.flat) * 4 <= greatest(length(w.low), length(k.low))),
best AS (SELECT low, company_id, company_name, round(ratio, 6) AS confidence FROM near QUALIFY row_number() OVER (PARTITION BY low ORDER BY ratio DESC, other) = 1)""",
sql="SELECT request_id, b.company_id, b.company_name, b.confidence FROM asked a LEFT JOIN best b ON lower(trim(a.name)) = b.low")
def fuzzy_companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A company name a document, as written, in capitals (A to Z) or with characters changed, resolved against every second one's."""
    docs = table(spark, sf_dir, "documents").where("text is not null")
    words = F.split(F.element_at(F.split("text", "\n"), 1), " ")
    k = F.col("doc_id")
    lines = docs.select("doc_id", F.array_join(F.slice(words, F.lit(1), (1 + k % 3).cast("int")), " ").alias("name"))
    changed = F.expr("concat(substr(name, 1, cast(doc_id % 7 as int)), 'x', substr(name, cast(doc_id % 7 as int) + 3))")
    asked = lines.select(k.alias("request_id"), F.when(k % 5 == 0, F.translate("name", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")).when(k % 5 < 3, changed).otherwise(F.col("name")).alias("name"))
    companies = lines.where(k % 2 == 0).select(k.alias("company_id"), "name")
    return fuzzy.resolve_names(asked, companies).select("request_id", "company_id", "company_name", "confidence")


# ---- feeds by whole preferences ----

_tags = ("tariff", "port strike", "recall", "sanctions")


def _terms_sql(column: str, values: tuple[str, ...]) -> str:
    """A CASE from a stored value to the list of its terms, for the values that the tables hold."""
    listed = lambda v: "[" + ", ".join(q(t) for t in sorted(D.expand_terms([v]))) + "]"
    return f"CASE {column} " + " ".join(f"WHEN {q(v)} THEN {listed(v)}" for v in values) + " ELSE CAST([] AS VARCHAR[]) END"


_places = sorted({c for c in D.REGION_ALIASES.values()} | set(REGION_PICK))
_region = f"CASE lower(region) {' '.join(f'WHEN {q(a)} THEN {q(c.lower())}' for a, c in D.REGION_ALIASES.items())} ELSE lower(region) END"
_in_text = "len(list_filter({terms}, lambda t: length(t) >= 3 AND regexp_matches({text}, '(^|[^a-z0-9])' || regexp_escape(t) || '([^a-z0-9]|$)'))) > 0"
_graded = lambda n: f"CASE WHEN {n} > 0 THEN least(CAST(1.0 AS DOUBLE), CAST(0.5 AS DOUBLE) + {n} * CAST(0.25 AS DOUBLE)) ELSE CAST(0.3 AS DOUBLE) END"
_list = lambda cases: f"list_filter([{cases}], lambda v: v IS NOT NULL)"
_shared = lambda a, b: f"len(list_intersect({a}, {b}))"
FULL = f"""a0 AS (SELECT id, processed_at, lower(normalized_title) || ' ' || lower(summary) AS text, {A.category_sql('top_level_category')} AS category, {_list("lower(supplier)")} AS suppliers,
    CASE WHEN id % 4 = 0 THEN ['sup-' || CAST(id % 50 AS VARCHAR)] ELSE CAST([] AS VARCHAR[]) END AS supplier_ids, {_region} AS region, priority_signal FROM processed WHERE processed_at >= {NOW_SQL} - INTERVAL 7 DAY AND processed_at <= {NOW_SQL}),
a1 AS (SELECT *, list_distinct(list_concat([region], list_transform({A._regions.replace('low', 'text')}, lambda v: lower(v)))) AS places, {_terms_sql('priority_signal', SIGNAL_PICK)} AS terms FROM a0),
arts AS (SELECT *, text || ' ' || array_to_string(places, ' ') AS context, list_concat(terms, flatten(list_transform(places, lambda v: {_terms_sql('v', tuple(p.lower() for p in _places))}))) AS every FROM a1),
users AS (SELECT c_custkey AS user_id, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN ['automotive'] WHEN 'BUILDING' THEN ['construction'] ELSE CAST([] AS VARCHAR[]) END AS wc, CASE WHEN c_custkey % 5 = 0 THEN ['bosch', 'acme gmbh'] ELSE CAST([] AS VARCHAR[]) END AS ws, CASE WHEN c_custkey % 3 = 0 THEN ['sup-' || CAST(c_custkey % 50 AS VARCHAR)] ELSE CAST([] AS VARCHAR[]) END AS wi,
    CASE WHEN c_custkey % 4 = 1 THEN ['germany'] WHEN c_custkey % 4 = 2 THEN ['asia', 'europe'] ELSE CAST([] AS VARCHAR[]) END AS wr, CASE c_custkey % 7 WHEN 0 THEN 'tariff' WHEN 3 THEN 'port strike' WHEN 5 THEN 'recall' END AS wanted_tag,
    CASE WHEN c_custkey % 6 = 0 THEN ['toyota'] ELSE CAST([] AS VARCHAR[]) END AS xs, CASE WHEN c_custkey % 13 = 0 THEN ['electronics'] ELSE CAST([] AS VARCHAR[]) END AS xc, CASE WHEN c_custkey % 9 = 0 THEN ['sup-8'] ELSE CAST([] AS VARCHAR[]) END AS xi, CASE WHEN c_custkey % 11 = 0 THEN ['asia'] ELSE CAST([] AS VARCHAR[]) END AS xr, CASE WHEN c_custkey % 8 = 0 THEN 'sanctions' END AS excluded_tag FROM customer),
u AS (SELECT *, {_terms_sql('wanted_tag', _tags)} AS wg, {_terms_sql('excluded_tag', _tags)} AS xg FROM users),
p AS (SELECT u.*, a.*, list_filter(ws, lambda n: length(n) >= 3 AND regexp_matches(text, '(^|[^0-9a-z])' || regexp_escape(n) || '([^0-9a-z]|$)')) AS said, {_in_text.format(terms='wg', text='context')} AS told FROM u, arts a
  WHERE NOT ({_shared('supplier_ids', 'xi')} > 0 OR {_shared('suppliers', 'xs')} > 0 OR {_shared('[category]', 'xc')} > 0 OR {_shared('places', 'xr')} > 0 OR {_shared('every', 'xg')} > 0 OR {_in_text.format(terms='xg', text='context')})),
s AS (SELECT user_id, id, processed_at, CASE WHEN len(wc) = 0 THEN CAST(0.5 AS DOUBLE) WHEN {_shared('[category]', 'wc')} > 0 THEN CAST(1.0 AS DOUBLE) ELSE CAST(0.3 AS DOUBLE) END AS category_match,
    CASE WHEN len(suppliers) + len(said) = 0 OR len(ws) = 0 THEN CAST(0.5 AS DOUBLE) ELSE {_graded(f"({_shared('list_distinct(list_concat(suppliers, said))', 'ws')} + {_shared('supplier_ids', 'wi')})")} END AS supplier_match,
    CASE WHEN len(wr) = 0 THEN CAST(0.5 AS DOUBLE) ELSE {_graded(_shared('places', 'wr'))} END AS region_match, CASE WHEN len(wg) = 0 THEN CAST(0.5 AS DOUBLE) WHEN {_shared('terms', 'wg')} > 0 THEN CAST(1.0 AS DOUBLE) ELSE {_graded('CAST(told AS INT)')} END AS signal_match
  FROM p WHERE CASE WHEN len(wc) + len(ws) > 0 THEN {_shared('[category]', 'wc')} > 0 OR CASE WHEN len(supplier_ids) > 0 THEN {_shared('supplier_ids', 'wi')} > 0 ELSE {_shared('suppliers', 'ws')} > 0 OR len(said) > 0 END WHEN len(wr) > 0 THEN {_shared('places', 'wr')} > 0 WHEN len(wg) > 0 THEN {_shared('every', 'wg')} > 0 OR told ELSE true END),
r AS (SELECT *, round(category_match * CAST(0.3 AS DOUBLE) + supplier_match * CAST(0.3 AS DOUBLE) + region_match * CAST(0.2 AS DOUBLE) + signal_match * CAST(0.2 AS DOUBLE), 9) AS rank_score FROM s)"""


@query(PROCESSED, FULL, sql="SELECT user_id, id, rank, category_match, supplier_match, region_match, signal_match, rank_score FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY rank_score DESC, processed_at DESC, id) AS rank FROM r WHERE rank_score >= 0.3) WHERE rank <= 50")
def matched_feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best 50 articles of the last week for every customer: wishes and exclusions of all kinds, identity before names."""
    p = processed(spark, sf_dir).where((F.col("processed_at") >= R.now() - F.expr("interval 7 days")) & (F.col("processed_at") <= R.now()))
    none, key = F.expr("cast(array() as array<string>)"), F.col("id")
    articles = p.select("id", "processed_at", F.col("normalized_title").alias("title"), "summary", F.col("top_level_category").alias("category"), none.alias("categories"), F.array("supplier").alias("suppliers"), F.when(key % 4 == 0, F.array(F.concat(F.lit("sup-"), (key % 50).cast("string")))).alias("supplier_ids"), F.array("region").alias("regions"), "priority_signal", none.alias("signal_tags"))
    c, k = spread(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")), F.col("c_custkey")
    some = lambda condition, *values: F.when(condition, F.array(*map(F.lit, values)))
    segment = F.col("c_mktsegment")
    users = c.select(
        k.alias("user_id"), F.when(segment == "AUTOMOBILE", F.array(F.lit("Automotive"))).when(segment == "BUILDING", F.array(F.lit("construction"))).alias("wanted_categories"), some(k % 5 == 0, "Bosch", "Acme GmbH").alias("wanted_suppliers"), F.when(k % 3 == 0, F.array(F.concat(F.lit("sup-"), (k % 50).cast("string")))).alias("wanted_supplier_ids"),
        F.when(k % 4 == 1, F.array(F.lit("Germany"))).when(k % 4 == 2, F.array(F.lit("Asia"), F.lit("Europe"))).alias("wanted_regions"), F.when(k % 7 == 0, F.array(F.lit("tariff"))).when(k % 7 == 3, F.array(F.lit("port strike"))).when(k % 7 == 5, F.array(F.lit("recall"))).alias("wanted_signals"),
        some(k % 13 == 0, "chips").alias("excluded_categories"), some(k % 6 == 0, " Toyota").alias("excluded_suppliers"), some(k % 9 == 0, "sup-8").alias("excluded_supplier_ids"), some(k % 11 == 0, "asia").alias("excluded_regions"), some(k % 8 == 0, "sanctions").alias("excluded_signals"),
    )
    return preferences.feeds(articles, users, 50).withColumn("rank", F.col("rank").cast("long"))
