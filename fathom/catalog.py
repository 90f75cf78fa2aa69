"""The registered queries of the engine itself: name to function, and name to DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.operators import bayes, keys, keywords, match, series
from fathom.operators.select import query
from fathom.plans.sql import change, execute, execute_over
from fathom.sources import tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def add(name: str, run: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = run
    if sql is not None:
        ORACLES[name] = sql


def pages(name: str, text: str, sql: str | None = None, **options) -> None:
    add(name, lambda spark, d: query(table(spark, d, "pages"), text, **options), sql)


def texts(name: str, text: str, sql: str | None = None) -> None:
    add(name, lambda spark, d: query(table(spark, d, "documents"), text, source="text", url=None, keep=("doc_id",)), sql)


def dialect(name: str, of: str, statement: str, sql: str | None) -> None:
    add(name, lambda spark, d: execute(table(spark, d, of), statement), sql)


# ---- what the oracles share: rows of pages by regular expressions

_LINK = r'<a\s[^>]*href="([^"]*)"[^>]*>(.*?)</a>'
LINKS = f"""
WITH m AS (SELECT page_id, url, regexp_extract_all(html, '{_LINK}', 1, 's') AS h, regexp_extract_all(html, '{_LINK}', 2, 's') AS t FROM pages),
links AS (SELECT page_id, url, CAST(unnest(range(len(h))) AS INTEGER) AS pos, unnest(h) AS href, unnest(t) AS tx FROM m)"""


def _elements(tag: str, group: int = 1) -> str:
    return f"""
WITH m AS (SELECT page_id, url, regexp_extract_all(html, '<{tag}(?:\\s[^>]*)?>(.*?)</{tag}>', {group}, 's') AS t FROM pages),
e AS (SELECT page_id, url, CAST(unnest(range(len(t))) AS INTEGER) AS pos, unnest(t) AS tx FROM m)"""


# ---- tags, attributes, ranges

pages("links_href_text", "<a>:href,tx", LINKS + " SELECT page_id, pos, href, tx FROM links")
pages("whole_elements", "<title>", _elements("title", 0) + " SELECT page_id, pos, tx AS value FROM e")
pages("nth_link", "<a>2-3:href", LINKS + " SELECT page_id, pos - 1 AS pos, href FROM links WHERE pos IN (1, 2)")
pages("last_link", "<a>0:tx", LINKS + " SELECT page_id, 0 AS pos, max_by(tx, pos) AS tx FROM links GROUP BY page_id")
pages("from_second_to_last", "<a>2-0:tx", LINKS + " SELECT page_id, pos - 1 AS pos, tx FROM links WHERE pos >= 1")
pages("every_other_link", "<a>1-0#2:href", LINKS + " SELECT page_id, CAST(pos / 2 AS INTEGER) AS pos, href FROM links WHERE pos % 2 = 0")
pages("several_ranges", "<a>1,3-4:href", LINKS + " SELECT page_id, CASE WHEN pos = 0 THEN 0 ELSE pos - 1 END AS pos, href FROM links WHERE pos IN (0, 2, 3)")
pages("title_text", "<title>:tx", _elements("title") + " SELECT page_id, pos, tx FROM e")
pages("list_items", "<ul>.<li>:tx", _elements("li") + " SELECT page_id, pos, tx FROM e")
pages("tag_names", "<h1>:tn,st,et", _elements("h1", 0) + " SELECT page_id, pos, 'h1' AS tn, regexp_extract(tx, '^<h1[^>]*>') AS st, '</h1>' AS et FROM e")
pages("missing_attribute", "<a>:href,title", LINKS + " SELECT page_id, pos, href, CAST(NULL AS VARCHAR) AS title FROM links")
pages("page_language", "<html>:lang", "SELECT page_id, 0 AS pos, regexp_extract(html, '<html lang=\"([^\"]*)\"', 1) AS lang FROM pages WHERE html LIKE '%<html lang=%'")
pages("text_around", "<h1>:px,fx,xx", "SELECT page_id, 0 AS pos, regexp_extract(html, '>([^<]*)<h1>', 1) AS px, regexp_extract(html, '<h1>([^<]*)', 1) AS fx, regexp_extract(html, '</h1>([^<]*)', 1) AS xx FROM pages")
pages("paragraph_texts", "<p>:tx", None)
pages("paragraph_count", "<p NORECUR>&tuple_count", "SELECT page_id, 0 AS pos, CAST(len(regexp_extract_all(regexp_replace(html, '<script.*?</script>', '', 'gs'), '<p>')) AS VARCHAR) AS value FROM pages")
pages("wild_tags", "<*>1-5:tn", None)
pages("text_tokens", "<@tx>1-3:tt", "WITH m AS (SELECT page_id, [regexp_extract(html, '<title>(.*?)</title>', 1, 's'), regexp_extract(html, '<style>(.*?)</style>', 1, 's'), regexp_extract(html, '<script>(.*?)</script>', 1, 's')] AS v FROM pages) SELECT page_id, CAST(unnest(range(3)) AS INTEGER) AS pos, unnest(v) AS tt FROM m")
pages("bold_unclosed", "<b>:tx &txstr(40)", None)
pages("complement_links", "<-a>", "SELECT page_id, 0 AS pos, regexp_replace(html, '<a\\s[^>]*>.*?</a>', '', 'gs') AS value FROM pages")
pages("source_complement", "-<a>", "WITH m AS (SELECT page_id, string_split_regex(html, '(?s)<a\\s[^>]*>.*?</a>') AS v FROM pages) SELECT page_id, CAST(unnest(range(len(v))) AS INTEGER) AS pos, unnest(v) AS value FROM m")
pages("separated_by_links", "<nav>.<a SEP>", "WITH m AS (SELECT page_id, string_split(regexp_extract(html, '<nav>.*?</nav>', 0, 's'), '<a ') AS v FROM pages), x AS (SELECT page_id, CAST(unnest(range(len(v))) AS INTEGER) AS pos, unnest(v) AS value FROM m) SELECT page_id, pos, CASE WHEN pos = 0 THEN value ELSE '<a ' || value END AS value FROM x")

# ---- predicates and records

pages("links_like", "<a (href like '/t%')>:href", LINKS + ", k AS (SELECT * FROM links WHERE href ILIKE '/t%') SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY pos) - 1 AS INTEGER) AS pos, href FROM k")
pages("range_before_predicate", "<a IRAN (tx<>'the')>1-2:tx", LINKS + ", k AS (SELECT * FROM links WHERE pos < 2 AND tx <> 'the') SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY pos) - 1 AS INTEGER) AS pos, tx FROM k")
pages("link_records", "<a>{link=:href; label=:tx &tx &trim}", LINKS + " SELECT page_id, pos, href AS link, trim(replace(tx, '&amp;', '&')) AS label FROM links")
pages("records_where", "<a>{href=:href; t=:tx | strlen(t)>3}", LINKS + " SELECT page_id, pos, href, tx AS t FROM links WHERE strlen(tx) > 3")
pages("records_where_words", "<a>{a=:href; b=:tx &tx &trim | text_words(b)>=1 and not (a is null)}", LINKS + " SELECT page_id, pos, href AS a, trim(replace(tx, '&amp;', '&')) AS b FROM links WHERE regexp_matches(tx, '[^\\x00-\\x7F]|[A-Za-z0-9_]')")
pages("records_computed", "<a>{href=:href; t=:tx | t <> 'the' | joined=t+'#'+href; n=strlen(t)*2}", LINKS + " SELECT page_id, pos, tx || '#' || href AS joined, CAST(strlen(tx) * 2 AS VARCHAR) AS n FROM links WHERE tx <> 'the'")
pages("records_substr", "<a>{t=:tx | | a=substr(t,1,2); b=strfind(t,'e'); c=lower(t)}", LINKS + " SELECT page_id, pos, substr(tx, 2, 2) AS a, CAST(instr(tx, 'e') - 1 AS VARCHAR) AS b, lower(tx) AS c FROM links")
pages("records_of_pages", "<html>{title=<title>:tx; links=<a>&tuple_count; first=<a>1:href}", LINKS + ", c AS (SELECT page_id, CAST(count(*) AS VARCHAR) AS links, min_by(href, pos) AS first FROM links GROUP BY page_id) SELECT p.page_id, 0 AS pos, regexp_extract(html, '<title>(.*?)</title>', 1, 's') AS title, coalesce(c.links, '0') AS links, c.first FROM pages p LEFT JOIN c USING (page_id)")
pages("with_variable", "<a (tx=wanted)>:href,tx", LINKS + ", k AS (SELECT * FROM links WHERE tx = 'the') SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY pos) - 1 AS INTEGER) AS pos, href, tx FROM k", variables={"wanted": "the"})

# ---- reductions and counts

pages("links_joined", "<a>:tx /|/", LINKS + " SELECT p.page_id, 0 AS pos, coalesce(string_agg(tx, '|' ORDER BY pos), '') AS value FROM pages p LEFT JOIN links USING (page_id) GROUP BY p.page_id")
pages("fields_joined", "<a>:href,tx */ => /", LINKS + " SELECT page_id, pos, href || ' => ' || tx AS value FROM links")
pages("nested_joined", "<ul>{items=<li>:tx} **/; /", _elements("li") + " SELECT page_id, 0 AS pos, string_agg(tx, '; ' ORDER BY pos) AS items FROM e GROUP BY page_id")
pages("links_counted", "<a>&tuple_count", LINKS + " SELECT p.page_id, 0 AS pos, CAST(count(links.pos) AS VARCHAR) AS value FROM pages p LEFT JOIN links USING (page_id) GROUP BY p.page_id")

# ---- plain delimiters

texts("sentences", "/'. '/", "WITH m AS (SELECT doc_id, string_split(text, '. ') AS s FROM documents) SELECT doc_id, CAST(unnest(range(len(s))) AS INTEGER) AS pos, unnest(s) AS value FROM m")
texts("second_line", r"/'\n'/2", "SELECT doc_id, 0 AS pos, string_split(text, chr(10))[2] AS value FROM documents WHERE len(string_split(text, chr(10))) >= 2")
pages("between_delimiters", "/'<h1>'~'</h1>'/", _elements("h1") + " SELECT page_id, pos, tx AS value FROM e")

# ---- functions on texts

pages("trimmed_lower", "<a>:tx &trim &tolower", LINKS + " SELECT page_id, pos, lower(trim(tx)) AS tx FROM links")
pages("after_slash", "<a>:href &after('/')", LINKS + " SELECT page_id, pos, CASE WHEN contains(href, '/') THEN substr(href, instr(href, '/') + 1) ELSE '' END AS href FROM links")
pages("before_e", "<a>:href &before('e')", LINKS + " SELECT page_id, pos, CASE WHEN contains(href, 'e') THEN substr(href, 1, instr(href, 'e') - 1) ELSE '' END AS href FROM links")
pages("characters_mapped", "<a>:tx &char_replace('aeo,','AE')", LINKS + " SELECT page_id, pos, translate(tx, 'aeo,', 'AE') AS tx FROM links")
pages("titles_encoded", "<a>:href &html_encode", LINKS + " SELECT page_id, pos, replace(replace(replace(replace(replace(replace(href, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;'), '\\', '&bslash;') AS href FROM links")
pages("titles_decoded", "<title>:tx &html_decode", _elements("title") + " SELECT page_id, pos, replace(replace(replace(replace(tx, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&') AS tx FROM e")
pages("links_resolved", "<a>:href &url", LINKS + " SELECT page_id, pos, CASE WHEN starts_with(href, '/') THEN regexp_extract(url, '^[a-z]+://[^/]+') || href ELSE href END AS href FROM links")
pages("headings_stripped", "<h1>&tx", _elements("h1") + " SELECT page_id, pos, replace(replace(replace(tx, '&quot;', '\"'), '&lt;', '<'), '&amp;', '&') AS value FROM e")
pages("stripped_text", "<article>&txstr", _elements("article") + r" SELECT page_id, pos, trim(regexp_replace(replace(replace(replace(replace(regexp_replace(tx, '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&amp;', '&'), '[ \t\r\n<>]+', ' ', 'g')) AS value FROM e")
pages("page_titles", "&html_title", _elements("title") + " SELECT page_id, pos, trim(replace(replace(replace(tx, '&quot;', '\"'), '&lt;', '<'), '&amp;', '&')) AS value FROM e")
pages("main_text", "&html_main_text", None)
pages("form_controls", "<form>&form_inputs", None)
pages("tag_attributes", "<a>1 &tag_attrs", LINKS + " SELECT page_id, pos, '<tag_attrs tag_name=\"a\"><tag_attr name=\"href\" value=\"' || href || '\"></tag_attrs>' AS value FROM links WHERE pos = 0")
pages("parents_of_links", "<a>1 &tag_parent('li')", _elements("li", 0) + " SELECT page_id, pos, tx AS value FROM e WHERE pos = 0")
pages("tags_after_links", "<a>1 &tag_next", _elements("li", 0) + " SELECT page_id, 0 AS pos, tx AS value FROM e WHERE pos = 1")
pages("tag_positions", "<h1>&position", "WITH e AS (SELECT page_id, instr(html, '<h1>') - 1 AS a, length(regexp_extract(html, '<h1>.*?</h1>', 0, 's')) AS n FROM pages) SELECT page_id, 0 AS pos, '<position from=\"' || a || '\" to=\"' || (a + n) || '\" length=\"' || n || '\">' AS value FROM e")
pages("leaf_tags", "<nav>&tag_leaves", "WITH m AS (SELECT page_id, regexp_extract_all(regexp_extract(html, '<nav>.*?</nav>', 0, 's'), '<a\\s[^>]*>[^<]*</a>') AS v FROM pages) SELECT page_id, CAST(unnest(range(len(v))) AS INTEGER) AS pos, unnest(v) AS value FROM m")
pages(
    "repeated_patterns", "<nav>&repeat_patterns(3)",
    _elements("li") + """, n AS (SELECT page_id, count(*) - 1 AS n FROM e GROUP BY page_id)
SELECT page_id, CAST(unnest([0, 1, 2]) AS INTEGER) AS pos, '<pattern count="' || n || '" score="' || unnest([8, 7, 7]) * n || '">' || unnest(['li a /a /li li a /a /li', 'a /a /li li a /a /li', 'li a /a /li li a /a']) || '</pattern>' AS value FROM n WHERE n > 1""",
)
pages("list_views", "&find_repeat_views(2)")
pages("best_view", "&find_best_views(1)")
pages("leaf_records", "<li>1 &leaves_schema_query", "SELECT page_id, 0 AS pos, '{f1=<a NORECUR>1:tx}' AS value FROM pages")
pages("nested_query", "<nav>{first=&query('<a>1:href')}", LINKS + " SELECT page_id, 0 AS pos, href AS first FROM links WHERE pos = 0")
texts("email_addresses", "&get_email", r"SELECT doc_id, 0 AS pos, array_to_string(regexp_extract_all(text, '[\w.+-]+@[\w-]+(?:\.[\w-]+)+'), chr(10)) AS value FROM documents")
texts("dates_found", "&get_date(1)", r"SELECT doc_id, 0 AS pos, regexp_replace(regexp_extract(text, '\b\d{4}-\d{2}-\d{2}\b'), '-', '/', 'g') AS value FROM documents")
texts("numbers_found", "&get_number(1)")

# ---- updates of documents

pages("attribute_set", "<h1>&set_attribute('class','head')", "SELECT page_id, 0 AS pos, regexp_replace(html, '<h1>', '<h1 class=\"head\">', 'g') AS value FROM pages")
pages("elements_deleted", "<h1>&delete", "SELECT page_id, 0 AS pos, regexp_replace(html, '<h1>.*?</h1>', '', 'gs') AS value FROM pages")
pages("elements_replaced", "<title>:tx &update('T')", "SELECT page_id, 0 AS pos, regexp_replace(html, '<title>.*?</title>', '<title>T</title>', 's') AS value FROM pages")
pages("text_inserted", "<title>&insert('<!-- t -->')", "SELECT page_id, 0 AS pos, regexp_replace(html, '<title>', '<!-- t --><title>') AS value FROM pages")
pages("within_rows_replaced", "<a>:tx &replace('e','3')", LINKS + " SELECT page_id, pos, replace(tx, 'e', '3') AS tx FROM links")
pages("urls_rewritten", "<nav>&url_all", "SELECT page_id, 0 AS pos, replace(regexp_extract(html, '<nav>.*?</nav>', 0, 's'), 'href=\"/', 'href=\"' || regexp_extract(url, '^[a-z]+://[^/]+') || '/') AS value FROM pages")

# ---- patterns, dictionaries, alignment

add("pattern_numbers", lambda s, d: match.search(table(s, d, "documents"), r"\d+"), r"WITH m AS (SELECT doc_id, regexp_extract_all(text, '\d+') AS v FROM documents) SELECT doc_id, CAST(unnest(range(len(v))) AS INTEGER) AS pos, unnest(v) AS value FROM m")
add("pattern_words", lambda s, d: match.search(table(s, d, "documents"), r"th[a-z]+e", case=False), r"WITH m AS (SELECT doc_id, regexp_extract_all(text, '(?i)th[a-z]+e') AS v FROM documents) SELECT doc_id, CAST(unnest(range(len(v))) AS INTEGER) AS pos, unnest(v) AS value FROM m")
SETS = {"insults": ("idiot", "clown", "scum"), "articles": ("the", "a", "an")}
add("named_set", lambda s, d: match.search(table(s, d, "documents"), r"&[s:insults]", sets=SETS, case=False), r"WITH m AS (SELECT doc_id, regexp_extract_all(text, '(?i)idiot|clown|scum') AS v FROM documents) SELECT doc_id, CAST(unnest(range(len(v))) AS INTEGER) AS pos, unnest(v) AS value FROM m")
add("word_sets", lambda s, d: match.search_words(table(s, d, "conversations"), r"&[ws:articles]<.*ing>", key="conv_id", sets=SETS, case=False), """
WITH w AS (SELECT conv_id, turn, string_split_regex(trim(text), '\\s+') AS ws FROM conversations), x AS (SELECT *, unnest(range(1, len(ws))) AS i FROM w)
SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id, turn ORDER BY i) - 1 AS INTEGER) AS pos, CAST(i - 1 AS INTEGER) AS start, ws[i] || ' ' || ws[i + 1] AS words FROM x WHERE lower(ws[i]) IN ('the', 'a', 'an') AND lower(ws[i + 1]) LIKE '%ing'""")
add("dictionary_tags", lambda s, d: keywords.tag(table(s, d, "documents"), {"idiot": "insult", "clown": "insult", "the": "article"}, spaces=" \n"), """
WITH w AS (SELECT doc_id, string_split_regex(text, '[ \n]') AS ws FROM documents),
x AS (SELECT doc_id, unnest(range(len(ws))) AS i, unnest(ws) AS w, ws FROM w),
k AS (SELECT doc_id, i, lower(w) AS keyword, CASE lower(w) WHEN 'the' THEN 'article' ELSE 'insult' END AS value,
  sum(length(w) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, w FROM x)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS pos, keyword, value, CAST(coalesce(before, 0) AS BIGINT) AS at
FROM k WHERE keyword IN ('idiot', 'clown', 'the')""")


def _aligned(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")
    r = table(spark, d, "region").select(F.col("r_regionkey").alias("n_regionkey"), "r_name")
    return match.align_pairs(n.join(r, "n_regionkey"), "n_name", "r_name").select("n_nationkey", "cost")


add("alignment_costs", _aligned, None)
add("closest_texts", lambda s, d: match.closest(table(s, d, "supplier").select("s_suppkey", "s_name"), {"a": "Supplier#000000001", "b": "Supplier#000000099"}, "s_suppkey", "s_name"), None)

# ---- naive Bayes


def _cases(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "lang", "source").join(table(spark, d, "labels"), "doc_id")


def _bayes(spark: SparkSession, d: str) -> bayes.Model:
    return bayes.fit(_cases(spark, d), "quality", ["lang", "source"])


_CASES = "c AS (SELECT doc_id, lang, source, quality FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL), f AS (SELECT CAST(quality AS VARCHAR) AS label, 'lang' AS feature, lang AS value FROM c UNION ALL SELECT CAST(quality AS VARCHAR), 'source', source FROM c)"
add("bayes_counts", lambda s, d: _bayes(s, d).counts, f"WITH {_CASES} SELECT label, feature, value, count(*) AS n FROM f GROUP BY ALL")
add("bayes_scores", lambda s, d: _bayes(s, d).predict(_cases(s, d).select("doc_id", "lang", "source"), "doc_id").select("doc_id", "label", F.round("probability", 6).alias("probability")), f"""
WITH {_CASES}, n AS (SELECT CAST(quality AS VARCHAR) AS label, count(*) AS n FROM c GROUP BY 1), tot AS (SELECT sum(n) AS total, count(*) AS classes FROM n),
v AS (SELECT feature, value FROM f GROUP BY ALL), g AS (SELECT v.feature, v.value, n.label, n.n AS nl, count(f.label) AS nv FROM v CROSS JOIN n LEFT JOIN f ON f.feature = v.feature AND f.value = v.value AND f.label = n.label GROUP BY ALL),
l AS (SELECT feature, value, label, ln((nv + 0.5) / (nl + 2 * 0.5)) AS lp FROM g),
s AS (SELECT c.doc_id, a.label, a.lp + b.lp + ln((n.n + 0.5) / (tot.total + tot.classes * 0.5)) AS lp FROM c JOIN l a ON a.feature = 'lang' AND a.value = c.lang JOIN l b ON b.feature = 'source' AND b.value = c.source AND b.label = a.label JOIN n ON n.label = a.label CROSS JOIN tot),
m AS (SELECT doc_id, label, lp, max(lp) OVER (PARTITION BY doc_id) AS top FROM s)
SELECT doc_id, label, round(exp(lp - top) / sum(exp(lp - top)) OVER (PARTITION BY doc_id), 6) AS probability FROM m""")

# ---- the table dialect

_GROUPED = "SELECT o_orderstatus, count(o_orderkey) AS n, sum(o_totalprice) AS total, max(o_totalprice) AS most, min(o_totalprice) AS least FROM orders WHERE o_totalprice > 1000 GROUP BY o_orderstatus HAVING n > 10"
add("sql_group", lambda s, d: execute(table(s, d, "orders"), _GROUPED).withColumn("total", F.round("total", 2)), "SELECT o_orderstatus, CAST(count(*) AS DOUBLE) AS n, round(sum(o_totalprice), 2) AS total, max(o_totalprice) AS most, min(o_totalprice) AS least FROM orders WHERE o_totalprice > 1000 GROUP BY 1 HAVING count(*) > 10")
dialect("sql_count_arguments", "lineitem", "SELECT l_returnflag, count(l_orderkey, l_partkey) AS n FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, CAST(2 * count(*) AS DOUBLE) AS n FROM lineitem GROUP BY 1")
dialect("sql_where_like", "customer", "SELECT c_custkey, c_name FROM customer WHERE c_name LIKE '%#0000000_1' and c_acctbal > 0", "SELECT CAST(c_custkey AS DOUBLE) AS c_custkey, c_name FROM customer WHERE regexp_matches(c_name, '#0000000.1$') AND c_acctbal > 0")
dialect("sql_order_typed", "part", "SELECT p_name, p_size FROM part WHERE p_size > 40 ORDER BY p_size NUMBER DESC, p_name", "SELECT p_name, CAST(p_size AS DOUBLE) AS p_size FROM part WHERE p_size > 40")
dialect("sql_unique", "customer", "SELECT UNIQUE c_mktsegment FROM customer", "SELECT DISTINCT c_mktsegment FROM customer")
dialect("sql_expressions", "nation", "SELECT n_nationkey, upper(n_name) AS a, substr(n_name, 0, 2) + '-' + n_regionkey AS b, n_nationkey % 7 AS c, strlen(n_name) / 2 AS d FROM nation", "SELECT CAST(n_nationkey AS DOUBLE) AS n_nationkey, upper(n_name) AS a, substr(n_name, 1, 2) || '-' || n_regionkey AS b, CAST(n_nationkey % 7 AS DOUBLE) AS c, strlen(n_name) / 2.0 AS d FROM nation")
dialect("sql_dates", "orders", "SELECT o_orderkey, months_between(o_orderdate, #1998-12-01#) AS m, datediff('month', o_orderdate, #1995-01-01#) AS k FROM orders WHERE o_orderdate >= #1995-06-01#", "SELECT CAST(o_orderkey AS DOUBLE) AS o_orderkey, CAST((1998 - year(o_orderdate)) * 12 + 12 - month(o_orderdate) AS DOUBLE) AS m, CAST((year(o_orderdate) - 1995) * 12 + month(o_orderdate) - 1 AS DOUBLE) AS k FROM orders WHERE o_orderdate >= TIMESTAMP '1995-06-01'")
dialect("sql_delete", "nation", "DELETE FROM nation WHERE n_regionkey = 1", "SELECT * FROM nation WHERE n_regionkey <> 1")
dialect("sql_update", "region", "UPDATE region SET r_name = lower(r_name) WHERE r_regionkey > 1", "SELECT r_regionkey, CASE WHEN r_regionkey > 1 THEN lower(r_name) ELSE r_name END AS r_name FROM region")
dialect("sql_insert", "region", "INSERT INTO region (r_regionkey, r_name) VALUES (9, 'NOWHERE')", "SELECT * FROM region UNION ALL SELECT 9, 'NOWHERE'")
dialect("sql_rownum", "nation", "SELECT rownum AS n, n_name FROM nation WHERE rownum <= 10", "SELECT CAST(row_number() OVER () AS DOUBLE) AS n, n_name FROM nation QUALIFY n <= 10")
dialect("sql_word_counts", "documents", "SELECT doc_id, text_words(text) AS words, strlen(text) AS bytes FROM documents", r"SELECT CAST(doc_id AS DOUBLE) AS doc_id, CAST(len(regexp_extract_all(text, '[^\x00-\x7F]|[A-Za-z0-9_]+')) AS DOUBLE) AS words, CAST(strlen(text) AS DOUBLE) AS bytes FROM documents")
dialect("sql_null_or", "customer", "SELECT c_custkey, c_mktsegment /& 'none' AS s FROM customer WHERE c_mktsegment is not null or c_acctbal < 0", "SELECT CAST(c_custkey AS DOUBLE) AS c_custkey, rtrim(c_mktsegment) AS s FROM customer")
add("cross_tables", lambda s, d: table(s, d, "nation").join(table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).transform(lambda t: execute(t, "SELECT r_name, count(n_name) AS n FROM t GROUP BY r_name")), "SELECT r_name, CAST(count(*) AS DOUBLE) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")

add(
    "sql_two_tables",
    lambda s, d: execute_over({"nation": table(s, d, "nation"), "region": table(s, d, "region")}, "SELECT n.n_name AS nation, r_name AS region FROM nation AS n, region r WHERE n.n_regionkey = r.r_regionkey and r_name like 'A%'"),
    "SELECT n_name AS nation, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name LIKE 'A%'",
)
dialect("sql_url_parts", "pages", "SELECT page_id, gethostname(url) AS host, getdomainname(url) AS domain, getpathname(url) AS path FROM pages", "SELECT CAST(page_id AS DOUBLE) AS page_id, regexp_extract(url, '//([^/?#:]*)', 1) AS host, regexp_extract(regexp_extract(url, '//([^/?#:]*)', 1), '[^.]+\\.[^.]+$') AS domain, regexp_extract(url, '//[^/?#]*([^?#]*)', 1) AS path FROM pages")


def _table_function(spark: SparkSession, d: str) -> DataFrame:
    from fathom.api import register_sql

    register_sql(spark)
    table(spark, d, "pages").createOrReplaceTempView("fathom_pages")
    return spark.sql("SELECT page_id, q.pos, q.fields[0] AS href, q.fields[1] AS tx FROM fathom_pages, LATERAL doc_query(html, '<a>:href,tx', url) q")


add("sql_table_function", _table_function, LINKS + " SELECT page_id, pos, href, tx FROM links")

# ---- series and sinks

EVENTS = ["ts", "event_id"]
add("events_moving_mean", lambda s, d: series.moving(table(s, d, "events"), ["user_id"], EVENTS, "value", 2).select("event_id", F.round("moved", 6).alias("moved")), "SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS moved FROM events")
add("events_moving_median", lambda s, d: series.moving(table(s, d, "events"), ["user_id"], EVENTS, "value", 2, 2, "median").select("event_id", F.round("moved", 6).alias("moved")), "SELECT event_id, round(median(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS moved FROM events")
add("events_difference", lambda s, d: series.difference(table(s, d, "events"), ["user_id"], EVENTS, "value").select("event_id", F.round("difference", 6).alias("difference")), "SELECT event_id, round(value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), 6) AS difference FROM events")
add("events_summary", lambda s, d: series.summary(table(s, d, "events"), ["event_type"], "value").select("event_type", "n", F.round("mean", 6).alias("mean"), F.round("deviation", 6).alias("deviation"), "least", "most"), "SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS deviation, min(value) AS least, max(value) AS most FROM events GROUP BY 1")
add("events_resampled", lambda s, d: series.resample(table(s, d, "events"), ["event_type"], "ts", "value", "1 hour").select("event_type", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), F.round("mean", 6).alias("mean")), "SELECT event_type, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, round(avg(value), 6) AS mean FROM events GROUP BY 1, date_trunc('hour', ts)")
add("events_peaks", lambda s, d: series.peaks(table(s, d, "events"), ["user_id"], EVENTS, "value").select("event_id", "value"), "WITH e AS (SELECT *, lag(value) OVER w AS a, lead(value) OVER w AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT event_id, value FROM e WHERE value > a AND value >= b")
add("html_table_rows", lambda s, d: tables.html_rows(table(s, d, "region").select("r_name", F.col("r_regionkey").cast("string").alias("k"))), "SELECT '<tr><td>' || r_name || '</td><td>' || r_regionkey || '</td></tr>' AS value FROM region")
add("xml_rows", lambda s, d: tables.xml_rows(table(s, d, "region").select("r_name"), "region"), "SELECT '<region><r_name>' || r_name || '</r_name></region>' AS value FROM region")

# ---- documents built from rows: tables, forms, lines


def built(name: str, of: str, key: str, made: str, text: str, sql: str | None, **options) -> None:
    """A query over documents that a Spark expression makes of each row of a table."""
    add(name, lambda spark, d: query(table(spark, d, of).selectExpr(key, f"{made} AS html"), text, url=None, keep=(key,), **options), sql)


_GRID = "concat('<table><tr><th>Key</th><th>Name</th></tr><tr><td>', n_nationkey, '</td><td>', n_name, '</td></tr></table>')"
built("cells_with_headers", "nation", "n_nationkey", _GRID, "<td>:tx,th", "SELECT n_nationkey, 0 AS pos, CAST(n_nationkey AS VARCHAR) AS tx, 'Key' AS th FROM nation UNION ALL SELECT n_nationkey, 1, n_name, 'Name' FROM nation")
built("rows_with_headers", "nation", "n_nationkey", _GRID, "<tr>2:th", "SELECT n_nationkey, 0 AS pos, CAST(n_nationkey AS VARCHAR) AS th FROM nation")
built("header_above_spans", "nation", "n_nationkey", "concat('<table><tr><th colspan=2>Both</th><th>Name</th></tr><tr><td>', n_nationkey, '</td><td>', n_regionkey, '</td><td>', n_name, '</td></tr></table>')", "<td>3:tx,th", "SELECT n_nationkey, 0 AS pos, n_name AS tx, 'Name' AS th FROM nation")
_FORM = "concat('<form action=/go>Name <input name=\"n\" value=\"', n_name, '\"><select name=r><option value=', n_regionkey, '>One</option><option value=x>Two</option></select><textarea name=t>', lower(n_name), '</textarea></form>')"
built(
    "form_controls_of_rows", "nation", "n_nationkey", _FORM, "<form>&form_inputs",
    """SELECT n_nationkey, 0 AS pos, '<form_inputs><form_input name="n" id="" value="' || n_name || '" type="text" description="Name"></form_input>'
|| '<form_input name="r" id="" value="' || n_regionkey || '" type="select" description="Name"><option value="' || n_regionkey || '" text="One"><option value="x" text="Two"></form_input>'
|| '<form_input name="t" id="" value="' || lower(n_name) || '" type="textarea" description="Two"></form_input></form_inputs>' AS value FROM nation""",
)
_LINE = "concat(c_custkey, ',\"', c_name, ', \"\"', c_mktsegment, '\"\"\",', c_nationkey)"
built("csv_field", "customer", "c_custkey", _LINE, "&get_csvfield(',',2)", "SELECT c_custkey, 0 AS pos, c_name || ', \"' || c_mktsegment || '\"' AS value FROM customer")
built("csv_field_from_end", "customer", "c_custkey", _LINE, "&get_csvfield(',',-1)", "SELECT c_custkey, 0 AS pos, CAST(c_nationkey AS VARCHAR) AS value FROM customer")
built("response_headers_skipped", "customer", "c_custkey", r"concat('Status: 200\r\nLength: 9\r\n\r\n', c_name)", "&skip_header", "SELECT c_custkey, 0 AS pos, c_name AS value FROM customer")
built("response_headers_removed", "customer", "c_custkey", r"concat('Status: 200\r\n\r\n<b>', c_name, '</b>')", "&remove_header <b>:tx", "SELECT c_custkey, 0 AS pos, c_name AS tx FROM customer")
built("numbers_in_lines", "orders", "o_orderkey", "concat('order ', o_orderkey, ' by ', o_custkey, ', due')", "&get_number(2)", "SELECT o_orderkey, 0 AS pos, CAST(o_custkey AS VARCHAR) AS value FROM orders")
built("numbers_from_end", "orders", "o_orderkey", "concat('order ', o_orderkey, ' by ', o_custkey, ', due')", "&get_number(-1)", "SELECT o_orderkey, 0 AS pos, CAST(o_custkey AS VARCHAR) AS value FROM orders")
built("dates_in_lines", "orders", "o_orderkey", "concat('placed ', date_format(o_orderdate, 'd MMMM yyyy'), ' or 12/31/2020')", "&get_date(1)", "SELECT o_orderkey, 0 AS pos, strftime(o_orderdate, '%Y/%m/%d') AS value FROM orders")
built("second_date_in_lines", "orders", "o_orderkey", "concat('from 1990-02-03 to ', date_format(o_orderdate, 'yyyy.M.d'))", "&get_date(2)", "SELECT o_orderkey, 0 AS pos, strftime(o_orderdate, '%Y/%m/%d') AS value FROM orders")
built("addresses_of_links", "customer", "c_custkey", "concat('<img src=\"/i/', c_custkey, '.png\"><a href=\"/c/', c_custkey, '\">k</a>')", "<a>&get_url", "SELECT c_custkey, 0 AS pos, '/c/' || c_custkey AS value FROM customer")
built("links_by_base", "customer", "c_custkey", "concat('<base href=\"http://b.example/x/\"><a href=\"c', c_custkey, '\">k</a>')", "<a>:href &url", "SELECT c_custkey, 0 AS pos, 'http://b.example/x/c' || c_custkey AS href FROM customer")
built("emails_with_names", "customer", "c_custkey", "concat('write Ann Lee <a', c_custkey, '@x.example> or B', c_custkey, '@y.example')", "&get_email('%n:%m')", "SELECT c_custkey, 0 AS pos, 'Ann Lee:a' || c_custkey || '@x.example' || chr(10) || ':B' || c_custkey || '@y.example' AS value FROM customer")
built("attribute_deleted", "nation", "n_nationkey", "concat('<b id=\"', n_nationkey, '\" k=1>', n_name, '</b>')", "<b>&delete_attribute('id')", "SELECT n_nationkey, 0 AS pos, '<b k=1>' || n_name || '</b>' AS value FROM nation")
built("attribute_quoted", "nation", "n_nationkey", "concat('<b>', n_name, '</b>')", "<b>&set_attribute('t','a \"b\"')", "SELECT n_nationkey, 0 AS pos, '<b t=''a \"b\"''>' || n_name || '</b>' AS value FROM nation")
built("cdata_unwrapped", "nation", "n_nationkey", "concat('<p><![CDATA[a<', n_name, ']]></p>')", "<p>:tx", "SELECT n_nationkey, 0 AS pos, 'a<' || n_name AS tx FROM nation")
built("nested_elements", "nation", "n_nationkey", "concat('<div>', n_name, '<div>', n_regionkey, '</div></div>')", "<div NORECUR>:tx", "SELECT n_nationkey, 0 AS pos, n_name || '<div>' || n_regionkey || '</div>' AS tx FROM nation UNION ALL SELECT n_nationkey, 1, CAST(n_regionkey AS VARCHAR) FROM nation")
built("outermost_elements", "nation", "n_nationkey", "concat('<div>', n_name, '<div>', n_regionkey, '</div></div>')", "<div RECUR>:tx", "SELECT n_nationkey, 0 AS pos, n_name || '<div>' || n_regionkey || '</div>' AS tx FROM nation")
built("elements_by_case", "nation", "n_nationkey", "concat('k=', n_name, ';K=', n_regionkey, ';')", "/'K='~';' SEN/", "SELECT n_nationkey, 0 AS pos, CAST(n_regionkey AS VARCHAR) AS value FROM nation")
built("elements_by_either_case", "nation", "n_nationkey", "concat('k=', n_name, ';K=', n_regionkey, ';')", "/'K='~';' INSEN/", "SELECT n_nationkey, 0 AS pos, n_name AS value FROM nation UNION ALL SELECT n_nationkey, 1, CAST(n_regionkey AS VARCHAR) FROM nation")

# ---- sources, options and implicit attributes

pages("literal_source", "'<b>k</b><b>l</b>' <b>:tx", "SELECT page_id, 0 AS pos, 'k' AS tx FROM pages UNION ALL SELECT page_id, 1, 'l' FROM pages")
pages("source_set", "<nav>1 &set_source <li>1:tx", "SELECT page_id, 0 AS pos, regexp_extract(html, '<li>(.*?)</li>', 1, 's') AS tx FROM pages WHERE html LIKE '%<li>%'")
pages("grouped_query", "(<a>2):href", LINKS + " SELECT page_id, 0 AS pos, href FROM links WHERE pos = 1")
pages("insides", "<h1 EXCL>", _elements("h1") + " SELECT page_id, pos, tx AS value FROM e")
pages("with_delimiters", "/'<h1>'~'</h1>' INCL/", _elements("h1", 0) + " SELECT page_id, pos, tx AS value FROM e")
pages("element_and_text_after", "<title>:hx", "SELECT page_id, 0 AS pos, regexp_extract(html, '<title>.*?</title>[^<]*', 0, 's') AS hx FROM pages")
pages("end_tags", "<@et>1:tt", "SELECT page_id, 0 AS pos, '</title>' AS tt FROM pages")
pages("start_tags", "<@st>1-3:tn", "SELECT page_id, CAST(unnest(range(3)) AS INTEGER) AS pos, unnest(['html', 'head', 'meta']) AS tn FROM pages")
pages("plain_star", "<li>1:tx,ht", _elements("li", 0) + " SELECT page_id, pos, regexp_extract(tx, '<li>(.*)</li>', 1, 's') AS tx, tx AS ht FROM e WHERE pos = 0")
pages("texts_unescaped", "<title>:tx &url_encode &url_decode", _elements("title") + " SELECT page_id, pos, tx FROM e")
pages("link_parts", "<a>:href &substr(1,3)", LINKS + " SELECT page_id, pos, substr(href, 2, 3) AS href FROM links")
pages("source_offset", "&offset(1,9)", "SELECT page_id, 0 AS pos, substr(html, 2, 9) AS value FROM pages")
pages("upper_titles", "<title>:tx &toupper", _elements("title") + " SELECT page_id, pos, upper(replace(tx, 'ß', 'ss')) AS tx FROM e")
pages("inserted_after", "<title>&insert_after('!')", "SELECT page_id, 0 AS pos, regexp_replace(html, '</title>', '</title>!') AS value FROM pages")
pages("elements_updated", "<h1>:tx &replace('X')", "SELECT page_id, 0 AS pos, regexp_replace(html, '<h1>.*?</h1>', '<h1>X</h1>', 'gs') AS value FROM pages")
pages("pattern_conditions", "<a>{t=:tx | t =~ 'th[a-z]*' and not (t =~~ 'the')}", LINKS + ", k AS (SELECT * FROM links WHERE regexp_full_match(tx, '(?i)th[a-z]*') AND tx <> 'the') SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY pos) - 1 AS INTEGER) AS pos, tx AS t FROM k")
pages("pattern_in_condition", "<a>{t=:tx | t ~ 'the'}", LINKS + ", k AS (SELECT * FROM links WHERE contains(lower(tx), 'the')) SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY pos) - 1 AS INTEGER) AS pos, tx AS t FROM k")
pages("records_minus", "<a>{t=:tx | | n=strlen(t)-1; c=t+&'!'}", LINKS + " SELECT page_id, pos, CAST(strlen(tx) - 1 AS VARCHAR) AS n, tx || '!' AS c FROM links")
pages("records_formatted", "<a>{t=:tx | | f=format('%s:%03d', t, strlen(t)); m=max(strlen(t), 4); k=min(strlen(t), 4)}", LINKS + " SELECT page_id, pos, tx || ':' || lpad(CAST(strlen(tx) AS VARCHAR), 3, '0') AS f, CAST(greatest(strlen(tx), 4) AS VARCHAR) AS m, CAST(least(strlen(tx), 4) AS VARCHAR) AS k FROM links")
pages("records_prefix", "<a>{h=:href; t=:tx | | p=string_comp(h, '/the', 'prefix')}", LINKS + " SELECT page_id, pos, CASE WHEN starts_with(href, '/the') THEN '/the' WHEN starts_with(href, '/th') THEN '/th' WHEN starts_with(href, '/t') THEN '/t' WHEN starts_with(href, '/') THEN '/' ELSE '' END AS p FROM links")
pages("records_dates", "<a>1{t=:tx | | d=to_char('2021-03-04', 'DD.MM.YYYY'); e=strlen(utf8_encode(t))}", LINKS + " SELECT page_id, pos, '04.03.2021' AS d, CAST(strlen(tx) + 2 * (strlen(tx) - length(tx)) AS VARCHAR) AS e FROM links WHERE pos = 0")

# ---- patterns with marks of their own, dictionaries in other orders

add("pattern_overlapping", lambda s, d: match.search(table(s, d, "customer"), "00", key="c_custkey", text="c_name", overlap=True), "WITH x AS (SELECT c_custkey, unnest(range(1, length(c_name))) AS i, c_name FROM customer) SELECT c_custkey, CAST(row_number() OVER (PARTITION BY c_custkey ORDER BY i) - 1 AS INTEGER) AS pos, '00' AS value FROM x WHERE substr(c_name, i, 2) = '00'")
add("pattern_words_in_a_row", lambda s, d: match.search_words(table(s, d, "part"), "<small|cold><widget>", key="p_partkey", text="p_name"), "SELECT p_partkey, 0 AS pos, 0 AS start, p_name AS words FROM part WHERE p_name IN ('small widget', 'cold widget')")


def _ordered(order: str) -> None:
    sql = f"SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY {order}) - 1 AS INTEGER) AS pos, keyword, value, \"at\" FROM (SELECT p_partkey AS doc_id, unnest(['widget', 'cold']) AS keyword, unnest(['a', 'b']) AS value, CAST(instr(' ' || p_name || ' ', ' ' || unnest(['widget', 'cold']) || ' ') - 1 AS BIGINT) AS \"at\" FROM part) WHERE \"at\" >= 0"
    add(f"dictionary_by_{order}", lambda s, d: keywords.tag(table(s, d, "part").selectExpr("p_partkey AS doc_id", "p_name AS text"), {"widget": "a", "cold": "b"}, order={"keyword": "key"}.get(order, order), spaces=" "), sql)


_ordered("keyword")
_ordered("value")

# ---- functions of the table dialect

dialect("sql_trims", "customer", "SELECT c_custkey, ltrim(c_name, 'Cu') AS a, rtrim(c_name, '0') AS b, ltrim('  ' + c_mktsegment) AS c, rtrim(c_mktsegment + ' ') AS d FROM customer", "SELECT CAST(c_custkey AS DOUBLE) AS c_custkey, ltrim(c_name, 'Cu') AS a, rtrim(c_name, '0') AS b, c_mktsegment AS c, c_mktsegment AS d FROM customer")
dialect("sql_joined_texts", "customer", "SELECT c_custkey, strcat(c_name, '/', c_mktsegment) AS a, c_name +& c_mktsegment AS b FROM customer", "SELECT CAST(c_custkey AS DOUBLE) AS c_custkey, c_name || '/' || c_mktsegment AS a, c_name || c_mktsegment AS b FROM customer")
dialect("sql_compared_texts", "customer", "SELECT c_custkey, strcmp(c_mktsegment, 'FURNITURE') AS a, strcmpi(c_mktsegment, 'furniture') AS b FROM customer", "SELECT CAST(c_custkey AS DOUBLE) AS c_custkey, CAST(CASE WHEN c_mktsegment < 'FURNITURE' THEN -1 WHEN c_mktsegment > 'FURNITURE' THEN 1 ELSE 0 END AS DOUBLE) AS a, CAST(CASE WHEN lower(c_mktsegment) < 'furniture' THEN -1 WHEN lower(c_mktsegment) > 'furniture' THEN 1 ELSE 0 END AS DOUBLE) AS b FROM customer")
dialect("sql_replaced", "customer", "SELECT c_custkey, replace(c_name, '#0', '-') AS a, packnull(c_name) AS b FROM customer", "SELECT CAST(c_custkey AS DOUBLE) AS c_custkey, replace(c_name, '#0', '-') AS a, c_name AS b FROM customer")
dialect("sql_encoded", "part", "SELECT p_partkey, html_encode('<' + p_name + '&>') AS a, html_decode('&lt;' + p_name + '&amp;') AS b, url_encode(p_name + '#') AS c, url_decode('a%20' + p_name) AS d FROM part", "SELECT CAST(p_partkey AS DOUBLE) AS p_partkey, '&lt;' || p_name || '&amp;&gt;' AS a, '<' || p_name || '&' AS b, replace(p_name, ' ', '+') || '%23' AS c, 'a ' || p_name AS d FROM part")
dialect("sql_kinds_of_texts", "customer", "SELECT c_custkey, ischar(c_name) AS a, isnumber(substr(c_name, 9)) AS b, isblank(c_mktsegment) AS c, isphonenumber('555-01' + c_custkey) AS d, isphonenumber(c_name) AS e FROM customer", "SELECT CAST(c_custkey AS DOUBLE) AS c_custkey, true AS a, true AS b, false AS c, true AS d, false AS e FROM customer")
dialect("sql_numbers_found", "customer", "SELECT c_custkey, get_number(c_name) AS a, to_number(substr(c_name, 9)) AS b FROM customer", "SELECT CAST(c_custkey AS DOUBLE) AS c_custkey, CAST(c_custkey AS DOUBLE) AS a, CAST(c_custkey AS DOUBLE) AS b FROM customer")
dialect("sql_times", "orders", "SELECT o_orderkey, time(o_orderdate) AS a, time(to_date('1995-01-02 03:04:05')) AS b FROM orders", "SELECT CAST(o_orderkey AS DOUBLE) AS o_orderkey, CAST(epoch(o_orderdate) AS DOUBLE) AS a, CAST(epoch(TIMESTAMP '1995-01-02 03:04:05') AS DOUBLE) AS b FROM orders")
dialect("sql_months_added", "orders", "SELECT o_orderkey, time(add_months(o_orderdate, 3)) AS a, time(add_months(o_orderdate, -14)) AS b FROM orders", "SELECT CAST(o_orderkey AS DOUBLE) AS o_orderkey, CAST(epoch(date_trunc('month', o_orderdate) + INTERVAL 3 MONTH + to_days(CAST(day(o_orderdate) - 1 AS INTEGER))) AS DOUBLE) AS a, CAST(epoch(date_trunc('month', o_orderdate) - INTERVAL 14 MONTH + to_days(CAST(day(o_orderdate) - 1 AS INTEGER))) AS DOUBLE) AS b FROM orders")
dialect("sql_last_days", "orders", "SELECT o_orderkey, time(last_day(o_orderdate)) AS a, time(next_day(o_orderdate, 'MONDAY')) AS b FROM orders", "SELECT CAST(o_orderkey AS DOUBLE) AS o_orderkey, CAST(epoch(CAST(last_day(o_orderdate) AS TIMESTAMP)) AS DOUBLE) AS a, CAST(epoch(o_orderdate + to_days(CAST(8 - isodow(o_orderdate) AS INTEGER))) AS DOUBLE) AS b FROM orders")
dialect("sql_date_spans", "orders", "SELECT o_orderkey, (o_orderdate - #1995-01-01#) / 86400 AS a, time(o_orderdate - 3600) AS b, time(o_orderdate + 60) AS c FROM orders WHERE sysdate > o_orderdate", "SELECT CAST(o_orderkey AS DOUBLE) AS o_orderkey, (epoch(o_orderdate) - epoch(TIMESTAMP '1995-01-01')) / 86400 AS a, CAST(epoch(o_orderdate) - 3600 AS DOUBLE) AS b, CAST(epoch(o_orderdate) + 60 AS DOUBLE) AS c FROM orders")
dialect("sql_rounded", "customer", "SELECT c_custkey, round(c_acctbal) AS a, floor(c_acctbal) AS b, ceil(c_acctbal) AS c, abs(c_acctbal - 5000) AS d, c_acctbal - 10 AS e FROM customer WHERE c_acctbal > 0", "SELECT CAST(c_custkey AS DOUBLE) AS c_custkey, floor(c_acctbal + 0.5 + 1e-10) AS a, floor(c_acctbal + 1e-10) AS b, ceil(c_acctbal - 1e-10) AS c, abs(c_acctbal - 5000) AS d, c_acctbal - 10 AS e FROM customer WHERE c_acctbal > 0")
dialect("sql_file_names", "pages", "SELECT page_id, getfilepath(url) AS a, getfilename(url) AS b FROM pages", "SELECT CAST(page_id AS DOUBLE) AS page_id, regexp_extract(url, '^(.*/)?', 1) AS a, regexp_extract(url, '([^/]*)$', 1) AS b FROM pages")
dialect("sql_last_of_group", "customer", "SELECT c_mktsegment, c_name, count(c_custkey) AS n FROM customer GROUP BY c_mktsegment", "SELECT c_mktsegment, max_by(c_name, c_custkey) AS c_name, CAST(count(*) AS DOUBLE) AS n FROM customer GROUP BY 1")
dialect("sql_totals", "customer", "SELECT max(c_nationkey, 12) AS m, min(c_nationkey, 12) AS k, count(c_custkey) AS n, sum(c_custkey, c_nationkey) AS s FROM customer", "SELECT CAST(greatest(max(c_nationkey), 12) AS DOUBLE) AS m, CAST(least(min(c_nationkey), 12) AS DOUBLE) AS k, CAST(count(*) AS DOUBLE) AS n, CAST(sum(c_custkey) + sum(c_nationkey) AS DOUBLE) AS s FROM customer")
dialect("sql_dates_written", "orders", "SELECT o_orderkey, to_char(o_orderdate, 'DD.MM.YYYY') AS a, to_char(o_orderdate, 'Month DD, HH24:MI') AS b, to_char(o_orderdate) AS c FROM orders", "SELECT CAST(o_orderkey AS DOUBLE) AS o_orderkey, strftime(o_orderdate, '%d.%m.%Y') AS a, strftime(o_orderdate, '%B %d, %H:%M') AS b, strftime(o_orderdate, '%Y/%m/%d %H:%M:%S') AS c FROM orders")
dialect("sql_dates_read", "orders", "SELECT o_orderkey, time(to_date(to_char(o_orderdate, 'DD.MM.YYYY'), 'DD.MM.YYYY')) AS a, time(to_date('none', 'YYYYMMDD', '1990-01-01')) AS b FROM orders", "SELECT CAST(o_orderkey AS DOUBLE) AS o_orderkey, CAST(epoch(date_trunc('day', o_orderdate)) AS DOUBLE) AS a, CAST(epoch(TIMESTAMP '1990-01-01') AS DOUBLE) AS b FROM orders")
dialect("sql_addresses", "customer", "SELECT c_custkey, get_email('to ' + c_name + '@x.example, b@y.example') AS a, strlen(utf8_encode('é' + c_name)) AS n FROM customer", "SELECT CAST(c_custkey AS DOUBLE) AS c_custkey, regexp_extract(c_name, '[0-9]+$') || '@x.example' || chr(10) || 'b@y.example' AS a, CAST(length(c_name) + 4 AS DOUBLE) AS n FROM customer")
dialect("sql_nested", "customer", "SELECT seg, n * 2 AS m FROM (SELECT c_mktsegment AS seg, count(c_custkey) AS n FROM customer GROUP BY c_mktsegment) AS g WHERE n > 1", "SELECT c_mktsegment AS seg, CAST(2 * count(*) AS DOUBLE) AS m FROM customer GROUP BY 1 HAVING count(*) > 1")


def _tables(spark: SparkSession, d: str, *names: str) -> dict[str, DataFrame]:
    return {n: table(spark, d, n) for n in names}


add(
    "sql_nested_joined",
    lambda s, d: execute_over(_tables(s, d, "nation", "customer"), "SELECT n.n_name AS nation, g.k AS customers FROM nation n, (SELECT c_nationkey, count(c_custkey) AS k FROM customer WHERE c_acctbal > 0 GROUP BY c_nationkey) g WHERE n.n_nationkey = g.c_nationkey"),
    "SELECT n_name AS nation, CAST(count(*) AS DOUBLE) AS customers FROM nation JOIN customer ON n_nationkey = c_nationkey WHERE c_acctbal > 0 GROUP BY 1",
)


def _created(spark: SparkSession, d: str) -> DataFrame:
    """A table made, filled and changed, beside others of which one is dropped."""
    found = _tables(spark, d, "nation", "region")
    for statement in ("CREATE TABLE sea (name char(20), depth number)", "INSERT INTO sea VALUES ('North', 95), ('Dead', 304)", "UPDATE sea SET depth = depth + 5 WHERE name = 'North'", "DELETE FROM nation WHERE n_regionkey > 0", "DROP TABLE region"):
        found = change(found, statement)
    assert set(found) == {"nation", "sea"}
    return execute_over(found, "SELECT n.n_name AS nation, s.name AS sea, s.depth AS depth FROM nation n, sea s")


add("sql_tables_created", _created, "SELECT n_name AS nation, unnest(['North', 'Dead']) AS sea, CAST(unnest([100, 304]) AS DOUBLE) AS depth FROM nation WHERE n_regionkey = 0")

# ---- queries found from examples, held against what they give


def _given(name: str, docs: Callable[[SparkSession, str], DataFrame], key: str, found: str, more: str, columns: list[str], sql: str) -> None:
    """The query that is found in each document, run on the same document."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        from fathom.api import register_sql

        register_sql(spark)
        made = docs(spark, d)
        best = query(made, found, keep=(key, "html")).select(key, "html", F.col("value").alias("best")).where("best <> ''")
        best.createOrReplaceTempView("fathom_found")
        cells = ", ".join(f"q.fields[{k}] AS {c}" for k, c in enumerate(columns))
        return spark.sql(f"SELECT {key}, q.pos, {cells} FROM fathom_found, LATERAL doc_query(html, concat(best, '{more}'), CAST(NULL AS STRING)) q")

    add(name, run, sql)


_given("queries_found", lambda s, d: table(s, d, "pages"), "page_id", "<ul>.<a> &find_query('short', 1)", ":href,tx", ["href", "tx"], LINKS + " SELECT page_id, pos, href, tx FROM links")
_given("queries_found_long", lambda s, d: table(s, d, "pages"), "page_id", r"<li> &find_query('long')./'\n'/1", ":tx", ["tx"], _elements("li") + " SELECT page_id, pos, tx FROM e")
_given("queries_found_of_one", lambda s, d: table(s, d, "pages"), "page_id", "<a>2 &find_query('short', 1)", ":href", ["href"], LINKS + " SELECT page_id, 0 AS pos, href FROM links WHERE pos = 1")
_given("queries_found_in_focus", lambda s, d: table(s, d, "pages"), "page_id", "<li>&find_focus_query", ":tx", ["tx"], _elements("li") + " SELECT page_id, pos, tx FROM e")
_given("key_queries_found", lambda s, d: table(s, d, "nation").selectExpr("n_nationkey", "concat('<p>Name: <b>', n_name, '</b> Region: <i>', n_regionkey, '</i></p>') AS html"), "n_nationkey", "<p>&key_leaves_query('name', 'region')", "", ["name", "region"], "SELECT n_nationkey, 0 AS pos, n_name AS name, CAST(n_regionkey AS VARCHAR) AS region FROM nation")
pages("text_queries_found", "<nav>&plain_leaves_query", LINKS + " SELECT page_id, 0 AS pos, string_agg('<@tx>' || (pos + 4) || ':tt', chr(10) ORDER BY pos) AS value FROM links GROUP BY page_id")
pages("leaf_queries_found", "<nav>&tag_leaves_query", LINKS + " SELECT page_id, 0 AS pos, string_agg('<a NORECUR>' || (pos + 1), chr(10) ORDER BY pos) AS value FROM links GROUP BY page_id")
_WORD = r"(?:[^\x00-\x7F]|[A-Za-z0-9_]+)"
texts("first_words", "&text_words('first', 2)", rf"SELECT doc_id, 0 AS pos, regexp_extract(text, '{_WORD}(?:[\x00-/:-@\[-^`{{-\x7F]*{_WORD})?') AS value FROM documents")
add("rows_inserted_once", lambda s, d: keys.insert_unique(table(s, d, "orders").where("o_orderkey % 3 = 0").select("o_custkey", "o_orderstatus").distinct(), table(s, d, "orders").select("o_custkey", "o_orderstatus"), ["o_custkey", "o_orderstatus"]), "SELECT DISTINCT o_custkey, o_orderstatus FROM orders")
add("ordered_by_flags", lambda s, d: keys.ordered(table(s, d, "part").select("p_partkey", "p_name"), [("p_name", "length desc"), ("p_name", "ci")]), "SELECT p_partkey, p_name FROM part")
