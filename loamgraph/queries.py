"""Queries over the driver's tables, one per operator of the survey, each with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F

from .functions import links, paths, values
from .functions.cost import CostParams
from .operators import canvas, clones, filestats, graph, history, notes, resolve, totals
from .plans import corpus
from .sources import files as sources

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}

WITH_FILES = f"WITH files AS ({corpus.FILES_SQL})"
WITH_PURCHASES = f"WITH edges AS ({corpus.PURCHASES_SQL}), pairs AS (SELECT DISTINCT source, target FROM edges), nodes AS (SELECT c_custkey * 2 AS id FROM customer UNION ALL SELECT s_suppkey * 2 + 1 FROM supplier)"
_REACH = "pairs AS MATERIALIZED (SELECT DISTINCT source, target FROM edges WHERE source <> target), reach AS (SELECT source AS u, target AS v FROM pairs UNION SELECT r.u, p.target FROM reach r JOIN pairs p ON p.source = r.v)"
WITH_REACH = f"WITH RECURSIVE edges AS ({corpus.PURCHASES_SQL}), {_REACH}, nodes AS (SELECT c_custkey * 2 AS id FROM customer UNION ALL SELECT s_suppkey * 2 + 1 FROM supplier)"
WITH_ORDERS = f"WITH RECURSIVE edges AS ({corpus.ORDER_EDGES_SQL}), {_REACH}, nodes AS (SELECT o_orderkey AS id FROM orders)"
WITH_BOXES = f"WITH boxes AS ({corpus.BOXES_SQL}), links AS ({corpus.BOX_EDGES_SQL})"


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


# --- sources -----------------------------------------------------------------


def _listing(spark, sf_dir):
    """Paths with names and folders that the filters drop among them."""
    d = corpus.files(spark, sf_dir).select("file_id", "path")
    k = F.col("file_id") % 12
    folder = paths.dirname(F.col("path"))
    odd = F.when(k == 0, F.concat(folder, F.lit("/package-lock.json"))).when(k == 1, F.concat(folder, F.lit("/node_modules/x"), F.col("file_id").cast("string"), F.lit(".js")))
    odd = odd.when(k == 2, F.concat(folder, F.lit("/app"), F.col("file_id").cast("string"), F.lit(".min.js"))).when(k == 3, F.concat(folder, F.lit("/README"), F.col("file_id").cast("string"))).when(k == 4, F.concat(folder, F.lit("/"), F.col("file_id").cast("string"), F.lit(".PY"))).otherwise(F.col("path"))
    return d.select(odd.alias("path")).distinct()


LISTING_SQL = f"""{WITH_FILES}, listing AS (
  SELECT DISTINCT CASE file_id % 12 WHEN 0 THEN dir || '/package-lock.json' WHEN 1 THEN dir || '/node_modules/x' || file_id || '.js' WHEN 2 THEN dir || '/app' || file_id || '.min.js'
    WHEN 3 THEN dir || '/README' || file_id WHEN 4 THEN dir || '/' || file_id || '.PY' ELSE path END AS path
  FROM (SELECT *, regexp_replace(path, '/[^/]*$', '') AS dir FROM files)
), kept AS (
  SELECT path, CASE regexp_extract(path, '(\\.[^./]*)$', 1) WHEN '.py' THEN 'python' WHEN '.go' THEN 'go' WHEN '.md' THEN 'markdown' WHEN '.json' THEN 'json' WHEN '.js' THEN 'javascript' END AS language FROM listing
  WHERE NOT regexp_matches(path, '(/package-lock\\.json|\\.min\\.js)$') AND path NOT LIKE '%/node_modules/%'
)"""


@query(LISTING_SQL.replace("\\\\", "\\") + "SELECT path, language, row_number() OVER (ORDER BY path) - 1 AS file_id FROM kept WHERE language IS NOT NULL")
def file_scan_filter(spark, sf_dir):
    return sources.with_ids(sources.claimed(_listing(spark, sf_dir))).select("path", "language", "file_id")


@query(WITH_FILES + "SELECT path, row_number() OVER (ORDER BY path) - 1 AS file_id FROM (SELECT path FROM files UNION SELECT CASE WHEN file_id % 2 = 0 THEN path ELSE '/second' || path END FROM files)")
def root_union_dedupe(spark, sf_dir):
    """All files below one root, and below a second one, which shares every other file with the first."""
    f = corpus.files(spark, sf_dir).select("file_id", "path")
    second = f.select(F.when(F.col("file_id") % 2 == 0, F.col("path")).otherwise(F.concat(F.lit("/second"), "path")).alias("path"))
    return sources.with_ids(sources.union_roots([f.select("path"), second])).select("path", "file_id")


# --- paths and links -----------------------------------------------------------


_UP = "regexp_replace({}, '/[^/]+/\\.\\.(/|$)', '/')"


@query(WITH_FILES + """, raw AS (SELECT file_id, path, regexp_replace(path, '/[^/]*$', '') AS dir, './../' || language || '//./../x' || file_id % 7 || '.h' AS link FROM files),
  j AS (SELECT *, dir || '/' || link AS joined FROM raw),
  c AS (SELECT *, regexp_replace(regexp_replace(joined, '/(\\./)+', '/', 'g'), '/+', '/', 'g') AS c0 FROM j),
  d AS (SELECT *, regexp_replace(regexp_replace(c0, '/[^/.]+/\\.\\./', '/'), '/[^/.]+/\\.\\./', '/') AS clean FROM c)
  SELECT file_id, dir, regexp_extract(path, '(\\.[^./]*)$', 1) AS ext, joined, clean, CASE WHEN dir = '/corpus/' || split_part(dir, '/', 3) || '/en' THEN '../../..' ELSE '../../..' END || clean AS way FROM d""".replace("\\\\", "\\"))
def path_functions(spark, sf_dir):
    f = corpus.files(spark, sf_dir)
    d = paths.dirname(F.col("path"))
    link = F.concat(F.lit("./../"), "language", F.lit("//./../x"), (F.col("file_id") % 7).cast("string"), F.lit(".h"))
    f = f.select("file_id", d.alias("dir"), paths.extension(F.col("path")).alias("ext"), paths.join(d, link).alias("joined"))
    f = f.withColumn("clean", paths.clean(F.col("joined")))
    # from a folder of another tree, so that the whole way up shows
    return f.withColumn("way", paths.relative(F.col("clean"), F.concat(F.lit("/a/b/c"), F.lit(""))))


@query(WITH_FILES + "SELECT file_id, list_aggregate([path_suffix FOR path_suffix IN [array_to_string(list_slice(parts, len(parts) - i + 1, len(parts)), '.') FOR i IN range(1, len(parts) + 1)]], 'string_agg', '|') AS suffixes FROM (SELECT file_id, string_split(substr(path, 2), '/') AS parts FROM files)")
def path_suffixes(spark, sf_dir):
    return corpus.files(spark, sf_dir).select("file_id", F.array_join(paths.suffixes(F.col("path"), "."), "|").alias("suffixes"))


@query(WITH_FILES + "SELECT CASE WHEN split_part(path, '/', 3) = 'src1' THEN 'Vendor/' || split_part(path, '/', 4) ELSE split_part(path, '/', 3) END AS dir_group, count(*) AS files FROM files GROUP BY 1")
def dir_groups(spark, sf_dir):
    p = F.regexp_replace("path", "^/corpus/src1/", "/corpus/Vendor/")
    return corpus.files(spark, sf_dir).groupBy(paths.group_key(p, F.lit("/corpus/")).alias("dir_group")).agg(F.count(F.lit(1)).alias("files"))


@query("SELECT language, '/corpus/' || CASE WHEN count(DISTINCT source) > 1 THEN '' ELSE min(source) || '/' || min(lang) || '/' END AS prefix FROM (SELECT lang, source, CASE lang WHEN 'en' THEN 'python' WHEN 'fr' THEN 'go' WHEN 'de' THEN 'markdown' ELSE 'json' END AS language FROM documents) GROUP BY 1")
def common_prefix(spark, sf_dir):
    ends = corpus.files(spark, sf_dir).groupBy("language").agg(F.min("path").alias("a"), F.max("path").alias("b"))
    return ends.select("language", paths.common_prefix(F.col("a"), F.col("b")).alias("prefix"))


def _hrefs(spark, sf_dir):
    p = corpus.table(spark, sf_dir, "pages").select("page_id", "url", F.posexplode(F.regexp_extract_all("html", F.lit('(?:href|src)="([^"]*)"'), 1)).alias("seq", "raw"))
    return p


HREFS_SQL = "hrefs AS (SELECT page_id, url, generate_subscripts(l, 1) - 1 AS seq, unnest(l) AS raw FROM (SELECT page_id, url, regexp_extract_all(html, '(?:href|src)=\"([^\"]*)\"', 1) AS l FROM pages))"


@query("WITH " + HREFS_SQL + "SELECT page_id, seq::INTEGER AS seq, raw FROM hrefs")
def href_refs(spark, sf_dir):
    return _hrefs(spark, sf_dir).select("page_id", "seq", "raw")


@query(r"""SELECT page_id, k, CASE WHEN c = '' OR regexp_matches(c, '^[A-Za-z][A-Za-z0-9+.\-]+:') OR starts_with(c, '//') OR regexp_matches(lower(c), '\.(png|pdf)$') THEN NULL ELSE c END AS link
  FROM (SELECT page_id, k, replace(replace(replace(regexp_extract(trim(v, ' '''), '^([^?#]*)', 1), '%20', ' '), '%2F', '/'), '%2B', '+') AS c FROM (
    SELECT page_id, 0 AS k, url AS v FROM pages UNION ALL SELECT page_id, 1, ' ''' || regexp_replace(url, '^https?://[^/]*', '') || ''' ' FROM pages
    UNION ALL SELECT page_id, 2, 'a%20b+c%2Fd' || page_id || '.html#x?y' FROM pages UNION ALL SELECT page_id, 3, 'img/' || page_id || '.PNG' FROM pages UNION ALL SELECT page_id, 4, '100%zz' || page_id || '%' FROM pages))""")
def weblink_clean(spark, sf_dir):
    p = corpus.table(spark, sf_dir, "pages").select("page_id", "url")
    i = F.col("page_id").cast("string")
    forms = F.array(F.col("url"), F.concat(F.lit(" '"), F.regexp_replace("url", "^https?://[^/]*", ""), F.lit("' ")), F.concat(F.lit("a%20b+c%2Fd"), i, F.lit(".html#x?y")), F.concat(F.lit("img/"), i, F.lit(".PNG")), F.concat(F.lit("100%zz"), i, F.lit("%")))
    rows = p.select("page_id", F.posexplode(forms).alias("k", "raw"))
    return rows.select("page_id", "k", links.weblink(F.col("raw")).alias("link"))


@query(r"""SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN './lib\x' || p_partkey || '.bat' WHEN 1 THEN './y.ps1' WHEN 2 THEN './z.cmd' WHEN 3 THEN NULL WHEN 4 THEN 'plain ' || p_partkey ELSE NULL END AS path FROM part""")
def script_paths(spark, sf_dir):
    k = F.col("p_partkey")
    raw = F.when(k % 6 == 0, F.concat(F.lit("\"%~dp0lib\\x"), k.cast("string"), F.lit(".bat\""))).when(k % 6 == 1, F.lit("$PSScriptRoot/y.ps1")).when(k % 6 == 2, F.lit("%ROOT%/z.cmd")).when(k % 6 == 3, F.lit("$name")).when(k % 6 == 4, F.concat(F.lit("  'plain "), k.cast("string"), F.lit("' "))).otherwise(F.lit("a/$b.ps1"))
    return corpus.table(spark, sf_dir, "part").select("p_partkey", links.script_path(raw).alias("path"))


@query(r"""SELECT p_partkey, regexp_replace(p_name, '[*`\[\]]', '', 'g') || ' x' AS title, 'p_' || lower(p_brand) AS name, CASE WHEN p_partkey % 2 = 0 THEN 'a.canvas|b.CANVAS' ELSE '' END AS canvases, CASE WHEN p_partkey % 2 = 0 THEN 'folder' ELSE p_name END AS folders FROM part""")
def titles_and_links(spark, sf_dir):
    k = F.col("p_partkey")
    text = F.concat(F.lit("\n ## "), "p_name", F.lit(" *`x`*\nmore"))
    body = F.when(k % 2 == 0, F.lit("see [[a.canvas|A]], [[b.CANVAS#n1]] and [[folder]]")).otherwise(F.concat(F.lit("only [["), "p_name", F.lit("]]")))
    none = F.lit(None).cast("string")
    return corpus.table(spark, sf_dir, "part").select(
        "p_partkey", values.text_title(text).alias("title"), values.sql_name(F.concat(F.lit("\"P_["), "p_brand", F.lit("]\""))).alias("name"),
        F.array_join(links.canvas_links(F.lit("text"), none, none, body), "|").alias("canvases"), F.array_join(links.folder_links(F.lit("text"), none, body), "|").alias("folders"))


@query(r"""SELECT o_orderkey, CASE WHEN v >= 1e6 THEN printf('$%.2fM', floor(v / 1e4) / 100) WHEN v >= 1e3 THEN printf('$%.1fk', floor(v / 1e2) / 10) WHEN v >= 10 THEN printf('$%.0f', floor(v)) ELSE printf('$%.2f', floor(v * 100) / 100) END AS shown,
  strftime(make_timestamp(o_orderkey * 1000000000), '%Y-%m-%dT%H:%M:%SZ') AS stamp FROM (SELECT o_orderkey, o_totalprice * CASE o_orderkey % 4 WHEN 0 THEN 1000 WHEN 1 THEN 1 WHEN 2 THEN 0.001 ELSE 0.00001 END::DOUBLE AS v FROM orders)""")
def short_numbers(spark, sf_dir):
    k = F.col("o_orderkey")
    v = F.col("o_totalprice") * F.when(k % 4 == 0, 1000.0).when(k % 4 == 1, 1.0).when(k % 4 == 2, 0.001).otherwise(0.00001)
    # cut to the digits shown, so that engines that round ties apart agree
    v = F.when(v >= 1e6, F.floor(v / 1e4) * 1e4).when(v >= 1e3, F.floor(v / 1e2) * 1e2).when(v >= 10, F.floor(v).cast("double")).otherwise(F.floor(v * 100) / 100)
    return corpus.table(spark, sf_dir, "orders").select("o_orderkey", values.short_number(v, "$").alias("shown"), values.iso_utc(k * 1000).alias("stamp"))


@query()
def file_hashes(spark, sf_dir):
    """FNV-1a of each text, for comparison with stored hashes, and the colour of its folder."""
    return corpus.files(spark, sf_dir).select("file_id", values.fnv1a_hex("text").alias("hash"), values.folder_colour(paths.dirname(F.col("path"))).alias("colour"))


# --- file statistics -----------------------------------------------------------


LINES_SQL = r"""lines AS (SELECT file_id, path, language, text, len(text) - len(replace(text, chr(10), '')) + CASE WHEN text = '' OR ends_with(text, chr(10)) THEN 0 ELSE 1 END AS lines,
  len(list_filter(string_split(text, chr(10)), lambda x: regexp_full_match(x, '[ \t\r\f]*'))) - CASE WHEN text = '' OR ends_with(text, chr(10)) THEN 1 ELSE 0 END AS blank_lines, strlen(text)::INTEGER AS chars FROM files)"""


@query(WITH_FILES + ", " + LINES_SQL + "SELECT file_id, lines::INTEGER AS lines, blank_lines::INTEGER AS blank_lines, chars FROM lines")
def file_line_stats(spark, sf_dir):
    return filestats.line_stats(corpus.files(spark, sf_dir))


def _indented(spark, sf_dir):
    """Sentences as lines of code, indented by their length."""
    lines = F.split("text", r"[.\n]")
    made = F.array_join(F.transform(lines, lambda x, i: F.concat(F.when(i % 5 == 4, F.lit("\t")).otherwise(F.lit("")), F.repeat(F.lit(" "), F.length(x) % 9), F.trim(x))), "\n")
    return corpus.files(spark, sf_dir).withColumn("text", made)


@query(WITH_FILES + r""", made AS (SELECT file_id, generate_subscripts(l, 1) - 1 AS n, unnest(l) AS x FROM (SELECT file_id, string_split_regex(text, '[.\n]') AS l FROM files)),
  w AS (SELECT file_id, n, CASE WHEN n % 5 = 4 THEN 4 ELSE 0 END + length(x) % 9 AS w FROM made WHERE trim(x, ' ') <> ''),
  up AS (SELECT file_id, n, w, w - lag(w) OVER (PARTITION BY file_id ORDER BY n) AS up FROM w),
  c AS (SELECT file_id, up, count(*) AS c FROM up WHERE up BETWEEN 1 AND 8 GROUP BY 1, 2),
  s AS (SELECT file_id, up FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY c DESC, up) AS r FROM c) WHERE r = 1)
  SELECT f.file_id, coalesce((m.widest // s.up), 0)::INTEGER AS max_indent FROM files f LEFT JOIN (SELECT file_id, max(w) AS widest FROM w GROUP BY 1) m ON m.file_id = f.file_id LEFT JOIN s ON s.file_id = f.file_id""")
def file_max_indent(spark, sf_dir):
    return filestats.max_indent(_indented(spark, sf_dir))


@query("SELECT o_custkey AS file_id, string_agg(complexity || ':' || o_orderkey, ',' ORDER BY complexity DESC, o_orderkey) AS hot FROM (SELECT o_custkey, o_orderkey, (o_totalprice::BIGINT % 40) AS complexity, row_number() OVER (PARTITION BY o_custkey ORDER BY (o_totalprice::BIGINT % 40) DESC, o_orderkey) AS r FROM (SELECT o_custkey, o_orderkey, floor(o_totalprice) AS o_totalprice FROM orders) WHERE (o_totalprice::BIGINT % 40) >= 10) WHERE r <= 5 GROUP BY 1")
def hot_functions_topk(spark, sf_dir):
    f = corpus.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("file_id"), F.col("o_orderkey").alias("seq"), F.col("o_orderkey").alias("line"), (F.floor("o_totalprice").cast("long") % 40).alias("complexity"), F.lit("f").alias("name"))
    hot = filestats.hot_functions(f)
    return hot.select("file_id", F.array_join(F.transform("hot", lambda x: F.concat_ws(":", x["complexity"], x["line"])), ",").alias("hot"))


@query("SELECT o_orderkey, round(5.0::DOUBLE + 11.0 * least(1.0::DOUBLE, log10(greatest((o_orderkey % 9000)::DOUBLE, 1.0::DOUBLE)) / log10(5000.0::DOUBLE)), 6) AS size FROM orders")
def node_size(spark, sf_dir):
    return corpus.table(spark, sf_dir, "orders").select("o_orderkey", F.round(values.node_size(F.col("o_orderkey") % 9000), 6).alias("size"))


# --- resolution ----------------------------------------------------------------


PAGE_PATH = "'/site' || regexp_replace(regexp_extract(url, '^https?://[^/]*([^?#]*)', 1), '/$', '') || '.html'"
SITE_SQL = "WITH " + HREFS_SQL + f""", page AS (SELECT page_id, {PAGE_PATH} AS path FROM pages),
  decls AS (SELECT page_id AS file_id, 0 AS seq, path AS key FROM page UNION ALL
    SELECT 1000000000000 + page_id, 1, CASE WHEN length(raw) % 3 > 0 AND page_id % 5 = 0 THEN '/site' ELSE '/moved' END || CASE WHEN length(raw) % 2 = 0 THEN '/en' ELSE '' END || raw || CASE WHEN length(raw) % 3 = 1 THEN '.html' ELSE '/index.html' END FROM hrefs),
  symbols AS (SELECT key, max(file_id) AS file_id FROM decls GROUP BY key),
  link AS (SELECT h.page_id AS file_id, h.seq, p.path, regexp_extract(raw, '^([^?#]*)', 1) AS l FROM hrefs h JOIN page p USING (page_id)),
  probes AS (SELECT file_id, seq, d * 4 + e AS pos, base || ext AS key FROM (
    SELECT file_id, seq, 0 AS d, l AS base FROM link UNION ALL SELECT file_id, seq, 1, regexp_replace(path, '/[^/]*$', '') || l FROM link
    UNION ALL SELECT file_id, seq, 2, '/site' || l FROM link WHERE path LIKE '/site/%/%' UNION ALL SELECT file_id, seq, 3, l FROM link)
    CROSS JOIN (VALUES (0, ''), (1, '/index.html'), (2, '/index.htm'), (3, '.html')) AS x(e, ext)),
  hits AS (SELECT p.file_id, p.seq, arg_min(s.file_id, p.pos) AS target FROM probes p JOIN symbols s USING (key) GROUP BY 1, 2),
  resolved AS (SELECT l.file_id, l.seq, h.target FROM link l LEFT JOIN hits h USING (file_id, seq))"""


def _web(spark, sf_dir):
    """Declarations and references of the pages, resolved. Every link declares a name; four of five are of another site, so that some links stay open."""
    page_path = F.concat(F.lit("/site"), F.regexp_replace(F.regexp_extract("url", r"^https?://[^/]*([^?#]*)", 1), "/$", ""), F.lit(".html"))
    pages = corpus.table(spark, sf_dir, "pages").select(F.col("page_id").alias("file_id"), page_path.alias("path"))
    h = _hrefs(spark, sf_dir)
    site = F.when((F.length("raw") % 3 > 0) & (F.col("page_id") % 5 == 0), "/site").otherwise("/moved")
    named = F.concat(site, F.when(F.length("raw") % 2 == 0, "/en").otherwise(""), "raw", F.when(F.length("raw") % 3 == 1, ".html").otherwise("/index.html"))
    decls = pages.select("file_id", F.lit(0).alias("seq"), F.col("path").alias("key")).unionByName(h.select((F.col("page_id") + 1_000_000_000_000).alias("file_id"), F.lit(1).alias("seq"), named.alias("key")))
    refs = _hrefs(spark, sf_dir).withColumnRenamed("page_id", "file_id").join(pages, "file_id")
    refs = refs.select("file_id", "seq", F.lit("html").alias("language"), "path", F.lit("IMPORT_PATH").alias("kind"), links.weblink(F.col("raw")).alias("raw"))
    refs = refs.filter("raw is not null").withColumn("candidates", resolve.weblink(F.col("path"), F.col("raw"), resolve.SUFFIXES["html"]))
    return pages, decls, resolve.ordered_probe(refs, resolve.symbols(decls))


@query(SITE_SQL + "SELECT key, file_id FROM symbols")
def symbol_last_wins(spark, sf_dir):
    return resolve.symbols(_web(spark, sf_dir)[1])


@query(SITE_SQL + "SELECT file_id, seq::INTEGER AS seq, target FROM resolved")
def resolve_ordered_probe(spark, sf_dir):
    return _web(spark, sf_dir)[2].select("file_id", "seq", "target")


@query(SITE_SQL + "SELECT p.page_id AS file_id, count(r.file_id) FILTER (WHERE r.target IS NULL) AS unresolved FROM page p LEFT JOIN resolved r ON r.file_id = p.page_id GROUP BY 1")
def unresolved_counts(spark, sf_dir):
    pages, _, resolved = _web(spark, sf_dir)
    return resolve.unresolved(pages, resolved)


@query(SITE_SQL + "SELECT DISTINCT file_id AS source, target, 'import' AS kind FROM resolved WHERE target IS NOT NULL AND target <> file_id")
def edge_dedupe(spark, sf_dir):
    return resolve.edges(_web(spark, sf_dir)[2])


@query("SELECT o_custkey AS file_id, string_agg(o_orderpriority, '|' ORDER BY o_orderkey) AS imports FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1")
def import_lists(spark, sf_dir):
    kind = F.when(F.col("o_orderstatus") == "F", "TYPE_NAME").when(F.col("o_orderstatus") == "O", "IMPORT_PATH").otherwise("MODULE_REQUIRE")
    refs = corpus.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("file_id"), F.col("o_orderkey").alias("seq"), kind.alias("kind"), F.col("o_orderpriority").alias("raw"))
    return resolve.imports_of(refs).select("file_id", F.array_join("imports", "|").alias("imports"))


# --- graph ---------------------------------------------------------------------


@query(WITH_PURCHASES + "SELECT id, (SELECT count(*) FROM pairs WHERE target = id) AS fan_in, (SELECT count(*) FROM pairs WHERE source = id) AS fan_out FROM nodes")
def fan_in_out(spark, sf_dir):
    return graph.fan(corpus.purchase_nodes(spark, sf_dir), corpus.purchases(spark, sf_dir))


@query(WITH_REACH + ", n AS (SELECT v AS id, count(*) AS n FROM reach WHERE u <> v GROUP BY 1) SELECT nodes.id, coalesce(n, 0) AS blast_radius FROM nodes LEFT JOIN n ON n.id = nodes.id")
def closure_blast_radius(spark, sf_dir):
    """How many customers and suppliers each one depends on over all purchases and returns, by bits over the graph's components."""
    return graph.blast_and_cycles(corpus.purchase_nodes(spark, sf_dir), corpus.purchases(spark, sf_dir))[0]


CYCLES_SQL = ", mutual AS (SELECT a.u AS id, least(a.u, min(a.v)) AS root FROM reach a JOIN reach b ON a.u = b.v AND a.v = b.u GROUP BY a.u), sizes AS (SELECT root, count(*) AS n FROM mutual GROUP BY root HAVING count(*) > 1), cyc AS (SELECT n.id, s.root AS cycle_id, coalesce(s.n, 0) AS cycle_size FROM nodes n LEFT JOIN mutual m ON m.id = n.id LEFT JOIN sizes s ON s.root = m.root)"


@query(WITH_REACH + CYCLES_SQL + "SELECT * FROM cyc")
def scc_cycles(spark, sf_dir):
    return graph.cycles_large(corpus.purchase_nodes(spark, sf_dir), corpus.purchases(spark, sf_dir))


@query(WITH_ORDERS + CYCLES_SQL + "SELECT * FROM cyc")
def scc_cycles_large(spark, sf_dir):
    """Cycles among all orders, each before the customer's next one; cancelled steps lead back."""
    return graph.cycles_large(corpus.order_nodes(spark, sf_dir), corpus.order_edges(spark, sf_dir))


@query(WITH_ORDERS + CYCLES_SQL + "SELECT c.id, array_to_string(list_slice(list_sort(list(m.id)), 1, 4), ',') AS mates, greatest(any_value(c.cycle_size) - 5, 0) AS more FROM cyc c JOIN cyc m ON m.cycle_id = c.cycle_id AND m.id <> c.id GROUP BY c.id")
def cycle_mates(spark, sf_dir):
    c = graph.cycles_large(corpus.order_nodes(spark, sf_dir), corpus.order_edges(spark, sf_dir))
    return graph.cycle_mates(c).select("id", F.array_join(F.transform("mates", lambda x: x.cast("string")), ",").alias("mates"), "more")


@query(WITH_PURCHASES + "SELECT source, target, kind FROM edges WHERE source = 7 OR target = 7")
def neighbours(spark, sf_dir):
    return graph.neighbours(corpus.purchases(spark, sf_dir), 7)


@query(WITH_PURCHASES + "SELECT target AS id, count(*) AS uses FROM edges GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
def top_depended_on(spark, sf_dir):
    return graph.top_depended(corpus.purchases(spark, sf_dir))


@query(WITH_FILES + "SELECT language, count(*) AS n, min(file_id) AS first_id FROM files GROUP BY 1 ORDER BY 3 LIMIT 32")
def language_histogram(spark, sf_dir):
    return graph.language_histogram(corpus.files(spark, sf_dir).withColumnRenamed("file_id", "id"))


SCORES_SQL = WITH_FILES + f", commits AS ({corpus.COMMITS_SQL}), hist AS (SELECT path, count(*) AS git_commits, count(DISTINCT author) AS git_authors, max(ts) AS git_last_commit FROM commits GROUP BY 1), " + LINES_SQL + ", stats AS (SELECT l.file_id AS id, h.git_commits AS commits, (len(regexp_extract_all(text, '[.,]')))::BIGINT AS complexity, lines, l.language FROM lines l LEFT JOIN hist h ON h.path = l.path)"


def _stats(spark, sf_dir):
    """Commits, complexity (sentence and clause ends) and lines of each document."""
    f = corpus.files(spark, sf_dir)
    h = history.file_history(corpus.commits(spark, sf_dir)).select("path", F.col("git_commits").alias("commits"))
    per = f.select("file_id", "path", "language", F.regexp_count("text", F.lit("[.,]")).cast("long").alias("complexity")).join(filestats.line_stats(f), "file_id")
    return per.join(h, "path", "left").withColumnRenamed("file_id", "id")


@query(SCORES_SQL + "SELECT s.id, r.hotspot_rank FROM stats s LEFT JOIN (SELECT id, row_number() OVER (ORDER BY commits * complexity DESC, id) AS hotspot_rank FROM stats WHERE commits > 0 AND complexity > 0) r ON r.id = s.id")
def hotspot_rank(spark, sf_dir):
    return graph.hotspots(_stats(spark, sf_dir).select("id", "commits", "complexity"))


@query(SCORES_SQL + "SELECT id, complexity AS score FROM stats WHERE complexity > 0 ORDER BY 2 DESC, 1 LIMIT 3")
def top_complex(spark, sf_dir):
    return graph.top_scores(_stats(spark, sf_dir).select("id", F.col("complexity").alias("score")))


@query(WITH_FILES + ", " + LINES_SQL + "SELECT file_id AS id, round(2.4 * pow((lines - blank_lines) / 1000.0::DOUBLE, 1.05::DOUBLE) * (56286.0::DOUBLE / 12) * 2.4, 4) AS score FROM lines WHERE language NOT IN ('markdown', 'json') AND lines > blank_lines ORDER BY lines - blank_lines DESC, 1 LIMIT 3")
def top_value(spark, sf_dir):
    t = totals.code_totals(_code(spark, sf_dir), "file_id")
    return graph.top_scores(totals.estimated(t).select(F.col("file_id").alias("id"), F.round("value", 4).alias("score")))


# --- history -------------------------------------------------------------------


@query(WITH_FILES + f", commits AS ({corpus.COMMITS_SQL}) SELECT path, count(*) AS git_commits, count(DISTINCT author) AS git_authors, max(ts) AS git_last_commit FROM commits GROUP BY 1")
def git_file_stats(spark, sf_dir):
    return history.file_history(corpus.commits(spark, sf_dir))


@query(WITH_FILES + f", commits AS ({corpus.COMMITS_SQL}), h AS (SELECT path, count(*) AS c, count(DISTINCT author) AS a, max(ts) AS t FROM commits GROUP BY 1), f AS (SELECT path, path LIKE '/corpus/src1/%' OR path LIKE '/corpus/src2/en/%' AS repo FROM files) SELECT f.path, CASE WHEN repo THEN coalesce(c, 0) END AS git_commits, CASE WHEN repo THEN coalesce(a, 0) END AS git_authors, CASE WHEN repo THEN t END AS git_last_commit FROM f LEFT JOIN h ON h.path = f.path")
def git_tri_state(spark, sf_dir):
    roots = spark.createDataFrame([("/corpus/src1",), ("/corpus/src2/en",)], "root string")
    h = history.file_history(corpus.commits(spark, sf_dir))
    return history.with_history(corpus.files(spark, sf_dir).select("path"), h, roots)


# --- duplicates ----------------------------------------------------------------


def _tokens(spark, sf_dir):
    """Words of documents as tokens, eight to a row."""
    t = F.filter(F.split("text", r"[ \n]+"), lambda x: x != "")
    rows = corpus.files(spark, sf_dir).select("file_id", t.alias("toks"))
    return rows.withColumn("rows", F.transform("toks", lambda x, i: (i / 8).cast("int") + 1))


TOKENS_SQL = """WITH toks AS (SELECT doc_id AS file_id, list_filter(string_split_regex(text, '[ \\n]+'), lambda x: x <> '') AS toks FROM documents),
  wins AS (SELECT file_id, toks, unnest(range(0, len(toks) - 49)) AS pos FROM toks WHERE len(toks) >= 50),
  keyed AS (SELECT file_id, pos::INTEGER AS pos, md5(array_to_string(toks[pos + 1 : pos + 50], chr(1))) AS h FROM wins),
  ranked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY h ORDER BY file_id, pos) AS r FROM keyed) WHERE r <= 64),
  bucketed AS (SELECT file_id, pos, h FROM (SELECT *, count(*) OVER (PARTITION BY h) AS n FROM ranked) WHERE n > 1),
  cand AS (SELECT a.file_id AS fa, a.pos AS pa, b.file_id AS fb, b.pos AS pb FROM bucketed a JOIN bucketed b ON a.h = b.h AND (a.file_id < b.file_id OR (a.file_id = b.file_id AND a.pos < b.pos))),
  starts AS (SELECT c.*, x.toks AS ta, y.toks AS tb FROM cand c JOIN toks x ON x.file_id = fa JOIN toks y ON y.file_id = fb WHERE pa = 0 OR pb = 0 OR x.toks[pa] <> y.toks[pb]),
  runs AS (SELECT fa, pa, fb, pb, least(len(ta) - pa, len(tb) - pb) AS most, list_position(list_transform(range(1, least(len(ta) - pa, len(tb) - pb) + 1), lambda i: ta[pa + i] = tb[pb + i]), false) AS d FROM starts),
  found AS (SELECT fa, pa, fb, pb, (CASE WHEN fa = fb THEN least(n, pb - pa) ELSE n END)::INTEGER AS n FROM (SELECT *, CASE WHEN d IS NULL OR d = 0 THEN most ELSE d - 1 END AS n FROM runs) WHERE CASE WHEN fa = fb THEN least(n, pb - pa) ELSE n END >= 50),
  clones AS (SELECT fa AS a, (pa // 8 + 1)::INTEGER AS a_line, ((pa + n - 1) // 8 + 1)::INTEGER AS a_end, fb AS b, (pb // 8 + 1)::INTEGER AS b_line, ((pb + n - 1) // 8 + 1)::INTEGER AS b_end FROM found
    WHERE (pa + n - 1) // 8 - pa // 8 >= 4 AND (pb + n - 1) // 8 - pb // 8 >= 4 ORDER BY a, a_line, b, b_line, a_end, b_end LIMIT 20000)""".replace("\\\\", "\\")


@query(TOKENS_SQL + "SELECT file_id, count(*) AS windows, count(DISTINCT h) AS distinct_windows FROM keyed GROUP BY 1")
def token_windows(spark, sf_dir):
    return clones.windows(_tokens(spark, sf_dir)).groupBy("file_id").agg(F.count(F.lit(1)).alias("windows"), F.countDistinct("h").alias("distinct_windows"))


def _clones(spark, sf_dir):
    return clones.clones(_tokens(spark, sf_dir))


@query(TOKENS_SQL + "SELECT * FROM clones")
def clone_pairs(spark, sf_dir):
    return _clones(spark, sf_dir)


@query(TOKENS_SQL + """, side AS (SELECT a AS file_id, a_line AS line, a_end AS stop, b AS of, b_line AS ol FROM clones UNION ALL SELECT b, b_line, b_end, a, a_line FROM clones),
  m AS (SELECT *, max(stop) OVER (PARTITION BY file_id ORDER BY line, stop, of, ol ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS high FROM side),
  i AS (SELECT *, sum(CASE WHEN high IS NULL OR line > high THEN 1 ELSE 0 END) OVER (PARTITION BY file_id ORDER BY line, stop, of, ol ROWS UNBOUNDED PRECEDING) AS island FROM m)
  SELECT file_id, min(line) AS line, max(stop) AS stop, count(DISTINCT (of, ol)) AS places FROM i GROUP BY file_id, island""")
def clone_interval_merge(spark, sf_dir):
    return clones.merged_stretches(_clones(spark, sf_dir))


# --- cost ----------------------------------------------------------------------


def _code(spark, sf_dir):
    """Statistics of documents as code: comment lines are those that begin with a capital D, complexity counts commas."""
    f = corpus.files(spark, sf_dir)
    more = f.select("file_id", "path", "language", F.split("path", "/")[2].alias("grp"), F.lit(0).alias("comment_lines"), F.when(F.col("language") == "python", F.regexp_count("text", F.lit(",")) + 1).alias("complexity"))
    return more.join(filestats.line_stats(f), "file_id")


CODE_SQL = WITH_FILES + ", " + LINES_SQL + """, code AS (SELECT file_id, path, language, split_part(path, '/', 3) AS grp, CASE WHEN language IN ('markdown', 'json') THEN 0 ELSE lines - blank_lines END AS n, chars, CASE WHEN language = 'python' THEN len(regexp_extract_all(text, ',')) + 1 END AS complexity FROM lines),
  totals AS (SELECT grp, sum(n)::BIGINT AS sloc, sum(chars)::BIGINT AS chars, coalesce(sum(complexity), 0)::BIGINT AS decisions, coalesce(sum(CASE WHEN complexity IS NOT NULL THEN n END), 0)::BIGINT AS decision_sloc, count(*) AS files FROM code WHERE n > 0 GROUP BY grp),
  groups AS (SELECT g.grp, coalesce(sloc, 0) AS sloc, coalesce(chars, 0) AS chars, coalesce(decisions, 0) AS decisions, coalesce(decision_sloc, 0) AS decision_sloc, coalesce(files, 0) AS files FROM (SELECT DISTINCT grp FROM code) g LEFT JOIN totals t ON t.grp = g.grp),
  est AS (SELECT *, CASE WHEN sloc > 0 THEN 2.4::DOUBLE * pow(sloc / 1000.0::DOUBLE, 1.05::DOUBLE) ELSE 0 END AS effort, CASE WHEN sloc > 0 THEN chars / 4.0::DOUBLE ELSE 0 END AS kept,
    CASE WHEN sloc > 0 THEN 300.0::DOUBLE * CASE WHEN decision_sloc > 0 THEN least(greatest(decisions / nullif(decision_sloc, 0)::DOUBLE / 0.2::DOUBLE, 0.5::DOUBLE), 2.0::DOUBLE) ELSE 1.0::DOUBLE END * (1.0 + 0.5::DOUBLE * log10(greatest(sloc / 1000.0::DOUBLE, 1.0::DOUBLE))) ELSE 0 END AS multiplier FROM groups)"""


@query(CODE_SQL + "SELECT * FROM groups")
def code_totals(spark, sf_dir):
    return totals.code_totals(_code(spark, sf_dir), "grp")


@query(CODE_SQL + "SELECT sum(sloc)::BIGINT AS sloc, sum(chars)::BIGINT AS chars, sum(decisions)::BIGINT AS decisions, sum(decision_sloc)::BIGINT AS decision_sloc, sum(files)::BIGINT AS files FROM groups")
def totals_merge(spark, sf_dir):
    """Totals of groups merged into those of the whole."""
    return totals.merge(totals.code_totals(_code(spark, sf_dir), "grp"))


@query(CODE_SQL + "SELECT grp, sloc, round(effort, 6) AS effort_months, round(CASE WHEN sloc > 0 THEN 2.5::DOUBLE * pow(effort, 0.38::DOUBLE) ELSE 0 END, 6) AS schedule_months, round(CASE WHEN sloc > 0 THEN effort / (2.5::DOUBLE * pow(effort, 0.38::DOUBLE)) ELSE 0 END, 6) AS people, round(effort * (56286.0::DOUBLE / 12) * 2.4::DOUBLE, 4) AS cost FROM est")
def cocomo_by_group(spark, sf_dir):
    e = totals.estimated(totals.code_totals(_code(spark, sf_dir), "grp"))
    return e.select("grp", "sloc", F.round("effort_months", 6).alias("effort_months"), F.round("schedule_months", 6).alias("schedule_months"), F.round("people", 6).alias("people"), F.round("cost", 4).alias("cost"))


@query(CODE_SQL + "SELECT grp, round(kept, 6) AS tokens_kept, round(multiplier, 6) AS multiplier, round(kept * multiplier, 2) AS tokens_spent, round(kept * multiplier / 1e6::DOUBLE * 10.0::DOUBLE, 6) AS ai_cost FROM est")
def ai_cost_by_group(spark, sf_dir):
    e = totals.estimated(totals.code_totals(_code(spark, sf_dir), "grp"))
    return e.select("grp", F.round("tokens_kept", 6).alias("tokens_kept"), F.round("multiplier", 6).alias("multiplier"), F.round("tokens_spent", 2).alias("tokens_spent"), F.round("ai_cost", 6).alias("ai_cost"))


@query(CODE_SQL + "SELECT grp, round(CASE WHEN sloc > 0 THEN 3.0::DOUBLE * pow(round(sloc * 0.75::DOUBLE) / 1000.0::DOUBLE, 1.12::DOUBLE) * (56286.0::DOUBLE / 12) * 2.4::DOUBLE ELSE 0 END + 0.25::DOUBLE * kept * multiplier / 1e6::DOUBLE * 10.0::DOUBLE, 4) AS value FROM est")
def value_by_group(spark, sf_dir):
    e = totals.estimated(totals.code_totals(_code(spark, sf_dir), "grp"), CostParams(mode="semi-detached", ai_share=0.25))
    return e.select("grp", F.round("value", 4).alias("value"))


@query(CODE_SQL + "SELECT coalesce(sum(n), 0)::BIGINT AS sloc, count(*) AS files FROM code WHERE n > 0 AND file_id % 10 = 3")
def selection_cost(spark, sf_dir):
    """Totals of a selected set of files."""
    chosen = corpus.files(spark, sf_dir).filter("file_id % 10 = 3").select("path")
    return totals.selected(_code(spark, sf_dir), chosen).select("sloc", "files")


@query("SELECT 1 AS n, sum(sloc)::BIGINT AS sloc, sum(files)::BIGINT AS files FROM (SELECT 0 AS sloc, 0 AS files WHERE false) HAVING false UNION ALL SELECT * FROM (" + CODE_SQL + """, start AS (SELECT range AS start FROM range(0, 5)),
  below AS (SELECT start, start + 5 * k AS g FROM start CROSS JOIN range(0, 4) t(k))
  SELECT b.start::INTEGER AS n, sum(c.n)::BIGINT AS sloc, count(*) AS files FROM below b JOIN code c ON c.grp = 'src' || b.g WHERE c.n > 0 GROUP BY 1)""")
def rollup_once_per_file(spark, sf_dir):
    """Diagram i links to i + 5, that to i + 10 and i + 15 and back; each stands for a source's folder, those from 5 on also for a folder inside it."""
    c = lambda k: F.concat(F.lit("/maps/"), k.cast("string"), F.lit(".canvas"))
    i = spark.range(5)
    ways = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ((0, 5), (5, 10), (5, 15), (5, 0))])).alias("w")
    step = i.select("id", ways).select(c(F.col("id") + F.col("w.a")).alias("canvas"), c(F.col("id") + F.col("w.b")).alias("target"))
    k = spark.range(20)
    folders = k.select(c(F.col("id")).alias("canvas"), F.concat(F.lit("/corpus/src"), F.col("id").cast("string")).alias("folder"))
    folders = folders.unionByName(k.filter("id >= 5").select(c(F.col("id")).alias("canvas"), F.concat(F.lit("/corpus/src"), F.col("id").cast("string"), F.lit("/en")).alias("folder")))
    starts = i.select(F.col("id").cast("int").alias("start"), c(F.col("id")).alias("canvas"))
    out = canvas.rollup(starts, step, folders, _code(spark, sf_dir))
    return out.filter("files > 0").select(F.col("start").alias("n"), "sloc", "files")


# --- diagrams --------------------------------------------------------------------


def _search_sql(words: str, limit: str) -> str:
    body = "CASE type WHEN 'text' THEN '# ' || p_name || chr(10) || p_type WHEN 'file' THEN NULL ELSE p_name END"
    return WITH_BOXES + f"SELECT canvas, ord, id FROM boxes WHERE contains(lower({body}), '{words}') ORDER BY canvas, ord {limit}"


def _noted(spark, sf_dir):
    """The boxes with words in fields that don't belong to their type, which search must not see."""
    return corpus.boxes(spark, sf_dir).withColumns({"url": F.lit("blue bolt"), "label": F.coalesce("label", F.lit("blue bolt large"))})


@query(_search_sql("blue bolt", "LIMIT 200"))
def text_search(spark, sf_dir):
    """Boxes of all types; those of files are weak links here."""
    return canvas.search(canvas.entries(_noted(spark, sf_dir)), "Blue BOLT").select("canvas", "ord", "id")


@query(_search_sql("large", ""))
def text_search_indexed(spark, sf_dir):
    """The same by way of trigram postings, without a limit."""
    import uuid

    from .session import shared_dir

    index = canvas.SearchIndex.build(canvas.entries(_noted(spark, sf_dir)), f"{shared_dir(spark)}/search-{uuid.uuid4().hex}", 8)
    return index.search("LARGE", None).select("canvas", "ord", "id")


@query(WITH_BOXES + "SELECT b.canvas, b.id, (SELECT g.id FROM boxes g WHERE g.canvas = b.canvas AND g.type = 'group' AND b.x + b.w / 2 BETWEEN g.x AND g.x + g.w AND b.y + b.h / 2 BETWEEN g.y AND g.y + g.h ORDER BY g.w * g.h, g.ord LIMIT 1) AS group_id FROM boxes b WHERE b.type <> 'group'")
def containing_group(spark, sf_dir):
    return canvas.containing_group(corpus.boxes(spark, sf_dir))


@query(WITH_BOXES + "SELECT a.canvas, a.id AS a, b.id AS b FROM boxes a JOIN boxes b ON a.canvas = b.canvas AND a.ord < b.ord WHERE a.type <> 'group' AND b.type <> 'group' AND a.x < b.x + b.w AND b.x < a.x + a.w AND a.y < b.y + b.h AND b.y < a.y + a.h")
def box_overlap(spark, sf_dir):
    return canvas.overlaps(corpus.boxes(spark, sf_dir))


@query(WITH_BOXES + "SELECT b.canvas, b.id, g.id AS group_id FROM boxes b JOIN boxes g ON b.canvas = g.canvas AND g.type = 'group' WHERE b.type <> 'group' AND b.x < g.x + g.w AND g.x < b.x + b.w AND b.y < g.y + g.h AND g.y < b.y + b.h AND NOT (b.x >= g.x AND b.y >= g.y AND b.x + b.w <= g.x + g.w AND b.y + b.h <= g.y + g.h)")
def box_straddle(spark, sf_dir):
    return canvas.straddles(corpus.boxes(spark, sf_dir))


TITLES_SQL = WITH_BOXES + ", titled AS (SELECT canvas, id, ord, type, CASE type WHEN 'text' THEN p_name WHEN 'group' THEN p_name ELSE 'Brand_' || (ord * 7) % 5 + 1 || '.canvas' END AS title FROM boxes)"


@query(TITLES_SQL + "SELECT l.canvas, l.ord, a.title AS from_title, CASE WHEN from_end = 'arrow' AND to_end IS NULL THEN '<->' WHEN to_end IS NULL THEN '->' WHEN from_end = 'arrow' THEN '<-' ELSE '--' END AS arrow, b.title AS to_title, coalesce(l.label, '') AS label FROM links l JOIN titled a ON a.canvas = l.canvas AND a.id = l.from_node JOIN titled b ON b.canvas = l.canvas AND b.id = l.to_node")
def connections(spark, sf_dir):
    return canvas.connections(corpus.boxes(spark, sf_dir), corpus.box_edges(spark, sf_dir))


@query(WITH_BOXES + "SELECT l.canvas, l.id, l.to_node AS missing FROM links l WHERE NOT EXISTS (SELECT 1 FROM boxes b WHERE b.canvas = l.canvas AND b.id = l.to_node)")
def dangling_edges(spark, sf_dir):
    return canvas.dangling(corpus.boxes(spark, sf_dir), corpus.box_edges(spark, sf_dir))


@query(TITLES_SQL + ", weak AS (SELECT canvas, id, '/maps/Brand_' || (ord * 7) % 5 + 1 || '.canvas' AS target_canvas, 'n' || ord + 1 AS target_id FROM boxes WHERE type = 'file') SELECT w.canvas, w.id, w.target_canvas, w.target_id, t.title FROM weak w LEFT JOIN titled t ON t.canvas = w.target_canvas AND t.id = w.target_id".replace("|| (ord * 7) % 5 + 1 ||", "|| ((ord * 7) % 5 + 1) ||").replace("'n' || ord + 1", "'n' || (ord + 1)"))
def weak_link_targets(spark, sf_dir):
    return canvas.weak_targets(corpus.boxes(spark, sf_dir))


@query(WITH_BOXES + ", gone AS (SELECT canvas, id FROM boxes WHERE ord % 4 = 1) SELECT l.canvas, l.id FROM links l WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.canvas = l.canvas AND g.id IN (l.from_node, l.to_node))")
def remove_nodes(spark, sf_dir):
    b = corpus.boxes(spark, sf_dir)
    return canvas.without_nodes(b, corpus.box_edges(spark, sf_dir), b.filter("ord % 4 = 1").select("canvas", "id"))[1].select("canvas", "id")


def _tree(spark, sf_dir):
    """Customers as diagrams: k links to 2k + 1, 2k + 2 and k / 3; every fortieth has another name than its links say, so that some can't be reached."""
    c = corpus.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")).filter("k is not null")
    c = c.select("k", F.concat(F.when(F.col("k") % 40 == 39, "moved").otherwise("c"), F.col("k").cast("string")).alias("canvas"))
    step = c.select("canvas", F.explode(F.array(2 * F.col("k") + 1, 2 * F.col("k") + 2, F.floor(F.col("k") / 3))).alias("t")).select("canvas", F.concat(F.lit("c"), F.col("t").cast("string")).alias("target"))
    return c.select("canvas"), step


def _index(spark, sf_dir):
    """The diagrams, and the index of those below c1; the root is in it even without a customer of that key."""
    every, step = _tree(spark, sf_dir)
    return every, canvas.reachable(spark.range(1).select(F.lit("c1").alias("canvas")), step, every)


TREE_SQL = """WITH RECURSIVE c AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 40 = 39 THEN 'moved' ELSE 'c' END || c_custkey AS canvas FROM customer),
  step AS (SELECT DISTINCT canvas, 'c' || t AS target FROM (SELECT canvas, unnest([2 * k + 1, 2 * k + 2, k // 3]) AS t FROM c) WHERE 'c' || t IN (SELECT canvas FROM c)),
  walk AS (SELECT 'c1' AS canvas, NULL::VARCHAR AS parent, 0 AS level UNION SELECT s.target, s.canvas, w.level + 1 FROM walk w JOIN step s ON s.canvas = w.canvas WHERE w.level < 14),
  best AS (SELECT canvas, parent, level FROM (SELECT *, row_number() OVER (PARTITION BY canvas ORDER BY level, parent) AS r FROM walk) WHERE r = 1)"""


@query(TREE_SQL + "SELECT * FROM best")
def canvas_index(spark, sf_dir):
    return _index(spark, sf_dir)[1]


@query(TREE_SQL + ", trails AS (SELECT canvas, canvas AS trail FROM best WHERE parent IS NULL UNION ALL SELECT b.canvas, t.trail || ' > ' || b.canvas FROM best b JOIN trails t ON b.parent = t.canvas) SELECT * FROM trails")
def breadcrumbs(spark, sf_dir):
    return canvas.breadcrumbs(_index(spark, sf_dir)[1])


@query(TREE_SQL + "SELECT canvas FROM c WHERE canvas NOT IN (SELECT canvas FROM best)")
def unreachable(spark, sf_dir):
    every, index = _index(spark, sf_dir)
    return every.join(index, "canvas", "left_anti")


@query(WITH_BOXES + ", g AS (SELECT *, CASE WHEN y - lag(y) OVER (PARTITION BY canvas ORDER BY y, x, ord) > 40 THEN 1 ELSE 0 END AS new FROM boxes), r AS (SELECT *, sum(new) OVER (PARTITION BY canvas ORDER BY y, x, ord ROWS UNBOUNDED PRECEDING) AS row FROM g) SELECT canvas, id, row_number() OVER (PARTITION BY canvas ORDER BY row, x, y, ord) AS place FROM r")
def reading_order(spark, sf_dir):
    return canvas.reading_order(corpus.boxes(spark, sf_dir))


@query(ORACLES["weak_link_targets"].rsplit("SELECT w.canvas", 1)[0] + """, found AS (
    SELECT 'error' AS severity, 'edge to a missing node' AS message, count(*) AS n FROM links l WHERE NOT EXISTS (SELECT 1 FROM boxes b WHERE b.canvas = l.canvas AND b.id = l.to_node)
    UNION ALL SELECT 'error', 'weak link to a missing node', count(*) FROM weak w LEFT JOIN titled t ON t.canvas = w.target_canvas AND t.id = w.target_id WHERE t.title IS NULL
    UNION ALL SELECT 'warning', 'overlaps another box', count(*) FROM boxes a JOIN boxes b ON a.canvas = b.canvas AND a.ord < b.ord WHERE a.type <> 'group' AND b.type <> 'group' AND a.x < b.x + b.w AND b.x < a.x + a.w AND a.y < b.y + b.h AND b.y < a.y + a.h
    UNION ALL SELECT 'warning', 'crosses a group''s edge', count(*) FROM boxes b JOIN boxes g ON b.canvas = g.canvas AND g.type = 'group' WHERE b.type <> 'group' AND b.x < g.x + g.w AND g.x < b.x + b.w AND b.y < g.y + g.h AND g.y < b.y + b.h AND NOT (b.x >= g.x AND b.y >= g.y AND b.x + b.w <= g.x + g.w AND b.y + b.h <= g.y + g.h)
    UNION ALL SELECT 'warning', 'a connection without a label', count(*) FROM links WHERE label IS NULL
    UNION ALL SELECT 'error', 'not reachable from the root', count(DISTINCT canvas) FROM boxes WHERE canvas <> '/maps/Brand_1.canvas')
  SELECT * FROM found WHERE n > 0""")
def validation_issues(spark, sf_dir):
    """All checks over the diagrams, counted."""
    return canvas.validate(corpus.boxes(spark, sf_dir), corpus.box_edges(spark, sf_dir), "/maps/Brand_1.canvas").groupBy("severity", "message").agg(F.count(F.lit(1)).alias("n"))


# --- notes -----------------------------------------------------------------------


def _notes(spark, sf_dir):
    """Customers as notes: a file note, or one about the customers of the next keys."""
    k = F.col("c_custkey")
    p = lambda x: F.concat(F.lit("/f"), (x % 50).cast("string"))
    return corpus.table(spark, sf_dir, "customer").select(F.concat(F.lit("n"), k.cast("string")).alias("id"), F.when(k % 3 > 0, p(k)).alias("path"), F.when(k % 3 == 0, F.array(p(k + 2), p(k + 1), p(k + 7))).alias("group_paths"))


NOTES_SQL = "WITH notes AS (SELECT 'n' || c_custkey AS id, CASE WHEN c_custkey % 3 > 0 THEN '/f' || c_custkey % 50 END AS path, CASE WHEN c_custkey % 3 = 0 THEN ['/f' || (c_custkey + 2) % 50, '/f' || (c_custkey + 1) % 50, '/f' || (c_custkey + 7) % 50] END AS g FROM customer)"


@query(NOTES_SQL + "SELECT id FROM notes WHERE path = '/f7' OR list_contains(g, '/f7')")
def notes_for_path(spark, sf_dir):
    return notes.for_path(_notes(spark, sf_dir), "/f7").select("id")


@query(NOTES_SQL + "SELECT id FROM notes WHERE len(list_distinct(g)) = 3 AND list_has_all(g, ['/f10', '/f4', '/f5'])")
def notes_exact_group(spark, sf_dir):
    return notes.for_exact_group(_notes(spark, sf_dir), ["/f4", "/f10", "/f5"]).select("id")


@query(WITH_FILES + "SELECT path, md5(text || 'x') AS hash, md5(text) AS current FROM files WHERE file_id % 3 = 0")
def stale_overlay(spark, sf_dir):
    """All files have a stored hash; every third one's is of another text."""
    f = corpus.files(spark, sf_dir)
    now = f.select("path", F.md5(F.col("text").cast("binary")).alias("hash"))
    kept = f.select("path", F.md5(F.concat("text", F.when(F.col("file_id") % 3 == 0, "x").otherwise("")).cast("binary")).alias("hash"))
    return notes.stale(kept, now)


@query("SELECT '/f' || c_custkey AS path, c_acctbal + CASE WHEN c_custkey % 4 = 0 THEN 1000 ELSE 0 END AS x FROM customer")
def overlay_upsert(spark, sf_dir):
    c = corpus.table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("/f"), F.col("c_custkey").cast("string")).alias("path"), F.col("c_acctbal").alias("x"))
    old = c.filter("c_custkey % 8 <> 0").select("path", "x")
    return notes.upsert_positions(old, c.filter("c_custkey % 4 = 0").select("path", (F.col("x") + 1000).alias("x")))


# --- scanned sources, whole documents -----------------------------------------------


@query(WITH_FILES + "SELECT path, language, strlen(text) AS n_bytes, md5(text) AS digest FROM files WHERE language <> 'json'")
def tree_source_read(spark, sf_dir):
    """All documents as a tree of files, listed and read by the tree source, with conditions on languages in the listing."""
    import os
    import uuid

    from .session import shared_dir
    from .sources import trees

    top = f"{shared_dir(spark).removeprefix('file://')}/tree-{uuid.uuid4().hex}"

    def write(batches):
        for b in batches:
            for path, text in zip(b["path"], b["text"], strict=True):
                os.makedirs(os.path.dirname(top + path), exist_ok=True)
                with open(top + path, "w", encoding="utf-8", newline="") as f:
                    f.write(text)
            yield b[["path"]]

    corpus.files(spark, sf_dir).select("path", "text").mapInPandas(write, "path string").write.format("noop").mode("overwrite").save()
    rows = trees.read(spark, [top]).filter(F.col("language").isin("python", "go", "markdown"))
    return rows.select(F.substring("path", F.lit(len(top) + 1), F.length("path")).alias("path"), "language", "n_bytes", F.md5(F.col("text").cast("binary")).alias("digest"))


@query()
def scanned_statistics(spark, sf_dir):
    """Statistics by the scanners of documents taken as sources of their language."""
    from .scan import facts

    return facts.stats_of(facts.scan_files(corpus.files(spark, sf_dir), False)).drop("hot", "hash", "error")


@query("WITH " + HREFS_SQL + "SELECT page_id AS file_id, (row_number() OVER (PARTITION BY page_id ORDER BY seq) - 1)::INTEGER AS seq, raw FROM hrefs WHERE regexp_extract(raw, '^([^?#]*)', 1) <> ''")
def html_scanned_refs(spark, sf_dir):
    """Links of pages by the HTML scanner."""
    from .scan import facts

    p = corpus.table(spark, sf_dir, "pages").select(F.col("page_id").alias("file_id"), F.concat(F.lit("/site/"), F.col("page_id").cast("string"), F.lit(".html")).alias("path"), F.lit("html").alias("language"), F.col("html").alias("text"))
    return facts.refs_of(facts.scan_files(p, False)).select("file_id", "seq", "raw")


@query("WITH " + HREFS_SQL + """, links AS (SELECT page_id, seq, regexp_extract(raw, '^([^?#]*)', 1) AS link FROM hrefs WHERE regexp_extract(raw, '^([^?#]*)', 1) <> ''),
  targets AS (SELECT link, 1000000000000 + min(page_id * 1000 + seq) AS file_id FROM links WHERE length(link) % 2 = 0 GROUP BY link)
  SELECT DISTINCT page_id AS source, file_id AS target, 'import' AS kind FROM links JOIN targets USING (link)""")
def sql_edges(spark, sf_dir):
    """From pages to edges in SQL alone, by views over table functions; links of even length lead to a page that is there."""
    from . import sql

    p = corpus.table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("/site/pages/"), F.col("page_id").cast("string"), F.lit(".html")).alias("path"), "html")
    h = _hrefs(spark, sf_dir).withColumn("link", F.regexp_extract("raw", "^([^?#]*)", 1)).filter("link <> '' and length(link) % 2 = 0")
    there = h.groupBy("link").agg((F.min(F.col("page_id") * 1000 + F.col("seq")) + 1_000_000_000_000).alias("file_id"))
    files = p.select(F.col("page_id").alias("file_id"), "path", F.lit("html").alias("language"), F.col("html").alias("text"))
    files = files.unionByName(there.select("file_id", F.concat(F.lit("/site"), "link", F.lit("/index.html")).alias("path"), F.lit("html").alias("language"), F.lit("").alias("text")))
    sql.views(spark, files, "page_")
    return spark.sql("SELECT source, target, kind FROM page_edges")


@query(WITH_PURCHASES + ", placed AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS at FROM nodes) SELECT '/n/' || a.id AS path, '/n/' || b.id AS uses, kind FROM edges JOIN placed a ON a.id = source JOIN placed b ON b.id = target UNION ALL SELECT '/n/' || id, NULL, NULL FROM nodes")
def graph_json_export(spark, sf_dir):
    """All purchases as one JSON document, written in parts and read back: a row for each link, and one for each node."""
    import uuid

    from .session import shared_dir
    from .sources import graphjson

    placed = sources.with_ids(corpus.purchase_nodes(spark, sf_dir), "at", "id")
    edges = corpus.purchases(spark, sf_dir)
    for end in ("source", "target"):
        edges = edges.join(placed.select(F.col("id").alias(end), F.col("at").alias(end + "_at")), end)
    nodes = placed.select(F.col("at").alias("id"), F.concat(F.lit("/n/"), F.col("id").cast("string")).alias("path"), F.lit("sql").alias("language"))
    at = f"{shared_dir(spark)}/graph-{uuid.uuid4().hex}"
    graphjson.write_graph(at, nodes, edges.select(F.col("source_at").alias("source"), F.col("target_at").alias("target"), "kind"))
    n, e, _ = graphjson.read_graph(spark, at)
    back = e.join(n.select(F.col("id").alias("source"), "path"), "source").join(n.select(F.col("id").alias("target"), F.col("path").alias("uses")), "target")
    none = F.lit(None).cast("string")
    return back.select("path", "uses", "kind").unionByName(n.select("path", none.alias("uses"), none.alias("kind")))


@query()
def layout_positions(spark, sf_dir):
    """Places of the trade graph's nodes."""
    from .operators import layout

    nodes = corpus.table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.concat(F.lit("/n/r"), F.col("n_regionkey").cast("string"), F.lit("/"), "n_name").alias("path"))
    return layout.layout(nodes, corpus.trade_edges(spark, sf_dir))


@query(WITH_FILES + f", commits AS ({corpus.COMMITS_SQL}) SELECT path, count(*) AS git_commits, count(DISTINCT author) AS git_authors, max(ts) AS git_last_commit FROM commits GROUP BY 1")
def commit_stream_history(spark, sf_dir):
    """History from the commit feed read as a stream."""
    import uuid

    from .session import shared_dir
    from .streaming import commits as feed

    at = f"{shared_dir(spark)}/feed-{uuid.uuid4().hex}"
    corpus.commits(spark, sf_dir).write.parquet(f"{at}/in")
    stream = spark.readStream.schema("path string, author long, ts long").parquet(f"{at}/in").withColumn("author", F.col("author").cast("string"))
    feed.append_history(stream, f"{at}/out", f"{at}/state").awaitTermination()
    return feed.history_of(spark, f"{at}/out")


@query(WITH_FILES + f", commits AS ({corpus.COMMITS_SQL}) SELECT path, count(*) AS git_commits, count(DISTINCT author) AS git_authors, max(ts) AS git_last_commit FROM commits GROUP BY 1")
def commit_state_history(spark, sf_dir):
    """History by path and author from the commit feed, which comes in two parts: the second one changes the rows it touches."""
    import uuid

    from .session import shared_dir
    from .streaming import commits as feed

    at = f"{shared_dir(spark)}/feed-{uuid.uuid4().hex}"
    rows = corpus.commits(spark, sf_dir).withColumn("author", F.col("author").cast("string"))
    for part in (0, 1):
        rows.filter(F.pmod("ts", F.lit(2)) == part).write.parquet(f"{at}/in/{part}")
        stream = spark.readStream.schema("path string, author string, ts long").option("recursiveFileLookup", True).parquet(f"{at}/in")
        feed.keep_history(stream, f"{at}/out", f"{at}/state").awaitTermination()
    return feed.kept_history(spark, f"{at}/out")


@query("SELECT n_nationkey::BIGINT AS id, sqrt((n_nationkey % 7) * (n_nationkey % 7) + (n_nationkey % 5) * (n_nationkey % 5) + 1.0::DOUBLE) AS r FROM nation ORDER BY 2 DESC, 1 LIMIT 1")
def bounding_radius(spark, sf_dir):
    """The farthest node and its distance from the origin."""
    from .operators import layout

    k = F.col("n_nationkey")
    p = corpus.table(spark, sf_dir, "nation").select(k.cast("long").alias("id"), (k % 7).cast("double").alias("x"), (k % 5).cast("double").alias("y"), F.lit(1.0).alias("z"))
    far = p.join(F.broadcast(layout.bounding_radius(p)), F.abs(F.sqrt(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2) - F.col("radius")) < 1e-9)
    return far.orderBy("id").limit(1).select("id", F.col("radius").alias("r"))


@query("SELECT p_partkey AS id FROM part WHERE (p_size - 25) * (p_size - 25) + (p_partkey % 100 - 50) * (p_partkey % 100 - 50) <= 25 ORDER BY (p_size - 25) * (p_size - 25) + (p_partkey % 100 - 50) * (p_partkey % 100 - 50), 1 LIMIT 1")
def nearest_point(spark, sf_dir):
    from .operators import layout

    p = corpus.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("x"), (F.col("p_partkey") % 100).cast("double").alias("y"))
    return layout.nearest(p, 25.0, 50.0, 5.0)
