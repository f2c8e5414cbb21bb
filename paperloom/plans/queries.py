"""The operators applied to the driver's tables. ``QUERIES`` and ``ORACLES`` share their keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import functions as fn
from ..functions import office
from ..operators import islands as isl
from ..operators import charts, lists, lookups, parts, ranks, styles
from ..query import jq
from ..tables import dealt, parted, split, spread

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(rows) if name in ("documents", "pages") else rows  # few rows with much text


# Blocks of documents ------------------------------------------------------------------------


def lines_of(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, line, text): lines trimmed of spaces, empty ones left out; ``line`` counts from 0 on all."""
    lines = docs.select("doc_id", "lang", F.posexplode(F.split("text", "\n", -1)).alias("line", "raw"))
    return lines.select("doc_id", "lang", F.col("line").cast("long").alias("line"), F.btrim("raw", F.lit(" \t\r")).alias("text")).where("text <> ''")


def block_kind(text):
    return (
        F.when(text.rlike("^#{1,6} "), "heading").when(text.rlike("^([-*+]|[0-9]{1,9}[.)]) "), "list_item").when(text.contains(" | "), "table").otherwise("paragraph")
    )


LINES = """lines AS (
  SELECT doc_id, lang, CAST(i - 1 AS BIGINT) AS line, trim(parts[i], chr(32) || chr(9) || chr(13)) AS text
  FROM (SELECT doc_id, lang, string_split(text, chr(10)) AS parts, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)
  WHERE trim(parts[i], chr(32) || chr(9) || chr(13)) <> '')"""
KIND = """CASE WHEN regexp_matches(text, '^#{1,6} ') THEN 'heading' WHEN regexp_matches(text, '^([-*+]|[0-9]{1,9}[.)]) ') THEN 'list_item'
  WHEN contains(text, ' | ') THEN 'table' ELSE 'paragraph' END"""


@query(f"WITH {LINES} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line) - 1 AS ord, text FROM lines")
def text_blocks(spark, sf_dir):
    rows = lines_of(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", (F.row_number().over(W.partitionBy("doc_id").orderBy("line")) - 1).cast("long").alias("ord"), "text")


@query(f"WITH {LINES} SELECT lang, {KIND} AS kind, count(*) AS n_blocks, count(DISTINCT doc_id) AS n_docs FROM lines GROUP BY ALL")
def block_view(spark, sf_dir):
    rows = lines_of(table(spark, sf_dir, "documents")).withColumn("kind", block_kind(F.col("text")))
    return rows.groupBy("lang", "kind").agg(F.count("*").alias("n_blocks"), F.count_distinct("doc_id").alias("n_docs"))


@query(
    f"WITH {LINES}, k AS (SELECT doc_id, {KIND} AS kind FROM lines) SELECT doc_id, count(*) AS blocks, count(*) FILTER (kind = 'heading') AS headings, "
    "count(*) FILTER (kind = 'list_item') AS list_items, count(*) FILTER (kind = 'table') AS tables, count(*) FILTER (kind = 'paragraph') AS paragraphs FROM k GROUP BY doc_id"
)
def block_counts(spark, sf_dir):
    rows = lines_of(table(spark, sf_dir, "documents")).withColumn("kind", block_kind(F.col("text")))
    each = [F.count_if(F.col("kind") == k).alias(n) for k, n in (("heading", "headings"), ("list_item", "list_items"), ("table", "tables"), ("paragraph", "paragraphs"))]
    return rows.groupBy("doc_id").agg(F.count("*").alias("blocks"), *each)


@query(
    f"WITH {LINES}, k AS (SELECT doc_id, {KIND} AS kind, text, row_number() OVER (PARTITION BY doc_id ORDER BY line) - 1 AS ord FROM lines) "
    "SELECT doc_id, md5(string_agg(kind || ':' || text, chr(10) ORDER BY ord)) AS digest, count(*) AS n_blocks FROM k GROUP BY doc_id"
)
def blocks_json(spark, sf_dir):
    """The block view as an array of structs a document, digested: (kind, text) in order."""
    rows = lines_of(table(spark, sf_dir, "documents")).withColumn("kind", block_kind(F.col("text")))
    blocks = rows.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("line", "kind", "text"))).alias("b"))
    joined = F.array_join(F.transform("b", lambda x: F.concat(x["kind"], F.lit(":"), x["text"])), "\n")
    return blocks.select("doc_id", F.md5(joined).alias("digest"), F.size("b").cast("long").alias("n_blocks"))


@query(f"WITH {LINES} SELECT doc_id, line, text FROM lines WHERE contains(lower(text), 'with')")
def search(spark, sf_dir):
    return parts.search(lines_of(table(spark, sf_dir, "documents")), "text", "with").select("doc_id", "line", "text")


WORD_RE = r"[\p{L}\p{N}_]+"
COUNTS = """SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}_]+')) AS word FROM documents) GROUP BY ALL"""


@query(COUNTS.format("text"))
def word_counts(spark, sf_dir):
    return lookups.word_counts(table(spark, sf_dir, "documents"), ["doc_id"], "text")


RECALL = f"""WITH r AS ({COUNTS.format("text")}), c AS ({COUNTS.format("substr(text, 1, CAST(length(text) // 2 AS INT))")}),
 h AS (SELECT r.doc_id, CAST(sum(least(r.n, coalesce(c.n, 0))) AS BIGINT) AS hits, CAST(sum(r.n) AS BIGINT) AS total FROM r LEFT JOIN c USING (doc_id, word) GROUP BY r.doc_id)"""


def _recall(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    half = docs.select("doc_id", F.substring(F.col("text"), F.lit(1), F.floor(F.length("text") / 2).cast("int")).alias("text"))
    return lookups.word_recall(lookups.word_counts(half, ["doc_id"], "text"), lookups.word_counts(docs, ["doc_id"], "text"), ["doc_id"])


@query(RECALL + " SELECT doc_id, hits, total, round(hits / total, 9) AS recall FROM h")
def word_recall(spark, sf_dir):
    return _recall(spark, sf_dir).withColumn("recall", F.round("recall", 9))


@query(RECALL + " SELECT lang, round(sum(hits) / sum(total), 9) AS weighted, round(avg(hits / total), 9) AS mean, count(*) AS n_docs FROM h JOIN documents USING (doc_id) GROUP BY lang")
def recall_weighted(spark, sf_dir):
    rows = _recall(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    return rows.groupBy("lang").agg(F.round(F.sum("hits") / F.sum("total"), 9).alias("weighted"), F.round(F.avg("recall"), 9).alias("mean"), F.count("*").alias("n_docs"))


# Labels and lists ---------------------------------------------------------------------------

ROMAN = (
    "CASE WHEN n = 0 THEN '0' ELSE repeat('M', CAST(n // 1000 AS INT)) || ['','C','CC','CCC','CD','D','DC','DCC','DCCC','CM'][CAST(n // 100 % 10 + 1 AS INT)] || "
    "['','X','XX','XXX','XL','L','LX','LXX','LXXX','XC'][CAST(n // 10 % 10 + 1 AS INT)] || ['','I','II','III','IV','V','VI','VII','VIII','IX'][CAST(n % 10 + 1 AS INT)] END"
)
LETTERS = "CASE WHEN n <= 0 THEN '' ELSE repeat(chr(CAST(65 + (n - 1) % 26 AS INT)), CAST((n - 1) // 26 + 1 AS INT)) END"
ORDINAL = "n || CASE WHEN n % 100 BETWEEN 11 AND 13 THEN 'th' WHEN n % 10 = 1 THEN 'st' WHEN n % 10 = 2 THEN 'nd' WHEN n % 10 = 3 THEN 'rd' ELSE 'th' END"


@query(
    f"WITH d AS (SELECT DISTINCT o_orderkey % 4000 AS n FROM orders) SELECT n, CAST(n AS VARCHAR) AS dec, CASE WHEN n < 10 THEN '0' || n ELSE '' || n END AS dec_zero, "
    f"{ROMAN} AS upper_rom, lower({ROMAN}) AS lower_rom, {LETTERS} AS upper_let, lower({LETTERS}) AS lower_let, {ORDINAL} AS ord FROM d"
)
def number_labels(spark, sf_dir):
    n = table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 4000).alias("n")).distinct()
    names = {"dec": "decimal", "dec_zero": "decimal_zero", "upper_rom": "upper_roman", "lower_rom": "lower_roman", "upper_let": "upper_letter", "lower_let": "lower_letter", "ord": "ordinal"}
    return n.select("n", *(fn.number_label(F.lit(f), F.col("n")).alias(c) for c, f in names.items()))


ITEMS = """i AS (SELECT l_orderkey AS list_id, l_partkey * 1000000 + l_suppkey * 100 + l_linenumber AS ord, l_linenumber % 3 AS lvl FROM lineitem),
 r AS (SELECT *, sum(CAST(lvl < 1 AS INT)) OVER o AS r1, sum(CAST(lvl < 2 AS INT)) OVER o AS r2, sum(CAST(lvl = 0 AS INT)) OVER o AS s0 FROM i WINDOW o AS (PARTITION BY list_id ORDER BY ord ROWS UNBOUNDED PRECEDING)),
 s AS (SELECT *, sum(CAST(lvl = 1 AS INT)) OVER (PARTITION BY list_id, r1 ORDER BY ord ROWS UNBOUNDED PRECEDING) AS s1,
  sum(CAST(lvl = 2 AS INT)) OVER (PARTITION BY list_id, r2 ORDER BY ord ROWS UNBOUNDED PRECEDING) AS s2 FROM r),
 c AS (SELECT list_id, ord, CAST(lvl AS BIGINT) AS lvl, CAST(greatest(s0, 1) AS BIGINT) AS c0, CAST(CASE WHEN lvl >= 1 THEN greatest(s1, 1) END AS BIGINT) AS c1, CAST(CASE WHEN lvl >= 2 THEN greatest(s2, 1) END AS BIGINT) AS c2 FROM s)"""


def _items(spark, sf_dir):
    key = (F.col("l_partkey") * 1000000 + F.col("l_suppkey") * 100 + F.col("l_linenumber")).alias("ord")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("list_id"), key, (F.col("l_linenumber") % 3).cast("long").alias("lvl"))
    return parted(rows, "list_id")


@query(
    f"WITH {ITEMS} SELECT list_id, ord, lvl, c0, c1, c2, CASE lvl WHEN 0 THEN c0 || '.' "
    "WHEN 1 THEN c0 || '.' || lower(repeat(chr(CAST(65 + (c1 - 1) % 26 AS INT)), CAST((c1 - 1) // 26 + 1 AS INT))) || ')' "
    "ELSE '(' || lower(['','X','XX','XXX','XL'][CAST(c2 // 10 % 10 + 1 AS INT)] || ['','I','II','III','IV','V','VI','VII','VIII','IX'][CAST(c2 % 10 + 1 AS INT)]) || ')' END AS label FROM c"
)
def list_labels(spark, sf_dir):
    counted = lists.list_counters(_items(spark, sf_dir), ["list_id"], ["ord"], "lvl")
    out = lists.list_labels(counted, "lvl", ["decimal", "lower_letter", "lower_roman"], ["%1.", "%1.%2)", "(%3)"])
    return out.select("list_id", "ord", "lvl", F.col("counter_0").alias("c0"), F.col("counter_1").alias("c1"), F.col("counter_2").alias("c2"), "label")


@query(f"WITH {ITEMS} SELECT list_id, ord, CASE lvl WHEN 0 THEN c0 WHEN 1 THEN c1 ELSE c2 END AS ordinal FROM c")
def list_ordinals(spark, sf_dir):
    return lists.list_ordinals(_items(spark, sf_dir), ["list_id"], ["ord"], "lvl").select("list_id", "ord", "ordinal")


@query("SELECT user_id, event_type, min(event_id) AS first, row_number() OVER (PARTITION BY user_id ORDER BY min(event_id)) AS number FROM events GROUP BY user_id, event_type")
def note_numbers(spark, sf_dir):
    return lookups.first_reference_numbers(table(spark, sf_dir, "events"), ["user_id"], "event_type", "event_id")


# Styles -------------------------------------------------------------------------------------

CHAIN = """WITH RECURSIVE p AS (SELECT CAST(p_partkey AS BIGINT) AS id, CAST(p_partkey // 2 AS BIGINT) AS up FROM part),
 c(style, ancestor, depth) AS (SELECT id, id, 0 FROM p UNION ALL SELECT c.style, p.up, c.depth + 1 FROM c JOIN p ON p.id = c.ancestor JOIN p q ON q.id = p.up WHERE c.depth < 31 AND p.up > 0)"""


def _styles(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    up = F.floor(F.col("p_partkey") / 2).cast("long")
    return parts.select(
        F.lit(1).alias("sheet"), F.col("p_partkey").cast("long").alias("style_id"), F.when(up > 0, up).alias("based_on"),
        F.when(F.col("p_size") % 3 == 0, F.col("p_size").cast("long")).alias("size"), F.when(F.col("p_partkey") % 5 == 0, F.col("p_brand")).alias("brand"),
        F.when(F.col("p_size") % 4 == 0, F.col("p_partkey") % 2 == 0).alias("bold"),
    )


@query(CHAIN + " SELECT style, ancestor, CAST(depth AS INT) AS depth FROM c")
def style_chain(spark, sf_dir):
    return styles.style_chains(_styles(spark, sf_dir), ["sheet"]).select("style", "ancestor", F.col("depth").cast("int").alias("depth"))


@query(
    CHAIN + """, v AS (SELECT c.style, c.depth, CASE WHEN p_size % 3 = 0 THEN CAST(p_size AS BIGINT) END AS size, CASE WHEN p_partkey % 5 = 0 THEN p_brand END AS brand,
 CASE WHEN p_size % 4 = 0 THEN p_partkey % 2 = 0 END AS bold FROM c JOIN part ON p_partkey = c.ancestor)
 SELECT style, arg_min(size, depth) FILTER (size IS NOT NULL) AS size, arg_min(brand, depth) FILTER (brand IS NOT NULL) AS brand,
 CASE WHEN count(bold) > 0 THEN sum(CAST(bold AS INT)) % 2 = 1 END AS bold FROM v GROUP BY style"""
)
def style_resolve(spark, sf_dir):
    sheet = _styles(spark, sf_dir)
    return styles.resolve(styles.style_chains(sheet, ["sheet"]), sheet, ["sheet"], ["size", "brand"], ["bold"]).drop("sheet")


@query("SELECT a, b, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN a <> b ELSE coalesce(a, b) END AS t, count(*) AS n FROM (SELECT CASE l_linenumber % 3 WHEN 0 THEN true WHEN 1 THEN false END AS a, CASE l_suppkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS b FROM lineitem) GROUP BY ALL")
def toggle_xor(spark, sf_dir):
    def state(c):
        return F.when(F.col(c) % 3 == 0, True).when(F.col(c) % 3 == 1, False)

    rows = table(spark, sf_dir, "lineitem").select(state("l_linenumber").alias("a"), state("l_suppkey").alias("b"))
    return rows.groupBy("a", "b").agg(F.count("*").alias("n")).withColumn("t", fn.toggle(F.col("a"), F.col("b")))


@query("SELECT user_id, event_id, last_value(CASE WHEN value > 50 THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS carried FROM events")
def section_carry(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    return lookups.carry_forward(rows, ["user_id"], ["event_id"], F.when(F.col("value") > 50, F.col("value")), "carried").select("user_id", "event_id", "carried")


# Tables -------------------------------------------------------------------------------------


@query("SELECT r_regionkey, string_agg(n_nationkey || chr(9) || n_name, chr(10) ORDER BY n_nationkey) AS tsv FROM region JOIN nation ON r_regionkey = n_regionkey GROUP BY r_regionkey")
def table_tsv(spark, sf_dir):
    rows = table(spark, sf_dir, "region").join(table(spark, sf_dir, "nation"), F.col("r_regionkey") == F.col("n_regionkey"))
    line = F.concat(F.col("n_nationkey").cast("string"), F.lit("\t"), F.col("n_name"))
    cells = rows.groupBy("r_regionkey").agg(F.sort_array(F.collect_list(F.struct("n_nationkey", line.alias("line")))).alias("rows"))
    return cells.select("r_regionkey", F.array_join(F.transform("rows", lambda x: x["line"]), "\n").alias("tsv"))


@query("SELECT r_regionkey, '| key | name |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || n_nationkey || ' | ' || replace(n_name, '|', chr(92) || '|') || ' |', chr(10) ORDER BY n_nationkey) AS md FROM region JOIN nation ON r_regionkey = n_regionkey GROUP BY r_regionkey")
def markdown_table(spark, sf_dir):
    rows = table(spark, sf_dir, "region").join(table(spark, sf_dir, "nation"), F.col("r_regionkey") == F.col("n_regionkey"))
    line = F.concat(F.lit("| "), F.col("n_nationkey").cast("string"), F.lit(" | "), fn.escape_markdown(F.col("n_name"), in_table=True), F.lit(" |"))
    cells = rows.groupBy("r_regionkey").agg(F.sort_array(F.collect_list(F.struct("n_nationkey", line.alias("line")))).alias("rows"))
    return cells.select("r_regionkey", F.concat(F.lit("| key | name |\n| --- | --- |\n"), F.array_join(F.transform("rows", lambda x: x["line"]), "\n")).alias("md"))


@query("SELECT l_orderkey, l_linenumber, l_suppkey, CAST(coalesce(sum(1 + l_partkey % 3) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_col, l_partkey FROM lineitem")
def cell_columns(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumn("span", 1 + F.col("l_partkey") % 3)
    return isl.start_columns(rows, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey"], "span").select("l_orderkey", "l_linenumber", "l_suppkey", "start_col", "l_partkey")


CELLS = "c AS (SELECT l_suppkey AS col, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) AS r, l_partkey % 3 <> 0 AS cont FROM lineitem)"


@query(
    f"WITH {CELLS}, o AS (SELECT *, CAST(NOT cont OR r = 1 AS INT) AS opens FROM c), g AS (SELECT *, sum(opens) OVER (PARTITION BY col ORDER BY r ROWS UNBOUNDED PRECEDING) AS run FROM o) "
    "SELECT col, min(r) AS r, count(*) AS row_span FROM g GROUP BY col, run"
)
def row_spans(spark, sf_dir):
    place = F.row_number().over(W.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey")).cast("long")
    cells = table(spark, sf_dir, "lineitem").select(F.lit(1).alias("t"), F.col("l_suppkey").alias("col"), place.alias("r"), (F.col("l_partkey") % 3 != 0).alias("cont"))
    return isl.row_spans(cells, ["t"], "r", "col", F.col("cont")).select("col", "r", "row_span")


# Escapes ------------------------------------------------------------------------------------

ESCAPED = r"""regexp_replace({0}, '([\\`*\[\]<~])', '\\\1', 'g')"""


@query(
    r"SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '([\\`*\[\]<~])', '\\\1', 'g'), "
    r"'([\p{L}\p{N}])_([\p{L}\p{N}])', '\1' || chr(1) || '\2', 'g'), '_', '\\_', 'g'), chr(1), '_', 'g')) AS digest FROM documents"
)
def md_escape(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(fn.escape_markdown(F.col("text"))).alias("digest"))


@query(
    rf"WITH {LINES} SELECT doc_id, line, regexp_replace(regexp_replace(text, '^([#>+=-])', '\\\1'), '^([0-9]{{1,9}})([.)])([ \t]|$)', '\1\\\2\3') AS text FROM lines"
)
def md_line_start(spark, sf_dir):
    return lines_of(table(spark, sf_dir, "documents")).select("doc_id", "line", fn.escape_line_start(F.col("text")).alias("text"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN '``' || t || '``' WHEN p_partkey % 3 = 1 THEN '`' || t || '`' ELSE '``` ' || t || ' ```' END AS span FROM (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN replace(p_name, ' ', '`') || 'x' WHEN 1 THEN p_name ELSE '``' || p_name END AS t FROM part) WHERE p_partkey % 3 > 0 OR contains(t, '`')")
def code_fence(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    text = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.replace("p_name", F.lit(" "), F.lit("`")), F.lit("x"))).when(F.col("p_partkey") % 3 == 1, F.col("p_name")).otherwise(F.concat(F.lit("``"), F.col("p_name")))
    rows = part.select("p_partkey", text.alias("t")).where((F.col("p_partkey") % 3 > 0) | F.contains("t", F.lit("`")))
    return rows.select("p_partkey", fn.code_span(F.col("t")).alias("span"))


@query("SELECT page_id, md5(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')) AS digest FROM pages")
def html_escape(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.md5(fn.escape_html(F.col("html"))).alias("digest"))


@query("SELECT page_id, CASE WHEN regexp_matches(u, '[ ()]') THEN '<' || u || '>' ELSE u END AS link FROM (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN url || '(1)' ELSE url END AS u FROM pages)")
def url_wrap(spark, sf_dir):
    url = F.when(F.col("page_id") % 2 == 0, F.concat("url", F.lit("(1)"))).otherwise(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", fn.wrap_url(url).alias("link"))


@query("SELECT page_id, to_base64(encode(url)) AS b64, CAST(octet_length(encode(html)) AS BIGINT) AS n_bytes, md5(html) AS md5, sha256(html) AS sha256, string_split(url, '/')[-1] AS name FROM pages")
def digests(spark, sf_dir):
    body = F.encode("html", "UTF-8")
    return table(spark, sf_dir, "pages").select(
        "page_id", fn.base64_text(F.encode("url", "UTF-8")).alias("b64"), F.octet_length("html").cast("long").alias("n_bytes"), F.md5(body).alias("md5"), F.sha2(body, 256).alias("sha256"), fn.file_name(F.col("url")).alias("name")
    )


# Islands and ranges -------------------------------------------------------------------------


@query(
    "WITH e AS (SELECT user_id, event_id, event_type, CASE WHEN event_type = lag(event_type) OVER w THEN 0 ELSE 1 END AS ch FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)), "
    "g AS (SELECT *, sum(ch) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS grp FROM e) "
    "SELECT user_id, CAST(grp AS BIGINT) AS grp, event_type, count(*) AS n, min(event_id) AS first FROM g GROUP BY ALL"
)
def code_groups(spark, sf_dir):
    rows = isl.islands(table(spark, sf_dir, "events"), ["user_id"], ["event_id"], F.col("event_type"), "grp")
    return rows.groupBy("user_id", "grp", "event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("first"))


RANGES = "r AS (SELECT l_suppkey AS k, l_partkey * 1000 + l_orderkey % 1000 AS s, l_partkey * 1000 + l_orderkey % 1000 + CAST(l_quantity AS BIGINT) * 100 AS e FROM lineitem)"


def _ranges(spark, sf_dir):
    start = F.col("l_partkey") * 1000 + F.col("l_orderkey") % 1000
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("k"), start.alias("s"), (start + F.col("l_quantity").cast("long") * 100).alias("e"))
    return split(rows, ["k"], ["s", "e"])


MERGED = (
    f"{RANGES}, m AS (SELECT *, max(e) OVER (PARTITION BY k ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM r), "
    "n AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach + {gap} THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM m), "
    "x AS (SELECT k, min(s) AS s, max(e) AS e, count(*) AS n_ranges FROM n GROUP BY k, g)"
)


@query("WITH " + MERGED.format(gap=512) + " SELECT * FROM x")
def coalesce_ranges(spark, sf_dir):
    rows, pieces = _ranges(spark, sf_dir)
    return isl.coalesce_ranges(rows, ["k"], "s", "e", 512, pieces)


@query(
    "WITH " + MERGED.format(gap=0) + ", p AS (SELECT k, coalesce(lag(e) OVER (PARTITION BY k ORDER BY s), 0) AS s, s AS e FROM x UNION ALL SELECT k, max(e), 300000000 FROM x GROUP BY k) "
    "SELECT k, greatest(s, 0) AS s, least(e, 300000000) AS e FROM p WHERE greatest(s, 0) < least(e, 300000000)"
)
def uncovered_ranges(spark, sf_dir):
    rows, pieces = _ranges(spark, sf_dir)
    return isl.uncovered_ranges(rows, ["k"], F.lit(0).cast("long"), F.lit(300000000).cast("long"), "s", "e", pieces)


@query(
    "WITH e AS (SELECT user_id, event_id, value, event_type = 'click' AS keeps, sum(CAST(event_type <> 'click' AS INT)) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS g FROM events) "
    "SELECT user_id, event_id, count(*) OVER (PARTITION BY user_id, coalesce(g, 0) ORDER BY event_id ROWS BETWEEN CURRENT ROW AND 64 FOLLOWING) AS group_height FROM e"
)
def keep_with_next(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", F.lit(1).cast("long").alias("h"), (F.col("event_type") == "click").alias("keeps"))
    return isl.group_ahead(rows, ["user_id"], ["event_id"], "h", "keeps").select("user_id", "event_id", "group_height")


@query("SELECT user_id, event_id, event_type, event_type = lag(event_type) OVER w AS joins_above, event_type = lead(event_type) OVER w AS joins_below FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)")
def border_groups(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    return isl.border_groups(rows, ["user_id"], ["event_id"], F.col("event_type"))


# Look-ups -----------------------------------------------------------------------------------

RUNS = "runs AS (SELECT user_id, event_id AS since, event_type AS fmt FROM events WHERE event_type = 'login')"


@query(f"WITH {RUNS}, p AS (SELECT user_id, event_id FROM events) SELECT p.user_id, p.event_id, r.since, r.fmt FROM p ASOF LEFT JOIN runs r ON p.user_id = r.user_id AND p.event_id >= r.since")
def asof_runs(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    runs = events.where("event_type = 'login'").select("user_id", F.col("event_id").alias("since"), F.col("event_type").alias("fmt"))
    points = events.select("user_id", "event_id", F.lit(0).alias("x"))
    return lookups.as_of(points, runs, ["user_id"], "event_id", "since", ["since", "fmt"]).select("user_id", "event_id", "since", "fmt")


@query(
    "WITH pieces AS (SELECT user_id, event_id AS a, event_id + 500 AS b FROM events) "
    "SELECT e.user_id, e.event_id, p.a FROM events e JOIN pieces p ON e.user_id = p.user_id AND e.event_id >= p.a AND e.event_id < p.b"
)
def piece_ranges(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    pieces = events.select("user_id", F.col("event_id").alias("a"), (F.col("event_id") + 500).alias("b"))
    return lookups.range_join(events.select("user_id", "event_id"), pieces, ["user_id"], "event_id", "a", "b", 512).select("user_id", "event_id", "a")


@query("SELECT conv_id, i AS index, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations) WHERE i >= greatest(0, n - 5) AND i < n - 1 AND (i - greatest(0, n - 5)) % 2 = 0")
def page_slices(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    return lookups.slice_of(rows, ["conv_id"], ["turn"], -5, -1, 2).select("conv_id", "index", "turn", "role")


@query(
    f"WITH {LINES}, b AS (SELECT doc_id, line, 1 + length(text) // 80 AS h FROM lines), s AS (SELECT doc_id, row_number() OVER w - 1 AS i, coalesce(sum(h) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 40 AS page FROM b WINDOW w AS (PARTITION BY doc_id ORDER BY line)) "
    "SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY page) - 1 AS page, min(i) AS block_start, max(i) + 1 AS block_end FROM s GROUP BY doc_id, s.page"
)
def page_block_ranges(spark, sf_dir):
    blocks = lines_of(table(spark, sf_dir, "documents")).withColumn("h", (1 + F.floor(F.length("text") / 80)).cast("long"))
    return lookups.page_ranges(blocks, ["doc_id"], ["line"], "h", 40)


@query("SELECT p_name, min(p_partkey) AS p_partkey FROM part GROUP BY p_name")
def dedup_names(spark, sf_dir):
    return lookups.first_of(table(spark, sf_dir, "part"), ["p_name"], ["p_partkey"]).select("p_name", "p_partkey")


@query("WITH f AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS n FROM documents) SELECT DISTINCT doc_id, i FROM f JOIN (SELECT unnest(range(0, 20)) AS k) ON i = k * n // 20")
def even_sample(spark, sf_dir):
    """Evenly spaced documents by rank."""
    return ranks.evenly_spaced(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 20)


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'FURNITURE')")
def missing_refs(spark, sf_dir):
    known = table(spark, sf_dir, "customer").where("c_mktsegment <> 'FURNITURE'")
    return parts.without_target(table(spark, sf_dir, "orders"), "o_custkey", known, "c_custkey").select("o_orderkey", "o_custkey")


@query("SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R') AND p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A')")
def cited_twice(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem")
    return parts.cited_by_all(table(spark, sf_dir, "part").select("p_partkey"), "p_partkey", [items.where(F.col("l_returnflag") == f) for f in "RA"], "l_partkey")


# Aggregates ---------------------------------------------------------------------------------


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_path(spark, sf_dir):
    found = jq(table(spark, sf_dir, "events"), ".k", "event_id", "props")
    return found.select("event_id", F.col("value").cast("long").alias("k"))


@query("SELECT event_type, count(*) FILTER (value < 10) AS ok, count(*) FILTER (value >= 10 AND value < 100) AS error, count(*) FILTER (value >= 100) AS crash FROM events GROUP BY event_type")
def outcome_pivot(spark, sf_dir):
    outcome = F.when(F.col("value") < 10, "ok").when(F.col("value") < 100, "error").otherwise("crash")
    return charts.outcome_pivot(table(spark, sf_dir, "events"), ["event_type"], outcome, ["ok", "error", "crash"])


@query("SELECT event_type, round(avg(value), 6) AS mean, median(value) AS median, quantile_disc(value, 0.1) AS p10, min(value) AS low, max(value) AS high FROM events GROUP BY event_type")
def order_statistics(spark, sf_dir):
    found = ranks.order_statistics(table(spark, sf_dir, "events"), ["event_type"], "value", {"p10": 0.1})
    return found.withColumn("mean", F.round("mean", 6))


@query("SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand HAVING count(*) > 1")
def repeated_refs(spark, sf_dir):
    return parts.repeated(table(spark, sf_dir, "part"), ["p_brand"])


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN sum(abs(l_quantity)) OVER w = 0 THEN 0 ELSE round(l_quantity / sum(abs(l_quantity)) OVER w, 9) END AS share FROM lineitem WINDOW w AS (PARTITION BY l_orderkey)")
def percent_stack(spark, sf_dir):
    return charts.percent_stack(table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_quantity").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "share")


@query("SELECT p_brand, list_sort(list_distinct(list(p_type))) AS types, count(DISTINCT p_type) AS n FROM part GROUP BY p_brand")
def distinct_fonts(spark, sf_dir):
    return parts.distinct_values(table(spark, sf_dir, "part"), ["p_brand"], "p_type", "types")


@query("SELECT doc_id, dense_rank() OVER (PARTITION BY source ORDER BY sha256(text)) - 1 AS media_id, source FROM documents")
def media_ids(spark, sf_dir):
    media = table(spark, sf_dir, "documents").select("doc_id", "source", F.sha2("text", 256).alias("digest"))
    return parts.media_ids(media, ["source"], "digest").select("doc_id", "media_id", "source")


@query("SELECT min(doc_id) AS doc_id, sha256(text) AS digest, count(*) AS n FROM documents GROUP BY sha256(text)")
def media_dedup(spark, sf_dir):
    return parts.media_dedup(table(spark, sf_dir, "documents"), F.sha2("text", 256), "doc_id")


@query("SELECT 'both' AS part, count(*) AS n FROM (SELECT l_partkey FROM lineitem WHERE l_quantity > 40 INTERSECT SELECT p_partkey FROM part WHERE p_size > 20) UNION ALL SELECT 'left', count(*) FROM (SELECT l_partkey FROM lineitem WHERE l_quantity > 40 EXCEPT SELECT p_partkey FROM part WHERE p_size > 20) UNION ALL SELECT 'any', count(*) FROM (SELECT l_partkey FROM lineitem WHERE l_quantity > 40 UNION SELECT p_partkey FROM part WHERE p_size > 20)")
def set_operations(spark, sf_dir):
    a = table(spark, sf_dir, "lineitem").where("l_quantity > 40").select(F.col("l_partkey").alias("k"))
    return parts.set_counts(a, table(spark, sf_dir, "part").where("p_size > 20").select(F.col("p_partkey").alias("k")))


@query("SELECT l_orderkey, list_sort(list_distinct(list(l_partkey * 10 + l_linenumber) FILTER (l_returnflag <> 'R'))) AS stops FROM lineitem GROUP BY l_orderkey")
def tab_stops(spark, sf_dir):
    """Stops by position: repeated ones merge, cleared ones (flag R) go."""
    stop = F.col("l_partkey") * 10 + F.col("l_linenumber")
    return charts.tab_stops(table(spark, sf_dir, "lineitem"), ["l_orderkey"], stop, F.col("l_returnflag") == "R")


# Values -------------------------------------------------------------------------------------

SAMPLES = "('89504E470D0A1A0A00'), ('FFD8FFE0'), ('474946383961'), ('424D0000'), ('49492A00'), ('504B030400'), ('504B0506'), ('7B5C7274663120'), ('D0CF11E0A1B11AE1000057006F007200640044006F00630075006D0065006E007400'), ('DBA52D00'), ('00')"


@query(
    f"WITH d(h) AS (VALUES {SAMPLES}) SELECT h, CASE WHEN starts_with(h, '89504E470D0A1A0A') THEN 'image/png' WHEN starts_with(h, 'FFD8FF') THEN 'image/jpeg' WHEN h[1:12] IN ('474946383761', '474946383961') THEN 'image/gif' WHEN starts_with(h, '424D') THEN 'image/bmp' "
    "WHEN h[1:8] IN ('49492A00', '4D4D002A') THEN 'image/tiff' ELSE 'application/octet-stream' END AS image, "
    "CASE WHEN h[1:8] IN ('504B0304', '504B0506', '504B0708') THEN 'docx' WHEN starts_with(h, '7B5C727466') THEN 'rtf' WHEN starts_with(h, 'D0CF11E0A1B11AE1') THEN CASE WHEN contains(h, '57006F007200640044006F00630075006D0065006E007400') THEN 'doc' ELSE 'unknown' END WHEN h[1:4] IN ('DBA5', 'ECA5') THEN 'doc' ELSE 'unknown' END AS format FROM d"
)
def sniff_detect(spark, sf_dir):
    rows = spark.sql(f"SELECT h, unhex(h) AS data FROM VALUES {SAMPLES} AS d(h)")
    return rows.select("h", fn.sniff_image(F.col("data")).alias("image"), fn.detect_format(F.col("data")).alias("format"))


@query(
    "SELECT n, CASE n % 4 WHEN 0 THEN n WHEN 1 THEN CAST(round(n * 20.0) AS BIGINT) WHEN 2 THEN CAST(round(n * 1440.0) AS BIGINT) ELSE CAST(round(n * (1440 / 2.54)) AS BIGINT) END AS twips, NOT (n % 5 IN (0, 1)) AS flag, "
    "printf('%02X%02X%02X', n % 256, n // 2 % 256, n // 3 % 256) AS colour, CAST(DATE '1970-01-01' + CAST(n AS INT) AS VARCHAR) AS day FROM (SELECT DISTINCT o_custkey AS n FROM orders)"
)
def value_functions(spark, sf_dir):
    n = F.col("n")
    text = F.concat(n.cast("string"), F.when(n % 4 == 0, "").when(n % 4 == 1, "pt").when(n % 4 == 2, "in").otherwise("cm"))
    flag = F.when(n % 5 == 0, "0").when(n % 5 == 1, "false").when(n % 5 == 2, "on").when(n % 5 == 3, "1")
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("n")).distinct()
    colour = fn.hex_colour(n % 256, F.floor(n / 2) % 256, F.floor(n / 3) % 256)
    return rows.select("n", fn.measure(text).alias("twips"), fn.on_off(flag).alias("flag"), colour.alias("colour"), fn.civil_date(n).cast("string").alias("day"))


# Documents ----------------------------------------------------------------------------------


def _texts(spark, sf_dir):
    """Every document's text, to be written and read as a file: much work a row."""
    return dealt(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), "doc_id", "text")


@query(
    "SELECT doc_id, md5(text || chr(10)) AS text_digest, CAST(len(string_split(text, chr(10))) AS BIGINT) AS n_lines FROM documents"
)
def docx_roundtrip(spark, sf_dir):
    """Every document written as a DOCX file, and its text read back."""
    from . import documents as d

    back = d.parse(d.to_files(_texts(spark, sf_dir)), "doc_id", outputs=("text",))
    return back.select("doc_id", F.md5("text").alias("text_digest"), (F.size(F.split("text", "\n", -1)) - 1).cast("long").alias("n_lines"))


@query(
    f"WITH {LINES} SELECT doc_id, count(*) AS n_blocks, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM lines GROUP BY doc_id"
)
def docx_blocks(spark, sf_dir):
    """The block view of every document after a round trip through DOCX."""
    from . import documents as d

    blocks = d.block_view(d.parse(d.to_files(_texts(spark, sf_dir)), "doc_id", outputs=()), "doc_id")
    return blocks.groupBy("doc_id").agg(F.count("*").alias("n_blocks"), F.sum(F.length("text")).alias("n_chars"))


@query()
def markdown_to_html(spark, sf_dir):
    """Documents read as Markdown, written as DOCX, read back and given as Markdown and HTML digests."""
    from . import documents as d

    back = d.parse(d.to_files(_texts(spark, sf_dir), markdown=True), "doc_id", outputs=("markdown", "html"))
    return back.select("doc_id", F.md5("markdown").alias("markdown_digest"), F.md5("html").alias("html_digest"), F.size("blocks").alias("n_blocks"), "error")


@query()
def html_to_blocks(spark, sf_dir):
    """Headings, paragraphs and list items of the pages' HTML, scripts and styles left out. No UDF."""
    pages = table(spark, sf_dir, "pages")
    clean = F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1\s*>", "")
    tags = F.regexp_extract_all(clean, F.lit(r"(?is)<(h[1-6]|p|li)\b[^>]*>((?:(?!</?(?:h[1-6]|p|li|ul|ol|div|article|nav|footer)\b).)*+)"), F.lit(0))
    rows = pages.select("page_id", F.posexplode(tags).alias("ord", "raw"))
    kind = F.lower(F.regexp_extract("raw", r"^<(\w+)", 1))
    text = F.btrim(F.regexp_replace(F.regexp_replace("raw", "<[^>]*>", ""), r"\s+", " "))
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return rows.select("page_id", "ord", kind.alias("kind"), text.alias("text")).where("text <> ''")


REPORT = """WITH o AS (SELECT o_custkey AS k, o_orderkey AS id, o_orderstatus AS st, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM orders),
 g AS (SELECT k, count(*) AS n, string_agg(i || '. order ' || id, chr(10) ORDER BY i) AS items, string_agg('| ' || id || ' | ' || st || ' |', chr(10) ORDER BY i) AS cells,
  string_agg('<li>order ' || id || '</li>', chr(10) ORDER BY i) AS lis, string_agg('<tr><td>' || id || '</td><td>' || st || '</td></tr>', chr(10) ORDER BY i) AS trs, string_agg(id || chr(9) || st, chr(10) ORDER BY i) AS tabs FROM o GROUP BY k),
 r AS (SELECT *, c_name AS name, lower(c_mktsegment) AS seg, chr(10) AS nl FROM g JOIN customer ON c_custkey = k)
SELECT k AS custkey, md5('# ' || name || nl || nl || 'On **' || n || '** orders, *' || seg || '* market.' || nl || nl || items || nl || nl || '| key | status |' || nl || '| --- | --- |' || nl || cells || nl) AS markdown,
 md5('<h1>' || name || '</h1>' || nl || '<p>On <strong>' || n || '</strong> orders, <em>' || seg || '</em> market.</p>' || nl || '<ol>' || nl || lis || nl || '</ol>' || nl || '<table>' || nl || '<tr><th>key</th><th>status</th></tr>' || nl || trs || nl || '</table>' || nl) AS html,
 md5(name || nl || 'On ' || n || ' orders, ' || seg || ' market.' || nl || items || nl || 'key' || chr(9) || 'status' || nl || tabs || nl) AS text, n + 3 AS n_blocks FROM r"""


@query(REPORT)
def report_formats(spark, sf_dir):
    """A report for each customer with orders: Markdown with a heading, marks, a list and a table is read, written as a
    DOCX file, and read back into every format."""
    from . import documents as d

    orders = dealt(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("custkey"), "o_orderkey", "o_orderstatus"), "custkey")
    orders = orders.groupBy("custkey").agg(F.sort_array(F.collect_list(F.struct("o_orderkey", "o_orderstatus"))).alias("orders"))
    rows = orders.join(table(spark, sf_dir, "customer"), F.col("custkey") == F.col("c_custkey"))
    items = F.array_join(F.transform("orders", lambda o, i: F.concat((i + 1).cast("string"), F.lit(". order "), o["o_orderkey"].cast("string"))), "\n")
    cells = F.array_join(F.transform("orders", lambda o: F.concat(F.lit("| "), o["o_orderkey"].cast("string"), F.lit(" | "), o["o_orderstatus"], F.lit(" |"))), "\n")
    text = F.format_string("# %s\n\nOn **%d** orders, *%s* market.\n\n%s\n\n| key | status |\n| --- | --- |\n%s\n", F.col("c_name"), F.size("orders"), F.lower("c_mktsegment"), items, cells)
    back = d.parse(d.to_files(rows.select("custkey", text.alias("text")), "custkey", markdown=True), "custkey")
    return back.select("custkey", F.md5("markdown").alias("markdown"), F.md5("html").alias("html"), F.md5("text").alias("text"), F.size("blocks").cast("long").alias("n_blocks"))


# Sections, parts, fonts and charts ----------------------------------------------------------


@query(
    "WITH e AS (SELECT user_id, event_id, coalesce(sum(CAST(event_type = 'login' AS INT)) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS section FROM events) "
    "SELECT user_id, event_id, CAST(section AS BIGINT) AS section, row_number() OVER (PARTITION BY user_id, section ORDER BY event_id) AS number FROM e"
)
def page_numbers(spark, sf_dir):
    """Sections end at a mark; numbering starts anew in each."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    return isl.page_numbers(rows, ["user_id"], ["event_id"], F.col("event_type") == "login").drop("event_type")


@query(
    "WITH p AS (SELECT page_id, lower(regexp_extract(url, '\\.([A-Za-z0-9]+)([?#]|$)', 1)) AS ext FROM pages), o(page_id, kind) AS (SELECT page_id, 'text/override' FROM pages WHERE contains(url, '/de/')), "
    "d(ext, kind) AS (VALUES ('html', 'text/html'), ('com', 'application/x-host'), ('org', 'application/x-host')) "
    "SELECT p.page_id, coalesce(o.kind, d.kind) AS kind FROM p LEFT JOIN o USING (page_id) LEFT JOIN d ON p.ext = d.ext"
)
def content_types(spark, sf_dir):
    """An override by part, else the default of its extension, else none."""
    pages = table(spark, sf_dir, "pages")
    overrides = pages.where(F.contains("url", F.lit("/de/"))).select("page_id", F.lit("text/override").alias("kind"))
    defaults = spark.createDataFrame([("html", "text/html"), ("com", "application/x-host"), ("org", "application/x-host")], "ext string, kind string")
    return parts.content_types(pages, "page_id", "url", overrides, defaults)


@query(
    "WITH c AS (SELECT o_orderkey, p_partkey, CASE WHEN p_size = o_custkey % 50 + 1 THEN 0 WHEN p_size % 10 = o_custkey % 10 THEN 1 ELSE 2 END AS rank FROM orders JOIN part ON p_brand = 'Brand#' || (o_custkey % 25 + 1)) "
    "SELECT o_orderkey, p_partkey, rank FROM (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY rank, p_partkey) AS k FROM c) WHERE k = 1"
)
def font_choice(spark, sf_dir):
    """Requests and faces of one family; the exact face, else one of its class, else any: the first of the best."""
    size = F.col("o_custkey") % 50 + 1
    asked = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("Brand#"), (F.col("o_custkey") % 25 + 1).cast("string")).alias("family"), size.alias("size"), (F.col("o_custkey") % 10).alias("kin"))
    faces = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("family"), F.col("p_size").alias("size"), (F.col("p_size") % 10).alias("kin"))
    return parts.font_choice(asked, "o_orderkey", faces, "p_partkey", "family", "size", "kin")


@query(
    "WITH s AS (SELECT user_id AS category, event_type, sum(value) AS v FROM events GROUP BY ALL), r AS (SELECT DISTINCT category FROM s ORDER BY category LIMIT 50) "
    "SELECT category, CAST(round(max(v) FILTER (event_type = 'click'), 6) AS DOUBLE) AS click, CAST(round(max(v) FILTER (event_type = 'login'), 6) AS DOUBLE) AS login FROM s JOIN r USING (category) GROUP BY category"
)
def chart_table(spark, sf_dir):
    """A chart's cached values as a table: at most 50 categories, a column a series."""
    cells = table(spark, sf_dir, "events").withColumnRenamed("user_id", "category")
    rows = charts.chart_table(cells, "category", "event_type", F.sum("value"), ["click", "login"])
    return rows.select("category", F.round("click", 6).alias("click"), F.round("login", 6).alias("login"))


STEP = "CASE WHEN m <= 1 THEN 1 WHEN m <= 2 THEN 2 WHEN m <= 5 THEN 5 ELSE 10 END"


@query(
    f"WITH r AS (SELECT event_type, min(value) AS low, max(value) AS high FROM events GROUP BY event_type), s AS (SELECT *, power(10, floor(log10((high - low) / 5))) AS p FROM r), t AS (SELECT *, (high - low) / 5 / p AS m FROM s) "
    f"SELECT event_type, low, high, round({STEP} * p, 9) AS step, CAST(floor(low / ({STEP} * p)) AS BIGINT) AS first FROM t"
)
def axis_steps(spark, sf_dir):
    """Value ranges with steps of 1, 2 or 5 times a power of ten."""
    return charts.axes(table(spark, sf_dir, "events"), ["event_type"], "value")


@query(
    "WITH p AS (SELECT p_partkey, lower(replace(p_name, ' ', '/')) AS name FROM part), w AS (SELECT p_partkey, upper(replace(p_name, ' ', '/')) AS wanted FROM part) "
    "SELECT w.p_partkey, min(p.p_partkey) AS found FROM w JOIN p ON lower(ltrim(replace(w.wanted, chr(92), '/'), '/')) = p.name GROUP BY w.p_partkey"
)
def part_lookup(spark, sf_dir):
    """Parts by name without regard to case or the kind of slash; of equal names the first."""
    part = table(spark, sf_dir, "part")
    names = part.select(F.translate("p_name", " ", "/").alias("name"), F.col("p_partkey").alias("place"))
    wanted = part.select("p_partkey", F.concat(F.lit("\\"), F.upper(F.translate("p_name", " ", "\\"))).alias("wanted"))
    return parts.part_lookup(wanted, "wanted", names, "name", "place").select("p_partkey", "found")


@query("SELECT page_id, rtrim('media/' || regexp_extract(url, '([^/]*)$', 1), '/') AS path FROM pages")
def target_paths(spark, sf_dir):
    """Relationship targets against their folder: ``.`` and ``..`` resolved by a fold over the segments."""
    host = F.regexp_extract("url", r"://([^/]*)", 1)
    target = F.concat(F.lit("../././media/"), host, F.lit("/../"), F.regexp_extract("url", "([^/]*)$", 1))
    return table(spark, sf_dir, "pages").select("page_id", fn.resolved_path(target, F.lit("word//../theme")).alias("path"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(least(255, greatest(0, round(l_partkey % 256 * 0.5))) AS INT) AS shaded, CAST(least(255, greatest(0, round(l_partkey % 256 * 0.25 + 0.75 * 255))) AS INT) AS tinted FROM lineitem")
def colour_transforms(spark, sf_dir):
    channel = (F.col("l_partkey") % 256).cast("double")
    shaded, tinted = fn.scale_channel(channel, shade=F.lit(0.5)), fn.scale_channel(channel, tint=F.lit(0.25))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", shaded.alias("shaded"), tinted.alias("tinted"))


# Codes and values of office files -----------------------------------------------------------

LANGUAGE_SQL = "CASE lid " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in office.LANGUAGES.items()) + " ELSE lpad(printf('%X', lid), 4, '0') END"
PAGE_SQL = "CASE WHEN lid = 2052 THEN 936 " + " ".join(f"WHEN lid % 1024 IN ({', '.join(map(str, v))}) THEN {k}" for k, v in office.CODE_PAGES.items()) + " ELSE 1252 END"
FORMAT_SQL = "CASE lid % 256 " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in office.NUMBER_FORMATS.items()) + " ELSE 'msonfc' || (lid % 256) END"


@query(f"WITH l AS (SELECT DISTINCT o_orderkey % 4200 AS lid FROM orders) SELECT lid, {LANGUAGE_SQL} AS tag, CAST({PAGE_SQL} AS INT) AS page, {FORMAT_SQL} AS format FROM l")
def language_codes(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 4200).alias("lid")).distinct()
    lid = F.col("lid")
    return rows.select("lid", fn.language_tag(lid).alias("tag"), fn.code_page(lid).cast("int").alias("page"), fn.number_format(lid % 256).alias("format"))


@query(
    "WITH p AS (SELECT p_partkey, p_size * 40 AS w, p_partkey % 3000 AS h, 1440 + p_size * 100 AS most FROM part) SELECT p_partkey, least(greatest(w, 1) * 9525, most * 635) AS cx, "
    "CAST(CASE WHEN greatest(w, 1) * 9525 > most * 635 THEN (greatest(h, 1) * 9525 * most * 635) // (greatest(w, 1) * 9525) ELSE greatest(h, 1) * 9525 END AS BIGINT) AS cy FROM p"
)
def fitted_pictures(spark, sf_dir):
    size = fn.fit(F.col("p_size") * 40, F.col("p_partkey") % 3000, 1440 + F.col("p_size") * 100)
    return table(spark, sf_dir, "part").select("p_partkey", size.alias("s")).select("p_partkey", "s.cx", "s.cy")


@query(
    "WITH e AS (SELECT event_id, least(1.0, greatest(0.0, value / 200)) * 100000 AS x FROM events), k AS (SELECT *, x <= 20000 AS low, x > 80000 AS high, (x - 20000) / 60000 AS k FROM e) "
    "SELECT event_id, CAST(CASE WHEN low THEN 255 WHEN high THEN 0 ELSE floor(255 - 255 * k + 0.5) END AS INT) AS red, CAST(CASE WHEN low THEN 0 WHEN high THEN 200 ELSE floor(200 * k + 0.5) END AS INT) AS green, 16 AS blue FROM k"
)
def gradient_colours(spark, sf_dir):
    """A colour along a gradient of two stops at a fifth and at four fifths."""
    stop = lambda at, *rgb: F.struct(F.lit(at).alias("at"), F.array(*map(F.lit, rgb)).alias("rgb"))
    rows = table(spark, sf_dir, "events").select("event_id", fn.gradient_at(F.array(stop(20000, 255, 0, 16), stop(80000, 0, 200, 16)), F.col("value") / 200).alias("c"))
    return rows.select("event_id", *(F.get("c", F.lit(i)).alias(name) for i, name in enumerate(("red", "green", "blue"))))


@query(
    "WITH c AS (SELECT DISTINCT l_partkey % 256 AS grey FROM lineitem) SELECT grey, CAST(floor(least(1, grey / 255 * 0.5) * 255 + 0.5) AS INT) AS darker, CAST(floor(least(1, grey / 255 + 0.25) * 255 + 0.5) AS INT) AS lighter FROM c"
)
def lightness(spark, sf_dir):
    """Greys with their lightness halved, and raised by a quarter."""
    grey = F.col("grey")
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 256).alias("grey")).distinct()
    return rows.select("grey", F.get(fn.luminance(grey, grey, grey, scale=F.lit(0.5)), F.lit(0)).alias("darker"), F.get(fn.luminance(grey, grey, grey, shift=F.lit(0.25)), F.lit(1)).alias("lighter"))


@query("SELECT o_orderkey, format('{:,}', CAST(floor(o_totalprice) AS BIGINT)) AS whole, CAST(o_custkey AS VARCHAR) AS general, CAST(o_custkey * 100 AS VARCHAR) || '%' AS percent FROM orders")
def axis_numbers(spark, sf_dir):
    whole = F.floor("o_totalprice").cast("double")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", fn.axis_number(whole, F.lit("#,##0")).alias("whole"), fn.axis_number(F.col("o_custkey"), F.lit(None).cast("string")).alias("general"), fn.axis_number(F.col("o_custkey"), F.lit("0%")).alias("percent")
    )


@query(
    "SELECT event_id, CASE event_type WHEN 'click' THEN user_id = 1 WHEN 'login' THEN user_id <> 1 ELSE TRUE END AS shows, list_sort(list_distinct(list_filter([CASE WHEN user_id % 2 = 0 THEN event_type END, 'd' || user_id % 3, CASE WHEN user_id % 5 > 0 THEN 'd1' END], lambda x: x IS NOT NULL))) AS ids FROM events"
)
def section_choices(spark, sf_dir):
    """Whether a page shows its section's borders, and the distinct headers of a section."""
    kind = F.when(F.col("event_type") == "click", "firstPage").when(F.col("event_type") == "login", "notFirstPage").otherwise("allPages")
    user = F.col("user_id")
    ids = fn.header_ids(F.when(user % 2 == 0, F.col("event_type")), F.concat(F.lit("d"), (user % 3).cast("string")), F.when(user % 5 > 0, F.lit("d1")))
    return table(spark, sf_dir, "events").select("event_id", fn.border_shows(kind, user == 1).alias("shows"), F.array_sort(ids).alias("ids"))
