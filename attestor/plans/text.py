"""Text operators over whole tables: tokens, ids, languages, slugs, URLs, advisory scans, windows of text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from attestor.functions import text as T
from attestor.operators import lifecycle as L
from attestor.plans.catalog import query, read

_FOLD = "replace(replace(lower(text), 'ß', 'ss'), 'ς', 'σ')"
_EN, _ES = (", ".join(f"'{w}'" for w in words) for words in (T.ENGLISH, T.SPANISH))
_WORDS = "regexp_extract_all(translate(lower(text), 'áéíóúüñàèìòù', 'aeiouunaeiou'), '[a-z]+')"
LANGUAGE_SQL = f"""CASE WHEN greatest(en, es) >= {T.LEAST_HITS} AND abs(en - es) >= {T.LEAST_MARGIN} THEN CASE WHEN en > es THEN 'en' ELSE 'es' END END"""
COUNTS_SQL = f"""len(list_filter({_WORDS}, lambda w: w IN ({_EN}))) AS en, len(list_filter({_WORDS}, lambda w: w IN ({_ES}))) AS es"""


@query("token_statistics", f"""
    SELECT doc_id, len(t) AS n_tokens, len(list_distinct(t)) AS n_distinct, len(u) AS n_terms
    FROM (SELECT doc_id, regexp_extract_all({_FOLD}, '[\\p{{L}}\\p{{N}}_]+') AS t, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS u FROM documents)""")  # fmt: skip
def token_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "documents").select("doc_id", T.tokens(F.col("text")).alias("t"), T.terms(F.col("text")).alias("u"))
    return rows.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"), F.size("u").cast("long").alias("n_terms"))


@query("document_frequency", f"""
    SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct(regexp_extract_all({_FOLD}, '[\\p{{L}}\\p{{N}}_]+'))) AS term FROM documents) GROUP BY term""")  # fmt: skip
def document_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "documents").select(F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("term"))
    return rows.groupBy("term").agg(F.count("*").alias("df"))


@query("language_detect", f"SELECT doc_id, {LANGUAGE_SQL} AS language FROM (SELECT doc_id, {COUNTS_SQL} FROM documents)")
def language_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", T.language(F.col("text")).alias("language"))


@query("dominant_language", f"""
    WITH v AS (SELECT source, {LANGUAGE_SQL} AS code FROM (SELECT source, {COUNTS_SQL} FROM documents)),
         n AS (SELECT source, code, count(*) AS votes FROM v WHERE code IS NOT NULL GROUP BY ALL),
         m AS (SELECT source, sum(votes) AS total, max({{'votes': votes, 'code': code}}) AS lead FROM n GROUP BY source)
    SELECT s.source, CASE WHEN 2 * lead.votes > total THEN lead.code END AS language FROM (SELECT DISTINCT source FROM documents) s LEFT JOIN m USING (source)""")  # fmt: skip
def dominant_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language that more than half of a source's identified documents are in."""
    votes = read(spark, sf_dir, "documents").select("source", T.language(F.col("text")).alias("code")).groupBy("source", "code").agg(F.count("*").alias("votes"))
    found = F.col("code").isNotNull()
    lead = votes.groupBy("source").agg(F.max(F.when(found, F.struct("votes", "code"))).alias("lead"), F.sum(F.when(found, F.col("votes"))).alias("total"))
    return lead.select("source", F.when(2 * F.col("lead.votes") > F.col("total"), F.col("lead.code")).alias("language"))


@query("corpus_language", f"""
    WITH v AS (SELECT {LANGUAGE_SQL} AS code FROM (SELECT {COUNTS_SQL} FROM (SELECT substr(text, 1, 400) AS text FROM documents ORDER BY doc_id LIMIT 64))),
         n AS (SELECT code, count(*) AS votes FROM v WHERE code IS NOT NULL GROUP BY code)
    SELECT CASE WHEN 2 * max(votes) > sum(votes) THEN max({{'votes': votes, 'code': code}}).code END AS language FROM n""")  # fmt: skip
def corpus_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the first 64 passages by reference and their first 400 characters: a sampling operator by definition."""
    first = read(spark, sf_dir, "documents").orderBy("doc_id").limit(64).select(T.language(F.substring("text", 1, 400)).alias("code")).where("code IS NOT NULL")
    votes = first.groupBy("code").agg(F.count("*").alias("votes"))
    return votes.agg(F.max(F.struct("votes", "code")).alias("lead"), F.sum("votes").alias("total")).select(F.when(2 * F.col("lead.votes") > F.col("total"), F.col("lead.code")).alias("language"))


@query("slugs", """
    SELECT p_partkey, coalesce(nullif(regexp_replace(substr(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), 1, 60), '^-+|-+$', '', 'g'), ''), 'untitled') AS slug FROM part""")
def slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select("p_partkey", T.slug(F.col("p_name")).alias("slug"))


@query("document_names", """
    SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') || '-' || substr(sha256(o_orderkey::VARCHAR), 1, 8) || '-' || lower(regexp_replace(o_orderpriority, '[^A-Za-z0-9]+', '-', 'g')) || '.md' AS name,
           strftime(o_orderdate, '%Y-%m-%d') || '-' || lower(regexp_replace(o_orderpriority, '[^A-Za-z0-9]+', '-', 'g')) || '.md' AS stable_name,
           substr(sha256(o_orderkey::VARCHAR), 1, 8) AS sha8 FROM orders""")  # fmt: skip
def document_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of commit documents, the same without the build's hash, and the hash found in a name again."""
    name = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("-"), F.substring(F.sha2(F.col("o_orderkey").cast("string"), 256), 1, 8), F.lit("-"), T.slug(F.col("o_orderpriority")), F.lit(".md"))
    rows = read(spark, sf_dir, "orders").select("o_orderkey", name.alias("name"))
    return rows.select("o_orderkey", "name", T.strip_build_sha(F.col("name")).alias("stable_name"), F.regexp_extract("name", r"^\d{4}-\d{2}-\d{2}-([0-9a-f]{8})-(.*)$", 1).alias("sha8"))


@query("closing_references", """
    WITH b AS (SELECT o_orderkey, 'Closes: #' || (o_custkey % 97) || chr(10) || 'see #5, fixed issue #' || (o_orderkey % 89) || ' and resolves #' || (o_custkey % 97) AS body FROM orders)
    , m AS (SELECT o_orderkey, regexp_extract_all(body, '(?i)\\b(?:clos(?:e|es|ed)|fix(?:e[sd])?|resolv(?:e|es|ed))\\b[^\\n#]{0,20}#(\\d+)', 1) AS c FROM b)
    SELECT o_orderkey, CASE WHEN c[1] = c[2] THEN 1 ELSE 2 END::BIGINT AS n_closed, CASE WHEN c[1] = c[2] THEN c[1] ELSE c[1] || ',' || c[2] END AS closed FROM m""")  # fmt: skip
def closing_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues that commit bodies close, in order and each once."""
    body = F.concat(F.lit("Closes: #"), F.col("o_custkey") % 97, F.lit("\nsee #5, fixed issue #"), F.col("o_orderkey") % 89, F.lit(" and resolves #"), F.col("o_custkey") % 97)
    rows = read(spark, sf_dir, "orders").select("o_orderkey", T.closes(body).alias("c"))
    return rows.select("o_orderkey", F.size("c").cast("long").alias("n_closed"), F.array_join(F.transform("c", lambda x: x.cast("string")), ",").alias("closed"))


@query("content_ids", """
    SELECT doc_id, 'doc:v1:' || sha256(source || '/' || doc_id || '.md') AS document_ref,
           'chunk:v1:' || sha256(source || '/' || doc_id || '.md' || chr(0) || lang || chr(0) || '0' || chr(0) || '0') AS ref, sha256(text) AS source_hash FROM documents""")  # fmt: skip
def content_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stable references of documents and passages, and hashes of their bytes."""
    relative = F.concat_ws("/", "source", F.concat(F.col("doc_id").cast("string"), F.lit(".md")))
    return read(spark, sf_dir, "documents").select(
        "doc_id", T.digest("doc:v1:", relative).alias("document_ref"), T.digest("chunk:v1:", relative, F.col("lang"), F.lit("0"), F.lit("0")).alias("ref"), F.sha2("text", 256).alias("source_hash")
    )


@query("manifest_hash", """
    WITH m AS (SELECT source, source || '/' || doc_id AS p, sha256(text) AS h FROM documents),
    b AS (SELECT source, substr(sha256(p), 1, 4) AS bucket, count(*) AS files, sha256(string_agg(p || chr(0) || h || chr(10), '' ORDER BY p)) AS h FROM m GROUP BY ALL)
    SELECT source, sum(files)::BIGINT AS files, sha256(string_agg(bucket || h, '' ORDER BY bucket)) AS manifest_hash FROM b GROUP BY source""")
def manifest_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source the layered hash over its files' paths and hashes; only those short lines are gathered, no text, and a bucket of them at a time."""
    path = F.concat_ws("/", "source", F.col("doc_id").cast("string"))
    rows = read(spark, sf_dir, "documents").select("source", path.alias("key"), F.struct(path.alias("p"), F.sha2("text", 256).alias("h")).alias("line"))
    return L.layered_digest(rows, "source", F.concat("line.p", F.lit("\0"), "line.h", F.lit("\n")), "files", "manifest_hash")


_HITS = ", ".join(f"CASE WHEN regexp_matches(text, '{p}') THEN '{c}' END" for c, p in T.ADVISORIES)


@query("advisory_scan", f"SELECT doc_id, array_to_string(list_filter([{_HITS}], lambda c: c IS NOT NULL), ',') AS advisories FROM documents")
def advisory_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", F.array_join(T.advisories(F.col("text")), ",").alias("advisories"))


@query("control_characters", """
    SELECT page_id, regexp_matches(html || CASE WHEN page_id % 3 = 0 THEN chr(8238) ELSE '' END, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F-\\x{9F}\\p{Cf}]') AS refused FROM pages""")
def control_characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with control or format characters are refused; every third page gets a direction override to be found."""
    text = F.concat("html", F.when(F.col("page_id") % 3 == 0, F.lit("\u202e")).otherwise(F.lit("")))
    return read(spark, sf_dir, "pages").select("page_id", T.has_control(text).alias("refused"))


_URL = r"regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)"


@query("canonical_urls", rf"""
    WITH p AS (SELECT page_id, url, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)) AS host,
                      coalesce(nullif(regexp_extract(url, '^[^:]*://(?:[^/?#@]*@)?[^/?#:]*:(\d{{1,5}})', 1), ''), '443') AS port,
                      coalesce(nullif(regexp_extract(url, '^[^:]*://[^/?#]*([^?#]*)', 1), ''), '/') AS path, regexp_extract(url, '^[^?#]*(\?[^#]*)?', 1) AS q FROM pages),
         c AS (SELECT page_id, host, lower({_URL}) || '://' || host || ':' || port || path || q AS canonical FROM p)
    SELECT page_id, host, canonical, sha256(canonical) AS cache_key FROM c""")  # fmt: skip
def canonical_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "pages").select("page_id", T.host(F.col("url")).alias("host"), T.canonical_url(F.col("url")).alias("canonical"))
    return rows.withColumn("cache_key", F.sha2("canonical", 256))


@query("windowed_reads", """
    WITH r AS (SELECT doc_id, text, 1 + doc_id % 700 AS a, 1 + doc_id % 700 + doc_id % 300 AS b FROM documents),
         v AS (SELECT *, a <= length(text) AS valid, least(b, length(text)) - a + 1 AS wanted FROM r)
    SELECT doc_id, valid, CASE WHEN valid THEN substr(text, a, least(wanted, 120)) END AS window_text, CASE WHEN valid THEN wanted > 120 END AS truncated FROM v""")  # fmt: skip
def windowed_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges of code points under a cap; a range that begins after the text's end isn't valid."""
    a = (F.lit(1) + F.col("doc_id") % 700).cast("int")
    w = T.window_text(F.col("text"), a, (a + F.col("doc_id") % 300).cast("int"), F.lit(120), F.lit(1000))
    return read(spark, sf_dir, "documents").select("doc_id", w.alias("w")).select("doc_id", "w.valid", F.col("w.window").alias("window_text"), "w.truncated")


@query("excerpts", "SELECT doc_id, substr(text, 1, CASE WHEN source < 'src5' THEN 500 ELSE 280 END) AS excerpt FROM documents")
def excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Excerpts of sources without permission are capped at 280 characters."""
    return read(spark, sf_dir, "documents").select("doc_id", T.excerpt(F.col("text"), F.col("source") < "src5", 500).alias("excerpt"))


@query("document_texts", r"""
    SELECT conv_id, substr(string_agg(text, chr(10) || chr(10) ORDER BY turn, text), 1, 4000) AS text FROM conversations GROUP BY conv_id""")
def document_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's passages in order, joined and cut at 4000 characters: what a reranker reads."""
    parts = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("p"))
    return parts.select("conv_id", F.substring(F.array_join(F.col("p.text"), "\n\n"), 1, 4000).alias("text"))


@query("passages", """
    SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) - 1 AS ordinal,
           coalesce(lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) - 1, max(turn) OVER (PARTITION BY conv_id)) AS end_turn,
           row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS passage_index FROM conversations""")  # fmt: skip
def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordinal among passages of the same heading, end (the next one's start less one, or the document's), index in the document."""
    by_doc = Window.partitionBy("conv_id").orderBy("turn")
    by_head = Window.partitionBy("conv_id", "role").orderBy("turn")
    return read(spark, sf_dir, "conversations").select(
        "conv_id", "turn", (F.row_number().over(by_head) - 1).cast("long").alias("ordinal"),
        F.coalesce(F.lead("turn").over(by_doc) - 1, F.max("turn").over(Window.partitionBy("conv_id"))).alias("end_turn"), (F.row_number().over(by_doc) - 1).cast("long").alias("passage_index"),
    )


@query("canonical_json", """SELECT doc_id, to_json({'doc_id': doc_id, 'lang': lang, 'source': source}) AS body, sha256(to_json({'doc_id': doc_id, 'lang': lang, 'source': source})) AS request_id FROM documents""")
def canonical_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical JSON (keys sorted, no spaces) and the id that is its hash."""
    body = F.to_json(F.struct("doc_id", "lang", "source"))
    return read(spark, sf_dir, "documents").select("doc_id", body.alias("body"), F.sha2(body, 256).alias("request_id"))


@query("extraction_methods", """
    WITH m AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'application/ld+json' WHEN 2 THEN 'text/html' WHEN 3 THEN 'text/csv' WHEN 4 THEN 'image/png' ELSE 'application/json' END AS mime FROM events)
    SELECT event_id, mime, CASE WHEN mime = 'application/pdf' THEN 'pdf_text' WHEN mime LIKE '%+json' OR mime = 'application/json' THEN 'api_json' WHEN mime = 'text/html' THEN 'html_text' WHEN mime LIKE 'text/%' THEN 'raw_lines' ELSE 'unknown' END AS method,
           mime LIKE 'text/%' OR mime LIKE '%+json' OR mime IN ('application/pdf', 'application/json') AS allowed FROM m""")  # fmt: skip
def extraction_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.array(*map(F.lit, ("application/pdf", "application/ld+json", "text/html", "text/csv", "image/png", "application/json")))
    rows = read(spark, sf_dir, "events").select("event_id", F.element_at(kinds, (F.col("event_id") % 6 + 1).cast("int")).alias("mime"))
    return rows.select("event_id", "mime", T.extraction_method(F.col("mime")).alias("method"), T.mime_allowed(F.col("mime")).alias("allowed"))


@query("version_order", """
    WITH v AS (SELECT p_partkey, (p_partkey % 11) || '.' || (p_partkey % 7) || '.' || p_size AS version FROM part), s AS (SELECT *, [x::INT FOR x IN string_split(version, '.')] AS n FROM v)
    SELECT p_partkey, version, n >= [2, 0, 10] AND n <= [9, 3, 0] AS compatible, n < [5, 2, 0] AS below_floor FROM s""")  # fmt: skip
def version_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions compare by number; a window of compatible ones and a rollback floor."""
    rows = read(spark, sf_dir, "part").select("p_partkey", F.concat_ws(".", F.col("p_partkey") % 11, F.col("p_partkey") % 7, "p_size").alias("version"))
    n, at = T.semver(F.col("version")), lambda v: F.array(*(F.lit(int(x)) for x in v.split(".")))
    return rows.select("p_partkey", "version", ((n >= at("2.0.10")) & (n <= at("9.3.0"))).alias("compatible"), (n < at("5.2.0")).alias("below_floor"))
