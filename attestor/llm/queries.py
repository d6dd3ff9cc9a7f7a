"""The queries opN_<name>: each applies its operator to the whole intended table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from attestor import scratch
from attestor.llm import ann, bestfit, infill, mixing, neardup, packing, pii, quality, secrets, sharding, tokenfiles, tokens, warc
from attestor.llm.tables import table, whole_text

_KEY = r"(?i:password|passwd|secret|token|api_?key)[\"'']?\x20*[:=]\x20*[\"'']?"

#: What SQL can express in full. The others (hash rings, tokenizers, samples, trained models, permutations) are held against brute force in tests/llm.
ORACLES: dict[str, str] = {
    "op3_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), d AS (SELECT page_id, strlen(h) AS payload_bytes, sha256(h) AS payload_digest FROM p),
             f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM d)
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to FROM f""",
    "op11_infill": """
        WITH t AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS s FROM documents),
             h AS (SELECT *, list_transform([0, 1, 2, 3], lambda i: ('0x' || substr(s, 8 * i + 1, 8))::BIGINT) AS h FROM t),
             c AS (SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
                          CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 90 THEN 'plain' WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
             p AS (SELECT *, '<P>' || substr(text, 1, a) AS prefix, '<S>' || substr(text, b + 1) AS suffix, '<M>' || substr(text, a + 1, b - a) AS middle FROM c)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN prefix || suffix || middle ELSE suffix || prefix || middle END) AS output_sha256, sha256(text) AS restored_sha256 FROM p""",
    "op10_secrets": f"""
        WITH t AS (SELECT doc_id, replace(coalesce(text, ''), chr(57344), chr(57345)) AS text FROM documents),
             m AS (SELECT doc_id, 0 AS k, regexp_replace(text, '({_KEY}[A-Za-z0-9+/_.=-]+)', chr(57344) || '\\1' || chr(57344), 'g') AS x FROM t
                   UNION ALL SELECT doc_id, 1, regexp_replace(text, '(AKIA[A-Z0-9]+)', chr(57344) || '\\1' || chr(57344), 'g') FROM t
                   UNION ALL SELECT doc_id, 2, regexp_replace(text, '([0-9a-f]+)', chr(57344) || '\\1' || chr(57344), 'g') FROM t),
             s AS (SELECT doc_id, k, generate_subscripts(string_split(x, chr(57344)), 1) AS i, unnest(string_split(x, chr(57344))) AS p FROM m WHERE contains(x, chr(57344))),
             o AS (SELECT doc_id, k, i, p, (sum(length(p)) OVER (PARTITION BY doc_id, k ORDER BY i) - length(p))::BIGINT AS a FROM s),
             g AS (SELECT doc_id, k, a, a + length(p) AS b FROM o WHERE i % 2 = 0 AND CASE k WHEN 0 THEN length(regexp_extract(p, '^{_KEY}([A-Za-z0-9+/_.=-]+)$', 1)) >= 12 WHEN 1 THEN length(p) >= 18 ELSE length(p) >= 16 END),
             c AS (SELECT doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
                          string_agg(['assign', 'access', 'hex'][k + 1] || ':' || a || ':' || b, ',' ORDER BY a, k) AS spans FROM g GROUP BY doc_id)
        SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans FROM t LEFT JOIN c USING (doc_id)""",
}


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents on a ring of 16 shards, counts at most one apart."""
    docs = table(spark, sf_dir, "documents")
    text = whole_text(docs)
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    placed = sharding.assign(rows, "doc_id", 16, ties=("size", "text_crc32"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "home_shard")


def op2_tokencounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of each document, counted in flat token files; the files hold no doc_id, so it comes from the rows' order when they were written, checked by bytes."""
    docs, path = table(spark, sf_dir, "documents"), scratch.new_path(spark, "tokens")
    tokenfiles.write(docs, path, tokenizer=tokens.byte_bpe())
    counted = tokenfiles.counts(spark, path, tokenizer=tokens.byte_bpe())
    # the same scan has the same partitions and order of rows, or the bytes of texts and of ids differ
    place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("nth")
    written = docs.select("doc_id", F.octet_length(whole_text(docs)).alias("text_bytes"), F.spark_partition_id().alias("part"), place)
    both = written.join(counted, ["part", "nth"], "full")
    same = F.assert_true(F.coalesce(F.col("closed") & (F.col("n_bytes") == F.col("text_bytes")), F.lit(False)), F.lit("files and rows differ"))
    return both.where(F.coalesce(same.cast("string"), F.lit("")) == "").select("doc_id", "n_tokens", F.regexp_extract("file", r"[^/]*$", 0).alias("file"), "start")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written to archives and read back."""
    path = scratch.new_path(spark, "warc")
    warc.write(table(spark, sf_dir, "pages"), path)
    return warc.read(spark, path)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as pieces in sequences of 2048 ids."""
    docs = table(spark, sf_dir, "documents")
    return packing.pack(packing.pieces(docs, tokenizer=tokens.byte_bpe()))


def op5_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document."""
    return neardup.classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "kept")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents."""
    return pii.detect(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes."""
    mixed = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "pieces", "first_shard")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and verdicts of all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    judged = quality.judge(docs, keep_text=False)
    return judged.select("doc_id", *quality.STATS, "base_failed", "kept", "distance")


def op9_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of every hundredth vector."""
    rows = table(spark, sf_dir, "embeddings")
    return ann.nearest(rows, rows.where("vec_id % 100 = 0"), 10)


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents, in two increments: a ledger of about half of the blobs, then all documents against that ledger."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ledger = secrets.run(docs.where(F.xxhash64(whole_text(docs)) < 0))[1]
    return secrets.run(docs, ledger)[0].select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def op11_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents cut and put together for filling in, and the text read back from form and output."""
    made = infill.transform(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", F.sha2(infill.restored("form", "output"), 256).alias("restored_sha256"))


def op12_bestfit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as pieces in as few sequences of 2048 ids as best fit needs."""
    return bestfit.pack(bestfit.pieces(table(spark, sf_dir, "documents"), tokenizer=tokens.word_bpe()))


QUERIES = {"op1_sharding": op1_sharding, "op2_tokencounts": op2_tokencounts, "op3_warc": op3_warc, "op4_packing": op4_packing, "op5_neardup": op5_neardup, "op6_pii": op6_pii, "op7_mixing": op7_mixing, "op8_quality": op8_quality, "op9_ann": op9_ann, "op10_secrets": op10_secrets, "op11_infill": op11_infill, "op12_bestfit": op12_bestfit}
