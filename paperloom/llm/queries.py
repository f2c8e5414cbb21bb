"""The queries ``opN_<name>`` over the driver's tables, and the SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from ..tables import spread
from . import decontaminate, ngram_join, pii, quality, secrets, sharding, token_counts, token_store, unigram, urls
from .common import table


def documents(spark, sf_dir):
    return spread(table(spark, sf_dir, "documents"))


def op1_candidate_boosting(spark, sf_dir):
    return pii.find(documents(spark, sf_dir))


def op2_content_addressed(spark, sf_dir):
    docs = documents(spark, sf_dir)
    path = token_store.write(docs, public_tokenizers.path("byte_bpe_50k.json"))
    token_store.verify(spark, path)
    return token_store.digests(spark, path)


def op3_seed_and_align(spark, sf_dir):
    return decontaminate.leaks(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op4_virtual_slots(spark, sf_dir):
    return sharding.shard(documents(spark, sf_dir))


def op5_distribution_divergence(spark, sf_dir):
    return quality.judge(documents(spark, sf_dir))


def op6_entropy_secrets(spark, sf_dir):
    return secrets.scan(documents(spark, sf_dir))


def op7_overlap_resync(spark, sf_dir):
    return token_counts.count_tokens(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op8_unigram_viterbi(spark, sf_dir):
    return unigram.encode_documents(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op9_redirect_equivalence(spark, sf_dir):
    return urls.judge(spread(table(spark, sf_dir, "pages")))


def op10_ngram_jaccard(spark, sf_dir):
    return ngram_join.join(documents(spark, sf_dir))


# What SQL can express of the operators' results, with the same operators behind it -----------


def quality_base_counts(spark, sf_dir):
    """op5's counts and base rules."""
    return quality.judge(documents(spark, sf_dir)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def shard_sizes(spark, sf_dir):
    """op4's sizes, and that every record has one place: how many records, shards and distinct places there are."""
    placed = sharding.shard(documents(spark, sf_dir))
    counts = F.count("*").alias("n"), F.sum("size").alias("bytes"), F.count_distinct("shard").alias("shards"), F.count_distinct("shard", "slot").alias("places")
    return placed.agg(*counts)


def text_bytes(spark, sf_dir):
    """op7's sizes."""
    return token_counts.count_tokens(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json")).select("doc_id", "n_bytes")


def url_rules(spark, sf_dir):
    """op9's hosts, paths and rules, and the verdicts of rules."""
    judged = urls.judge(spread(table(spark, sf_dir, "pages")))
    return judged.select("page_id", "host", "path", "rule", F.when(F.col("rule").isNotNull(), F.col("verdict")).alias("own"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_candidate_boosting,
        op2_content_addressed,
        op3_seed_and_align,
        op4_virtual_slots,
        op5_distribution_divergence,
        op6_entropy_secrets,
        op7_overlap_resync,
        op8_unigram_viterbi,
        op9_redirect_equivalence,
        op10_ngram_jaccard,
        quality_base_counts,
        shard_sizes,
        text_bytes,
        url_rules,
    )
}

_FITS = " ".join(
    f"WHEN (host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}') THEN '{host + path}:{verdict}'"
    for host, path, verdict in sorted(urls.RULES, key=lambda r: -len(r[0] + r[1]))
)
ORACLES: dict[str, str] = {
    "quality_base_counts": r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), l AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
 w AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM l),
 g AS (SELECT doc_id, i, word || ' ' || lead(word, 1) OVER x || ' ' || lead(word, 2) OVER x AS gram FROM w WINDOW x AS (PARTITION BY doc_id ORDER BY i)),
 r AS (SELECT doc_id, i FROM g WHERE gram IS NOT NULL QUALIFY count(*) OVER (PARTITION BY doc_id, gram) > 1),
 c AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM r, (VALUES (0), (1), (2)) AS v(k) GROUP BY doc_id),
 n AS (SELECT l.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  list_filter(string_split(t, chr(10)), lambda y: regexp_matches(y, '[^\x20\x09-\x0D]')) AS ls, coalesce(c.n, 0) AS n_repeat_words FROM l LEFT JOIN c ON l.doc_id = c.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM n""",
    "shard_sizes": "SELECT count(*) AS n, CAST(sum(octet_length(encode(coalesce(text, ''))) + 16) AS BIGINT) AS bytes, 40 AS shards, count(*) AS places FROM documents",
    "text_bytes": "SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n_bytes FROM documents",
    "url_rules": rf"""WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
 p AS (SELECT page_id, lower(regexp_extract(rest, '^[^/?#]*')) AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u), f AS (SELECT *, CASE {_FITS} END AS fit FROM p)
SELECT page_id, host, path, split_part(fit, ':', 1) AS rule, split_part(fit, ':', 2) AS own FROM f""",
}
