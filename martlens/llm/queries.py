"""The operators over their whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from martlens.llm.bpe import encode_decode
from martlens.llm.filteraudit import filter_audit
from martlens.llm.htmltext import extract
from martlens.llm.inputs import read, ready
from martlens.llm.linededup import drop_common_lines
from martlens.llm.multisethash import compare_with_next
from martlens.llm.neighbours import nearest
from martlens.llm.packing import pack
from martlens.llm.quality import score_quality
from martlens.llm.simhash import near_duplicates
from martlens.llm.spelling import spelling_variants
from martlens.llm.suffixdedup import remove_repeats
from martlens.llm.tokencounts import count_tokens
from martlens.llm.topk import top_k, whole_steps
from martlens.llm.vectors import named_vectors
from martlens.llm.wordtokens import version
from martlens.session import shared_path

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def add(query: Query) -> Query:
        QUERIES[name] = lambda spark, sf_dir: query(ready(spark), sf_dir)
        if sql is not None:
            ORACLE[name] = sql.strip()
        return query

    return add


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@register("op2_token_counts")
def token_counts(spark, sf_dir):
    """Tokens of every document; the cache lasts as long as the shared folder."""
    path = tokenizer_file("word_bpe_49k.json")
    cache = shared_path(spark, f"token-cache-{version(path)[:16]}")
    return count_tokens(read(spark, sf_dir, "documents"), path, cache)


@register("op9_best_fit_packing")
def best_fit_packing(spark, sf_dir):
    return pack(read(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


@register("op10_bpe_round_trip")
def bpe_round_trip(spark, sf_dir):
    return encode_decode(
        read(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), digests_only=True
    )


@register("op1_suffix_array_dedup")
def suffix_array_dedup(spark, sf_dir):
    return remove_repeats(read(spark, sf_dir, "documents"), 100, texts=False)


@register("op3_simhash_near_dedup")
def simhash_near_dedup(spark, sf_dir):
    found = near_duplicates(read(spark, sf_dir, "documents"), shingle=3, distance=2)
    return found.select("doc_id", "fingerprint", "component_id")


LINES_SQL = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS line_key
  FROM lines
), common AS (
  SELECT line_key FROM keyed WHERE length(line_key) >= 1
  GROUP BY line_key HAVING count(DISTINCT doc_id) >= 10
), marked AS (
  SELECT k.*, c.line_key IS NOT NULL AS gone
  FROM keyed k LEFT JOIN common c ON k.line_key = c.line_key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), ''))
         AS kept_sha256
FROM marked GROUP BY doc_id
"""


@register("op7_line_dedup", LINES_SQL)
def line_dedup(spark, sf_dir):
    """Lines that ten documents share go; documents are known by ``doc_id``."""
    cleaned = drop_common_lines(
        read(spark, sf_dir, "documents").select("doc_id", "text"), least_docs=10, least_chars=1
    )
    return cleaned.select("doc_id", "n_lines", "n_dropped", "kept_sha256")


TOP_SQL = """
WITH flat AS (
  SELECT vec_id, generate_subscripts(embedding, 1) AS pos, unnest(embedding) AS x
  FROM embeddings WHERE vec_id IS NOT NULL
), good AS (
  SELECT vec_id FROM flat GROUP BY vec_id HAVING bool_and(coalesce(isfinite(x), false))
), vectors AS (
  SELECT vec_id, [floor(64 * x::DOUBLE) FOR x IN embedding] AS v
  FROM embeddings WHERE vec_id IN (SELECT vec_id FROM good)
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM vectors q JOIN vectors c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank
  FROM scored
) WHERE rank <= 20
"""


@register("op4_exact_top_k", TOP_SQL)
def exact_top_k(spark, sf_dir):
    rows = whole_steps(read(spark, sf_dir, "embeddings"))
    return top_k(rows, rows.filter(F.col("vec_id") % 20 == 0), k=20)


@register("op5_nearest_neighbours")
def nearest_neighbours(spark, sf_dir):
    rows = named_vectors(read(spark, sf_dir, "embeddings"))
    return nearest(rows, rows.filter(F.col("vec_id") % 20 == 0), k=20)


@register("op6_html_main_text")
def html_main_text(spark, sf_dir):
    return extract(read(spark, sf_dir, "pages"))


@register("op8_quality_classifier")
def quality_classifier(spark, sf_dir):
    scored = score_quality(
        read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "labels")
    )
    return scored.select("doc_id", "held_out", "score", "predicted")


@register("op12_spelling_variants")
def spelling(spark, sf_dir):
    return spelling_variants(read(spark, sf_dir, "documents"), drop_every=31)


AUDIT_SQL = r"""
WITH docs AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS body FROM documents
), worded AS (
  SELECT *, [w FOR w IN string_split_regex(body, '[\x20\x09-\x0D]+') IF w <> ''] AS words
  FROM docs
), masked AS (
  SELECT doc_id, part,
         CASE WHEN len(words) < 50 THEN 1 ELSE 0 END
         + CASE WHEN 100 * len(list_distinct(words)) < 65 * len(words) THEN 2 ELSE 0 END
         + CASE WHEN 100 * length(regexp_replace(body, '[^A-Z]+', '', 'g')) > 5 * length(body)
                THEN 4 ELSE 0 END
         + CASE WHEN regexp_matches(body, '[#$%&*|]') THEN 8 ELSE 0 END
         + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY body) THEN 16 ELSE 0 END AS mask
  FROM worded
), marks AS (
  SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic
  FROM labels GROUP BY doc_id
), cells AS (
  SELECT part, mask, count(*) AS docs, sum(coalesce(good, 0)) AS good,
         sum(coalesce(toxic, 0)) AS toxic
  FROM masked LEFT JOIN marks USING (doc_id) GROUP BY part, mask
), states AS (
  SELECT part, s.chosen, coalesce(sum(docs) FILTER (mask & s.chosen = 0), 0) AS docs,
         coalesce(sum(good) FILTER (mask & s.chosen = 0), 0) AS good,
         coalesce(sum(toxic) FILTER (mask & s.chosen = 0), 0) AS toxic
  FROM cells, (SELECT unnest(range(32)) AS chosen) s GROUP BY part, s.chosen
), letters AS (
  SELECT i, substr('ABCDE', i + 1, 1) AS letter FROM (SELECT unnest(range(5)) AS i)
), orders AS (
  SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE a.i NOT IN (b.i, c.i, d.i, e.i) AND b.i NOT IN (c.i, d.i, e.i)
    AND c.i NOT IN (d.i, e.i) AND d.i <> e.i
), steps AS (
  SELECT filter_order, step, 1 << (strpos('ABCDE', substr(filter_order, step, 1)) - 1) AS own,
         list_sum([1 << (strpos('ABCDE', substr(filter_order, k, 1)) - 1)
                   FOR k IN range(1, step + 1)]) AS after
  FROM orders, (SELECT CAST(unnest(range(1, 6)) AS INTEGER) AS step)
), counted AS (
  SELECT x.part, filter_order, step, own, y.docs AS kept, x.docs - y.docs AS removed,
         n.docs - o.docs - (x.docs - y.docs) AS redundant, coalesce(u.docs, 0) AS unique_fails,
         x.good - y.good AS good_lost, x.toxic - y.toxic AS toxic_lost
  FROM steps s
  JOIN states x ON x.chosen = s.after - s.own
  JOIN states y ON y.chosen = s.after AND y.part = x.part
  JOIN states n ON n.chosen = 0 AND n.part = x.part
  JOIN states o ON o.chosen = s.own AND o.part = x.part
  LEFT JOIN cells u ON u.mask = s.own AND u.part = x.part
)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed,
       redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
       good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
       (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley
FROM counted
"""


@register("op11_filter_audit", AUDIT_SQL)
def audit(spark, sf_dir):
    return filter_audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@register("op13_document_fingerprints")
def document_fingerprints(spark, sf_dir):
    return compare_with_next(read(spark, sf_dir, "documents"), texts=False)
