"""Queries of the text operators, one for each, over whole tables, with SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pack(spark: SparkSession, sf_dir: str, vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    from lattica.llm.packing import pack

    if vocabulary is None:
        import public_tokenizers

        vocabulary, pattern = str(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN
    return pack(table(spark, sf_dir, "documents"), vocabulary=vocabulary, pattern=pattern).drop("ids")


def op2_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lattica.llm.near_dup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "first")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lattica.llm.decontaminate import digest, find_contamination

    return digest(find_contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), keep_text=False))


def op4_mtree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lattica.llm.mtree import top_k, whole_numbers

    return top_k(whole_numbers(table(spark, sf_dir, "embeddings")), F.col("vec_id") % 20 == 0)


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lattica.llm.suffix_dedup import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"))


def op6_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lattica.llm.perspective import digest, rotate

    return digest(rotate(table(spark, sf_dir, "conversations")))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lattica.llm.langid import held_out
    from lattica.llm.quality import learn, score

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = learn(docs.where(~held_out(F.col("doc_id"))), table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id"))))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op8_paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lattica.llm.paragraph_dedup import cut_repeats

    cut = cut_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    kept = F.coalesce("text", F.lit(""))
    return cut.select("doc_id", "n_words", "n_removed_words", F.size("spans").cast("long").alias("n_spans"), F.octet_length(kept).cast("long").alias("n_kept_bytes"), F.sha2(kept, 256).alias("kept_sha256"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lattica.llm.langid import held_out, identify, learn

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    filters = learn(docs.where(~held_out(F.col("doc_id"))))
    return identify(docs.select("doc_id", "text"), filters).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op10_token_counts(spark: SparkSession, sf_dir: str, model_path: str | None = None) -> DataFrame:
    from lattica.llm.token_counts import count_tokens

    if model_path is None:
        import public_tokenizers

        model_path = public_tokenizers.path("piece_bpe_32k.model")
    return count_tokens(table(spark, sf_dir, "documents"), str(model_path))


def op11_cap_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lattica.llm.cap_filters import similar_vectors

    return similar_vectors(table(spark, sf_dir, "embeddings"))


def op12_pair_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lattica.llm.pair_maxscore import ranked_search

    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lattica.llm.phrases import collocations

    return collocations(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_pack, op2_order_minhash, op3_decontaminate, op4_mtree_topk, op5_suffix_dedup, op6_perspectives, op7_quality, op8_paragraph_dedup, op9_language, op10_token_counts, op11_cap_filters, op12_pair_maxscore, op13_phrases)}

_WORDS = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

_TERMS = "coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'), [])"

SQL = {
    "op3_decontaminate": f"""
WITH dw AS (SELECT doc_id, coalesce({_WORDS}, []) AS w FROM documents),
bw AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS} AS w FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
win AS (SELECT DISTINCT item_id, array_to_string(list_slice(w, i, i + least(10, len(w)) - 1), ' ') AS g, least(10, len(w)) AS k
        FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM bw WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM win),
dg AS (SELECT doc_id, k, i, array_to_string(list_slice(w, i, i + k - 1), ' ') AS g
       FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM dw, ks WHERE len(w) >= k)),
hit AS (SELECT dg.doc_id, dg.i, dg.k, win.item_id FROM dg JOIN win ON dg.g = win.g AND dg.k = win.k),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)""",
    "op4_mtree_topk": """
WITH v AS (SELECT row_number() OVER (ORDER BY vec_id) AS n, vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.n, q.vec_id AS query_id, d.vec_id, CAST(list_dot_product(q.v, d.v) AS BIGINT) AS score FROM v q JOIN v d ON q.vec_id % 20 = 0 AND d.n <> q.n),
r AS (SELECT *, row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id) AS rn FROM s)
SELECT query_id, CAST(rn AS INTEGER) AS rank, vec_id, score FROM r WHERE rn <= 20""",
    "op6_perspectives": """
WITH base AS (SELECT DISTINCT conv_id, coalesce(turn, 9223372036854775807) AS turn,
                CASE WHEN length(trim(role)) > 0 THEN trim(role) ELSE 'unknown' END AS speaker, coalesce(text, '') AS text FROM conversations),
p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, speaker, md5(text)) - 1 AS idx FROM base),
who AS (SELECT DISTINCT conv_id, speaker FROM base),
r AS (SELECT p.conv_id, who.speaker, p.idx, p.text, p.speaker = who.speaker AS own,
        CASE WHEN p.speaker = who.speaker THEN '<|assistant|>' || chr(10) ELSE '<|user name=' || p.speaker || '|>' || chr(10) END AS head
      FROM p JOIN who ON p.conv_id IS NOT DISTINCT FROM who.conv_id),
o AS (SELECT *, sum(length(head) + length(text) + 1) OVER (PARTITION BY conv_id, speaker ORDER BY idx) - length(text) - 1 AS begin_at FROM r)
SELECT conv_id, speaker, CAST(idx // 64 AS BIGINT) AS piece, count(*) AS n_turns, CAST(min(begin_at - length(head)) AS BIGINT) AS "start",
  CAST(sum(length(head) + length(text) + 1) AS BIGINT) AS n_chars, CAST(sum(CASE WHEN own THEN length(text) ELSE 0 END) AS BIGINT) AS n_own_chars,
  sha256(string_agg(head || text || chr(10), '' ORDER BY idx)) AS text_sha256,
  coalesce(string_agg(CAST(CAST(begin_at AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(begin_at AS BIGINT) + length(text) AS VARCHAR), ',' ORDER BY idx) FILTER (WHERE own AND length(text) > 0), '') AS mask
FROM o GROUP BY conv_id, speaker, idx // 64""",
    "op11_cap_filters": """
WITH RECURSIVE e AS (SELECT row_number() OVER (ORDER BY vec_id) AS n, vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
ok AS (SELECT n, vec_id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS u FROM e
       WHERE v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
link AS (SELECT a.n, b.n AS m, b.vec_id AS other FROM ok a JOIN ok b ON a.n <> b.n AND list_dot_product(a.u, b.u) >= 0.9),
reach(n, m) AS (SELECT n, n FROM e UNION SELECT reach.n, link.m FROM reach JOIN link ON link.n = reach.m),
comp AS (SELECT reach.n, min(e.vec_id) AS component_id FROM reach JOIN e ON e.n = reach.m GROUP BY 1),
cnt AS (SELECT n, count(*) AS k FROM link GROUP BY 1)
SELECT vec_id, coalesce(k, 0) AS n_links, component_id, coalesce(vec_id = component_id, false) AS kept FROM e JOIN comp USING (n) LEFT JOIN cnt USING (n)""",
    "op12_pair_maxscore": f"""
WITH d AS (SELECT row_number() OVER () AS dn, doc_id, {_TERMS} AS w FROM documents),
st AS (SELECT count(*) FILTER (WHERE len(w) > 0) AS nn, CAST(sum(len(w)) AS BIGINT) AS ll FROM d),
tf AS (SELECT dn, t, count(*) AS tf FROM (SELECT dn, unnest(w) AS t FROM d) GROUP BY ALL),
df AS (SELECT t, count(*) AS df FROM tf GROUP BY 1),
wt AS (SELECT t, CAST(floor(1000 * ln((2 * nn + 2) / (2 * df + 1))) AS BIGINT) AS w FROM df, st),
m AS (SELECT dn, doc_id, 50 + (50 * len(w) * nn) // ll AS m FROM d, st WHERE len(w) > 0),
q AS (SELECT row_number() OVER () AS qn, item_id, text FROM (SELECT DISTINCT item_id, text FROM benchmark)),
qt AS (SELECT DISTINCT qn, item_id, unnest({_TERMS}) AS t FROM q),
s AS (SELECT qn, item_id, doc_id, dn, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score
      FROM qt JOIN tf USING (t) JOIN wt USING (t) JOIN m USING (dn) GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY qn ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM rk WHERE rank <= 50""",
    "op13_phrases": """
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM p),
tot AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY 1),
g AS (SELECT lang, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS phrase
      FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (VALUES (1), (2), (3), (4)) AS t(k) WHERE len(w) >= k)),
f AS (SELECT lang, k AS size, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 30),
c AS (SELECT lang, phrase, f AS a, size, string_split(phrase, ' ') AS w FROM f WHERE size > 1),
cut AS (SELECT lang, phrase, a, k, array_to_string(list_slice(w, 1, k), ' ') AS p1, array_to_string(list_slice(w, k + 1, size), ' ') AS p2
        FROM (SELECT *, unnest(range(1, size)) AS k FROM c)),
sc AS (SELECT cut.lang, cut.phrase, cut.a, k, f1.f AS l, f2.f AS r, CAST((2000000::HUGEINT * cut.a) // (f1.f::HUGEINT + f2.f) AS BIGINT) AS score
       FROM cut JOIN f f1 ON f1.lang = cut.lang AND f1.phrase = p1 JOIN f f2 ON f2.lang = cut.lang AND f2.phrase = p2),
best AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS rn FROM sc),
inn AS (SELECT lang, array_to_string(list_slice(w, i, i + m - 1), ' ') AS phrase, max(a) AS longer
        FROM (SELECT lang, w, a, m, unnest(range(1, size - m + 2)) AS i FROM c, (VALUES (2), (3)) AS t(m) WHERE m < size) GROUP BY ALL),
kept AS (SELECT best.* FROM best LEFT JOIN inn USING (lang, phrase) WHERE rn = 1 AND (longer IS NULL OR 100::HUGEINT * longer < 80::HUGEINT * a)),
rk AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM rk JOIN tot USING (lang) WHERE rank <= 2000""",
}
