"""Corpus, retrieval, similarity and dataset queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import corpus, postings, similarity, vectors
from tidemark.plans.registry import query, statement
from tidemark.session import Scratch, cut, table

_TOK = "list_filter(regexp_split_to_array(lower({0}), '[\\s.,!?|]+'), lambda w: w <> '')"


@query("""
    WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \n]+'), lambda w: w <> '') AS w FROM documents),
    c AS (SELECT doc_id, w, unnest(range(0, greatest(0, CAST(ceil((len(w) - 64) / 48.0) AS bigint)) + 1)) AS chunk FROM w WHERE len(w) > 0)
    SELECT doc_id, CAST(chunk AS int) AS chunk, array_to_string(w[chunk * 48 + 1 : chunk * 48 + 64], ' ') AS text FROM c""")
def word_chunks_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.chunks(table(spark, sf_dir, "documents"))


def _queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All distinct tokens of each item."""
    bench = table(spark, sf_dir, "benchmark")
    return bench.select(F.col("item_id").alias("query_id"), F.expr(f"array_distinct({corpus.tokens('text')})").alias("terms")).where("size(terms) > 0")


_BM25 = f"""
    q AS (SELECT item_id AS query_id, list_distinct({_TOK.format('text')}) AS terms FROM benchmark), t AS (SELECT query_id, unnest(terms) AS term FROM q), need AS (SELECT query_id, count(*) AS need FROM t GROUP BY 1),
    s AS (SELECT doc_id, {_TOK.format('text')} AS w FROM documents), st AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM s), p AS (SELECT doc_id, len(w) AS dl, unnest(w) AS term FROM s),
    tf AS (SELECT term, doc_id, dl, count(*) AS tf FROM p WHERE term IN (SELECT term FROM t) GROUP BY 1, 2, 3), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
    sc AS (SELECT query_id, doc_id, round(sum(ln(1 + (n - df + 5e-1) / (df + 5e-1)) * tf * 22e-1 / (tf + 12e-1 * (25e-2 + 75e-2 * dl / mean))), 6) AS score, count(*) AS met FROM tf JOIN df USING (term) JOIN t USING (term) CROSS JOIN st GROUP BY 1, 2),
    lex AS (SELECT * FROM (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM sc JOIN need USING (query_id) WHERE met = need) r WHERE rank <= 10)"""


@query(f"WITH {_BM25} SELECT query_id, doc_id, score, CAST(rank AS int) AS rank FROM lex")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.bm25(table(spark, sf_dir, "documents"), _queries(spark, sf_dir), 10)


_DENSE = """
    v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), dense AS (SELECT * FROM (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM
      (SELECT a.vec_id AS query_id, b.vec_id AS doc_id, round(list_cosine_similarity(a.e, b.e), 6) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0) x) r WHERE rank <= 10)"""


def _dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fiftieth vector against all rows."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return similarity.nearest(rows, rows.where("id % 50 = 0"), 10)


@query(f"WITH {_DENSE} SELECT query_id, doc_id, score, CAST(rank AS int) AS rank FROM dense")
def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dense(spark, sf_dir)


_INDEXED = r"""
    q AS (SELECT item_id AS query_id, list_distinct(regexp_extract_all(strip_accents(replace(lower(coalesce(text, '')), 'ß', 'ss')), '[\pL\pN\p{Co}_-]+')) AS terms FROM benchmark), t AS (SELECT query_id, unnest(terms) AS term FROM q), need AS (SELECT query_id, count(*) AS need FROM t GROUP BY 1),
    s AS (SELECT doc_id, regexp_extract_all(strip_accents(replace(lower(coalesce(text, '')), 'ß', 'ss')), '[\pL\pN\p{Co}_-]+') AS w FROM documents), st AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM s), p AS (SELECT doc_id, len(w) AS dl, unnest(w) AS term FROM s),
    tf AS (SELECT term, doc_id, dl, count(*) AS tf FROM p WHERE term IN (SELECT term FROM t) GROUP BY 1, 2, 3), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
    sc AS (SELECT query_id, doc_id, round(sum(ln(1 + (n - df + 5e-1) / (df + 5e-1)) * tf * 22e-1 / (tf + 12e-1 * (25e-2 + 75e-2 * dl / mean))), 6) AS score, count(*) AS met FROM tf JOIN df USING (term) JOIN t USING (term) CROSS JOIN st GROUP BY 1, 2)"""


@query(f"WITH {_INDEXED} SELECT query_id, doc_id, score, CAST(rank AS int) AS rank FROM (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM sc JOIN need USING (query_id) WHERE met = need) r WHERE rank <= 10")
def postings_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents with all words of each item, by an inverted index that is built, read back and searched."""
    docs, items = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    with Scratch(spark) as scratch:
        postings.build(docs, scratch.top, "first")
        return cut(postings.search(postings.opened(spark, scratch.top), items, 10)[0])


def _indexed(spark: SparkSession, sf_dir: str, exact: bool) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    dims = rows.select(F.size("v").alias("n")).where("n > 0").first()
    with Scratch(spark) as scratch:
        index = vectors.build(rows, f"{scratch.top}/vectors", dims.n if dims else 1)
        return cut(vectors.search(index, rows.where("id % 50 = 0"), 10, exact=exact))


@query()
def vector_index_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours of every fiftieth vector by the cells nearest to it; tests measure the recall."""
    return _indexed(spark, sf_dir, exact=False)


@query(f"WITH {_DENSE} SELECT query_id, doc_id, score, CAST(rank AS int) AS rank FROM dense")
def vector_index_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by all cells that can still hold a nearer one."""
    return _indexed(spark, sf_dir, exact=True)


_FUSED = """f AS (SELECT coalesce(dense.query_id, lex.query_id) AS query_id, coalesce(dense.doc_id, lex.doc_id) AS doc_id, dense.score AS semantic, lex.score AS lexical,
      round(coalesce(1e0 / (60 + dense.rank), 0) + coalesce(1e0 / (60 + lex.rank), 0), 9) AS fused FROM dense FULL JOIN lex ON dense.query_id = lex.query_id AND dense.doc_id = lex.doc_id)"""


@query(f"WITH {_BM25}, {_DENSE}, {_FUSED} SELECT query_id, doc_id, semantic, lexical, fused, CAST(row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, semantic DESC NULLS LAST, doc_id) AS int) AS place FROM f")
def rrf_full_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    fused = corpus.reciprocal_rank_fusion(_dense(spark, sf_dir), corpus.bm25(table(spark, sf_dir, "documents"), _queries(spark, sf_dir), 10))
    ranked = similarity.top_k(fused, ["query_id"], [F.desc("fused"), F.desc_nulls_last("semantic"), F.col("doc_id")], 1 << 30)
    return ranked.select("query_id", "doc_id", "semantic", "lexical", "fused", F.col("rank").alias("place"))


_RERANK = f"""g AS (SELECT f.*, d.source, row_number() OVER (PARTITION BY query_id, d.source ORDER BY fused DESC, semantic DESC NULLS LAST, f.doc_id) AS k, {_TOK.format('d.text')} AS w, d.text AS body, d.lang, q.terms, i.text AS asked FROM f JOIN documents d ON f.doc_id = d.doc_id JOIN q USING (query_id) JOIN benchmark i ON i.item_id = f.query_id),
    h AS (SELECT query_id, doc_id, round(fused + 35e-2 * len(list_intersect(list_distinct(w), terms)) / len(terms) + CASE WHEN contains(lower(body), lower(asked)) THEN 35e-2 ELSE 0e0 END + 15e-2 * len(list_intersect(regexp_split_to_array(lower(coalesce(source, '')), '[^a-z0-9]+'), terms)) / len(terms) + CASE WHEN lang = 'en' THEN 1e-1 ELSE 0e0 END + CASE WHEN k = 1 THEN 5e-2 ELSE 0e0 END, 9) AS rerank, fused, semantic, lexical FROM g)"""


@query(f"WITH {_BM25}, {_DENSE}, {_FUSED}, {_RERANK} SELECT query_id, doc_id, rerank, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rerank DESC, fused DESC, semantic DESC NULLS LAST, lexical DESC NULLS LAST, doc_id) AS int) AS place FROM h")
def rerank_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fused hits by coverage, phrase, title (here the source's words), type, and first of its source."""
    docs = table(spark, sf_dir, "documents")
    asked = _queries(spark, sf_dir).join(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("asked")), "query_id")
    fused = cut(corpus.reciprocal_rank_fusion(_dense(spark, sf_dir), corpus.bm25(docs, _queries(spark, sf_dir), 10)).where("doc_id is not null"))
    rows = fused.join(corpus.those(docs, fused.select("doc_id")).select("doc_id", "source", "lang", "text", F.expr(corpus.tokens("text")).alias("w")), "doc_id").join(asked, "query_id")
    rows = similarity.top_k(rows, ["query_id", "source"], [F.desc("fused"), F.desc_nulls_last("semantic"), F.col("doc_id")], 1 << 30)
    share = lambda words: F.size(F.array_intersect(words, "terms")) / F.size("terms")
    title = F.split(F.lower(F.coalesce("source", F.lit(""))), "[^a-z0-9]+")
    given = lambda test, worth: F.when(test, worth).otherwise(0.0)
    score = F.col("fused") + 0.35 * share(F.array_distinct("w")) + given(F.contains(F.lower("text"), F.lower("asked")), 0.35) + 0.15 * share(title) + given(F.col("lang") == "en", 0.1) + given(F.col("rank") == 1, 0.05)
    rows = rows.select("query_id", "doc_id", F.round(score, 9).alias("rerank"), "fused", "semantic", "lexical")
    ranked = similarity.top_k(rows, ["query_id"], [F.desc("rerank"), F.desc("fused"), F.desc_nulls_last("semantic"), F.desc_nulls_last("lexical"), F.col("doc_id")], 1 << 30)
    return ranked.select("query_id", "doc_id", "rerank", F.col("rank").alias("place"))


@query(f"""WITH {_BM25}, {_DENSE}, l AS (SELECT vec_id, label FROM embeddings), x AS (SELECT d.query_id, d.rank, a.label = b.label AS hit FROM dense d JOIN l a ON d.query_id = a.vec_id JOIN l b ON d.doc_id = b.vec_id),
    y AS (SELECT query_id, sum(CASE WHEN hit THEN 1 ELSE 0 END) / 10e0 AS recall, max(CASE WHEN hit THEN 1e0 / rank ELSE 0e0 END) AS rr, max(CASE WHEN hit AND rank = 1 THEN 1e0 ELSE 0e0 END) AS first_hit FROM x GROUP BY 1)
    SELECT count(*) AS n, round(avg(recall), 6) AS precision_at_10, round(avg(rr), 6) AS mrr, round(avg(first_hit), 6) AS exact_hit FROM y""")
def recall_mrr(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    rows = _dense(spark, sf_dir).join(labels.select(F.col("vec_id").alias("query_id"), F.col("label").alias("want")), "query_id").join(labels.select(F.col("vec_id").alias("doc_id"), "label"), "doc_id")
    each = rows.withColumn("hit", F.col("want") == F.col("label")).groupBy("query_id").agg((F.count_if("hit") / 10).alias("recall"), F.max(F.when(F.col("hit"), 1.0 / F.col("rank")).otherwise(0.0)).alias("rr"), F.max(F.when(F.col("hit") & (F.col("rank") == 1), 1.0).otherwise(0.0)).alias("first_hit"))
    return each.agg(F.count("*").alias("n"), F.round(F.avg("recall"), 6).alias("precision_at_10"), F.round(F.avg("rr"), 6).alias("mrr"), F.round(F.avg("first_hit"), 6).alias("exact_hit"))


_EXACT = r"""k AS (SELECT doc_id, sha256(trim(regexp_replace(lower(text), '[\s.,!?|]+', ' ', 'g'))) AS h FROM documents), ex AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY h) AS kept FROM k)"""


@query(f"WITH {_EXACT} SELECT doc_id, kept FROM ex")
def exact_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.exact_duplicates(table(spark, sf_dir, "documents"))


_SHINGLES = f"""w AS (SELECT d.doc_id, {_TOK.format('d.text')} AS w FROM documents d JOIN ex ON d.doc_id = ex.doc_id AND ex.kept = ex.doc_id), s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5) u),
    fp AS (SELECT doc_id, string_agg(x, '|' ORDER BY x) AS h, count(*) AS m FROM s GROUP BY 1), rep AS (SELECT min(doc_id) AS doc_id, any_value(m) AS m FROM fp GROUP BY h), r AS (SELECT s.* FROM s JOIN rep USING (doc_id)),
    i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM r a JOIN r b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2), pairs AS (SELECT a, b, k / (x.m + y.m - k) AS jaccard FROM i JOIN rep x ON a = x.doc_id JOIN rep y ON b = y.doc_id WHERE k / (x.m + y.m - k) >= 9e-1)"""


@query(f"WITH {_EXACT}, {_SHINGLES} SELECT a, b, round(jaccard, 6) AS jaccard FROM pairs")
def shingle_jaccard_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.shingle_pairs(table(spark, sf_dir, "documents")).withColumn("jaccard", F.round("jaccard", 6))


@query(f"""WITH RECURSIVE {_EXACT}, {_SHINGLES}, same AS (SELECT doc_id AS a, min(doc_id) OVER (PARTITION BY h) AS b FROM fp), links AS (SELECT a, b FROM pairs UNION ALL SELECT a, b FROM same WHERE a <> b),
    e AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links), reach AS (SELECT a AS node, a AS seen FROM e UNION SELECT reach.node, e.b FROM reach JOIN e ON reach.seen = e.a), roots AS (SELECT node, min(seen) AS root FROM reach GROUP BY 1)
    SELECT ex.doc_id, coalesce(root, kept) AS cluster FROM ex LEFT JOIN roots ON kept = node""")
def duplicate_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.duplicate_clusters(table(spark, sf_dir, "documents"))


@query("""WITH g AS (SELECT DISTINCT source FROM documents), p AS (SELECT source, CAST(('0x' || sha256(source)[1:8]) AS bigint) % 100 AS point FROM g)
    SELECT source, CASE WHEN point < 70 THEN 'train' WHEN point < 85 THEN 'validation' ELSE 'test' END AS split FROM p""")
def grouped_hash_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.grouped_hash_split(table(spark, sf_dir, "documents"), "source")


_PROFILE = """long AS (SELECT vec_id, label, i - 1 AS dim, CASE WHEN abs(embedding[i]) > 2e-2 THEN embedding[i]::double END AS x FROM (SELECT *, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings) u),
    mid AS (SELECT label, dim, count(*) AS n, quantile_cont(x, 0.5::double) AS median, quantile_cont(x, 0.75::double) - quantile_cont(x, 0.25::double) AS iqr FROM long WHERE x IS NOT NULL GROUP BY 1, 2),
    mad AS (SELECT label, dim, 14826e-4 * quantile_cont(abs(x - median), 0.5::double) AS mad FROM long JOIN mid USING (label, dim) WHERE x IS NOT NULL GROUP BY 1, 2),
    prof AS (SELECT mid.*, mad, CASE WHEN iqr > 1e-9 THEN iqr WHEN mad > 1e-9 THEN mad ELSE 1e0 END AS scale FROM mid JOIN mad USING (label, dim))"""


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.expr("transform(embedding, x -> if(abs(x) > 2e-2, cast(x as double), null))").alias("v"))


@query(f"WITH {_PROFILE} SELECT label, CAST(dim AS int) AS dim, n, round(median, 6) AS median, round(iqr, 6) AS iqr, round(mad, 6) AS mad, round(scale, 6) AS scale FROM prof")
def robust_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = similarity.robust_profile(_vectors(spark, sf_dir), "label", "v")
    return p.select("label", "dim", "n", *[F.round(c, 6).alias(c) for c in ("median", "iqr", "mad", "scale")])


@query(f"""WITH {_PROFILE}, z AS (SELECT vec_id, label, dim, greatest(-8e0, least(8e0, (x - median) / scale)) AS z FROM long JOIN prof USING (label, dim) WHERE x IS NOT NULL),
    d AS (SELECT a.vec_id AS query_id, b.vec_id AS doc_id, sqrt(sum((1 + a.dim % 3) * (a.z - b.z) * (a.z - b.z)) / sum(1 + a.dim % 3)) AS distance FROM z a JOIN z b ON a.label = b.label AND a.dim = b.dim AND a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0 GROUP BY 1, 2 HAVING count(*) >= 32)
    SELECT query_id, doc_id, distance, likeness, CAST(rank AS int) AS rank FROM (SELECT query_id, doc_id, round(distance, 6) AS distance, round(1 / (1 + distance), 6) AS likeness, row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 6), doc_id) AS rank FROM d) r WHERE rank <= 5""")
def masked_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest members of the same cohort, for every fiftieth vector, over dimensions both have."""
    rows = _vectors(spark, sf_dir)
    rows = similarity.normalised(rows, similarity.robust_profile(rows, "label", "v"), "label", "v")
    members = rows.select(F.col("label").alias("by"), F.col("vec_id").alias("id"), F.lit(0).alias("prefer"), "v")
    found = similarity.masked_nearest(members, members.where("id % 50 = 0").select("by", "id", "v"), 5, weights=lambda i: 1.0 + i % 3, apart=True)
    return found.select("query_id", F.col("id").alias("doc_id"), "distance", F.round(1 / (1 + F.col("d")), 6).alias("likeness"), "rank")


# versions, statistics as of a time, dataset assembly and sinks as relations
statement("outcome_stats_asof", """
    WITH known AS (SELECT * FROM (SELECT decision_id, horizon, flag, cost, us, row_number() OVER (PARTITION BY decision_id, horizon ORDER BY us DESC, part DESC, lag DESC) AS rn FROM evals WHERE us <= 868320000000000) v WHERE rn = 1)
    SELECT flag, count(*) AS n, round(avg(CASE WHEN cost > 0 THEN 1e0 ELSE 0e0 END), 6) AS positive, round(avg(CASE WHEN cost < 0 THEN 1e0 ELSE 0e0 END), 6) AS negative, round(avg(cost), 4) AS mean, round(median(cost), 4) AS median, round(@p(cost, 0.95), 4) AS p95 FROM known GROUP BY flag""")
statement("latest_per_key", "SELECT decision_id, horizon, part FROM (SELECT decision_id, horizon, part, row_number() OVER (PARTITION BY decision_id, horizon ORDER BY us DESC, part DESC, lag DESC) AS rn FROM evals) q WHERE rn = 1")
statement("top_missed", "SELECT decision_id, horizon, round(cost, 4) AS cost FROM evals WHERE flag = 'R' ORDER BY cost DESC, us, decision_id LIMIT 10")
statement("argmax_with_tiebreak", "SELECT decision_id, horizon, round(cost, 4) AS cost FROM (SELECT *, row_number() OVER (PARTITION BY decision_id ORDER BY cost DESC, horizon, part) AS rn FROM evals) q WHERE rn = 1")
statement("select_margin", "SELECT symbol, strategy, round(e, 4) AS expectancy FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY e DESC, strategy) AS rn FROM (SELECT symbol, strategy, avg(pnl) AS e, count(*) AS n FROM trades GROUP BY symbol, strategy HAVING count(*) >= 5) s) q WHERE rn = 1")
statement("idempotent_insert", "SELECT decision_id, status FROM runs WHERE decision_id % 3 = 0 UNION ALL SELECT decision_id, 'NEW' FROM runs r WHERE decision_id % 2 = 0 AND NOT EXISTS (SELECT 1 FROM runs x WHERE x.decision_id = r.decision_id AND x.decision_id % 3 = 0)")
statement("upsert_by_key", "SELECT decision_id, status, version FROM (SELECT *, row_number() OVER (PARTITION BY decision_id ORDER BY version DESC) AS rn FROM (SELECT decision_id, status, 1 AS version FROM runs WHERE decision_id % 3 = 0 UNION ALL SELECT decision_id, 'UPDATED', 2 FROM runs WHERE decision_id % 2 = 0) u) q WHERE rn = 1")
statement("state_merge", """
    WITH a AS (SELECT decision_id, CASE decision_id % 4 WHEN 0 THEN 'COMPLETE' WHEN 1 THEN 'PENDING' WHEN 2 THEN 'DATA_UNAVAILABLE' ELSE 'INELIGIBLE' END AS old_status FROM runs WHERE decision_id % 3 <> 0),
    b AS (SELECT decision_id, CASE decision_id % 5 WHEN 0 THEN 'COMPLETE' WHEN 1 THEN 'PENDING' ELSE 'DATA_UNAVAILABLE' END AS new_status FROM runs WHERE decision_id % 5 <> 4)
    SELECT coalesce(a.decision_id, b.decision_id) AS decision_id, CASE WHEN old_status IS NULL THEN new_status WHEN new_status IS NULL THEN old_status WHEN old_status IN ('COMPLETE', 'INELIGIBLE') THEN old_status WHEN old_status = 'DATA_UNAVAILABLE' AND new_status = 'COMPLETE' THEN 'COMPLETE' WHEN old_status = 'PENDING' THEN new_status ELSE old_status END AS status,
      coalesce(old_status = 'DATA_UNAVAILABLE' AND new_status = 'COMPLETE', false) AS recovered FROM a FULL JOIN b ON a.decision_id = b.decision_id""")
statement("inventory_diff", """
    WITH a AS (SELECT o_orderkey AS k, o_orderstatus AS v FROM orders WHERE o_orderkey % 7 <> 0), b AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 11 = 0 THEN 'X' ELSE o_orderstatus END AS v FROM orders WHERE o_orderkey % 5 <> 0)
    SELECT CASE WHEN a.k IS NULL THEN 'ADDED' WHEN b.k IS NULL THEN 'REMOVED' WHEN a.v <> b.v THEN 'CHANGED' ELSE 'SAME' END AS change, count(*) AS n FROM a FULL JOIN b ON a.k = b.k GROUP BY 1""")
statement("set_operations", "SELECT 'both' AS part, c FROM (SELECT l_suppkey AS c FROM lineitem WHERE l_quantity > 45 INTERSECT SELECT l_suppkey FROM lineitem WHERE l_tax > 7e-2) x UNION ALL SELECT 'first', c FROM (SELECT l_suppkey AS c FROM lineitem WHERE l_quantity > 45 EXCEPT SELECT l_suppkey FROM lineitem WHERE l_tax > 7e-2 AND l_discount > 9e-2 AND l_suppkey % 2 = 0) y")
statement("chunk_identities", "SELECT doc_id, 'chk_' || @sha(CAST(doc_id AS varchar(20)) || ':' || source || ':' || lang) AS chunk_id FROM documents")
statement("quality_policy", """
    SELECT doc_id, n_chars > 20000 AS too_long, text LIKE '%@%' AS private_text, lower(text) LIKE '%license%' AS licensed, lang NOT IN ('en', 'fr') AS other_language FROM documents""")
statement("manifest_counts", "SELECT lang, source, count(*) AS n, CAST(sum(n_chars) AS bigint) AS chars, min(doc_id) AS first_doc FROM documents GROUP BY lang, source")
statement("title_dedupe_before_window", """
    SELECT doc_id, lang FROM (SELECT doc_id, lang, n_chars, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS place FROM (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) AS rn FROM documents) d WHERE rn = 1) q WHERE place <= 10 AND n_chars > 200""")
statement("strategy_rule_thresholds", "SELECT event_id, r.rule FROM ticks JOIN (SELECT 'wide' AS rule, '>' AS op, 45e-3 AS bound UNION ALL SELECT 'tight', '<', 15e-3 UNION ALL SELECT 'even', '>=', 3e-2) r ON CASE r.op WHEN '>' THEN spread > r.bound WHEN '<' THEN spread < r.bound ELSE spread >= r.bound END")
statement("message_turn_counts", "SELECT role, count(*) AS n, CAST(sum(length(text)) AS bigint) AS chars, max(turn) AS last_turn FROM conversations GROUP BY role")


@query("SELECT json_extract_string(props, '$.k') AS k, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def json_property_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.get_json_object("props", "$.k").alias("k")).agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))


@query("""
    WITH r AS (SELECT label, sha256(CAST(vec_id AS varchar) || chr(31) || CAST(label AS varchar)) AS h FROM embeddings), d AS (SELECT label, h, h || ':' || count(*) AS line FROM r GROUP BY 1, 2),
    a AS (SELECT label, h[1:5] AS p, sha256(string_agg(line, chr(10) ORDER BY line)) AS x FROM d GROUP BY 1, 2), b AS (SELECT label, p[1:3] AS q, sha256(string_agg(p || x, chr(10) ORDER BY p)) AS y FROM a GROUP BY 1, 2),
    c AS (SELECT label, q[1:1] AS t, sha256(string_agg(q || y, chr(10) ORDER BY q)) AS z FROM b GROUP BY 1, 2) SELECT label, sha256(string_agg(t || z, chr(10) ORDER BY t)) AS hash FROM c GROUP BY 1""")
def population_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hash of each label's rows, whatever their order and partitions.

    Equal rows are counted, then hashes of rows meet by ever shorter prefixes of theirs: a tree whose
    nodes have at most 256 children, and leaves of about a millionth of the rows.
    """
    rows = table(spark, sf_dir, "embeddings").select("label", F.sha2(F.expr("concat(cast(vec_id as string), char(31), cast(label as string))").cast("binary"), 256).alias("h"))
    line = F.concat_ws(":", "h", F.col("n").cast("string"))
    level = rows.groupBy("label", "h").agg(F.count("*").alias("n")).select("label", F.substring("h", 1, 5).alias("p"), line.alias("x"))
    for digits in (5, 3, 1, 0):
        level = level.groupBy("label", F.substring("p", 1, digits).alias("p")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("x")), "\n").cast("binary"), 256).alias("y"))
        level = level.select("label", "p", F.concat("p", "y").alias("x"))
    return level.select("label", F.col("x").alias("hash"))
