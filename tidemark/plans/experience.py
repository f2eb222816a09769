"""The gate, the search, the outcomes and the status of evidence as one query; the oracle compares all with all."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import experience, gates
from tidemark.plans.gates import _OTHER, AS_OF, _search
from tidemark.plans.registry import projection, query
from tidemark.session import table

_MASK = "list_transform(embedding, lambda x: CASE WHEN abs(x) > 2e-2 THEN x::double END)"


@query(f"""
    {_search(f"WHEN completed_us IS NULL OR snapshot_us >= {AS_OF} OR completed_us >= {AS_OF} THEN 'as_of'")}, v AS (SELECT vec_id, {_MASK} AS e FROM embeddings),
    a AS (SELECT g.experience_id, g.snapshot_us, v.e FROM g CROSS JOIN f JOIN v ON v.vec_id = g.experience_id % (SELECT count(*) FROM embeddings) WHERE {_OTHER} IS NULL),
    p AS (SELECT q.vec_id AS query_id, a.experience_id, a.snapshot_us, len(q.e) AS dims, list_filter(list_transform(range(1, len(q.e) + 1), lambda i: (q.e[i] - a.e[i]) * (q.e[i] - a.e[i])), lambda x: x IS NOT NULL) AS s FROM v q CROSS JOIN a WHERE q.vec_id % 50 = 0),
    d AS (SELECT query_id, experience_id, snapshot_us, round(sqrt(list_sum(s) / len(s)), 6) AS distance FROM p WHERE len(s) >= greatest(8, ceil(dims / 2.0))),
    t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, snapshot_us DESC, experience_id) AS rank FROM d QUALIFY rank <= 5),
    k AS (SELECT experience_id, net FROM snapshots WHERE basis = 'ANALYSIS_SNAPSHOT' AND horizon_s = 3600 AND available_us <= {AS_OF} AND status = 'COMPLETE' AND net IS NOT NULL QUALIFY row_number() OVER (PARTITION BY experience_id ORDER BY available_us DESC, fingerprint DESC) = 1),
    c AS (SELECT query_id, count(*) AS alike, count(net) AS known, avg(net) AS mean_net, min(distance) AS nearest, min_by(t.experience_id, rank) AS first FROM t LEFT JOIN k ON k.experience_id = t.experience_id GROUP BY query_id)
    SELECT v.vec_id AS query_id, coalesce(alike, 0) AS alike, coalesce(known, 0) AS known, round(mean_net, 4) AS mean_net, nearest, first, CASE WHEN alike IS NULL THEN 'UNAVAILABLE' WHEN known < 3 THEN 'PARTIAL' ELSE 'COMPLETE' END AS status FROM v LEFT JOIN c ON c.query_id = v.vec_id WHERE v.vec_id % 50 = 0""")
def similar_experiences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every fiftieth vector the experiences like it that may be compared, and what became of them."""
    passed = gates.search_gate(projection(spark, sf_dir, "experiences"), "S1", "INTRADAY", "M15", action="HOLD", as_of_us=AS_OF).where("reason is null")
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.expr("transform(embedding, x -> if(abs(x) > 2e-2, cast(x as double), null))").alias("v"))
    n = max(vectors.count(), 1)
    accepted = passed.select("experience_id", F.col("snapshot_us").alias("at_us"), (F.col("experience_id") % n).alias("vec_id"))
    asked = vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "v")
    found = experience.similar(accepted, vectors, asked, 5)
    results = experience.outcomes(projection(spark, sf_dir, "snapshots"), "ANALYSIS_SNAPSHOT", 3600, AS_OF)
    return experience.evidence(asked, found, results).withColumn("mean_net", F.round("mean_net", 4))
