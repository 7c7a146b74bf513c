"""Similarity, nearest rows, clustering over embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewire.functions import vectors
from tidewire.operators import clustering

from . import domain as d
from .registry import Tables, query

#: The stated query set of searches.
ASKS = "vec_id % 100 = 0"


def _probes(t: Tables):
    return t.embeddings.where(ASKS).select(F.col("vec_id").alias("probe_id"), F.col("embedding").alias("vector"))


def _rows(t: Tables):
    return t.embeddings.select(F.col("vec_id").alias("row_id"), F.col("embedding").alias("vector"))


SIM = f"(SELECT a.vec_id AS probe_id, b.vec_id AS row_id, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS similarity FROM embeddings a JOIN embeddings b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id)"
NEAR = f"(SELECT *, CAST(row_number() OVER (PARTITION BY probe_id ORDER BY similarity DESC, row_id) AS INTEGER) AS rank FROM {SIM})"
R = "round_even(similarity, 4) + 0.0 AS similarity"


def _r(c="similarity"):
    return (F.bround(c, 4) + F.lit(0.0)).alias("similarity")


@query(f"SELECT probe_id, row_id, {R} FROM {SIM} WHERE similarity >= 0.3")
def cosine_pairs(t: Tables):
    return clustering.similar(_probes(t), _rows(t), 0.3).select("probe_id", "row_id", _r())


@query(f"SELECT probe_id, row_id, rank, {R} FROM {NEAR} WHERE rank <= 10")
def knn_top10(t: Tables):
    return clustering.nearest(_probes(t), _rows(t), 10).select("probe_id", "row_id", "rank", _r())


@query()
def knn_indexed(t: Tables):
    """knn_top10 by an inverted file whose share of lists is set for a recall of 0.95."""
    from tidewire.operators import index

    return index.indexed_nearest(_probes(t), _rows(t), 10).select("probe_id", "row_id", "rank", _r())


@query(f"SELECT count(*) AS wanted, true AS enough FROM {NEAR} WHERE rank <= 10")
def knn_indexed_recall(t: Tables):
    """Whether the index finds nine tenths of the exact ten nearest of all probes."""
    from tidewire.operators import index

    exact = clustering.nearest(_probes(t), _rows(t), 10).select("probe_id", "row_id")
    found = index.indexed_nearest(_probes(t), _rows(t), 10).select("probe_id", "row_id", F.lit(1).alias("hit"))
    rows = exact.join(found, ["probe_id", "row_id"], "left")
    return rows.agg(F.count("*").alias("wanted"), (F.count("hit") >= 0.9 * F.count("*")).alias("enough"))


@query(f"SELECT probe_id, row_id, {R} FROM {NEAR} WHERE rank = 1")
def nearest_other(t: Tables):
    return clustering.nearest(_probes(t), _rows(t), 1).select("probe_id", "row_id", _r())


@query("SELECT label, CAST(place - 1 AS INTEGER) AS place, round_even(avg(x), 6) + 0.0 AS x FROM (SELECT label, unnest(embedding)::DOUBLE AS x, unnest(range(1, len(embedding) + 1)) AS place FROM embeddings) GROUP BY 1, 2")
def centroid_mean(t: Tables):
    c = vectors.mean_vector(t.embeddings, "label", "embedding")
    return c.select("label", F.posexplode("centroid").alias("place", "x")).select("label", "place", (F.bround("x", 6) + F.lit(0.0)).alias("x"))


@query("SELECT vec_id // 100 AS batch, bool_and(len(embedding) = 64 AND abs(sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) - 1) <= 0.05) AS accepted, count(*) AS n FROM embeddings GROUP BY 1")
def norm_validation(t: Tables):
    return vectors.batch_valid(t.embeddings.withColumn("batch", F.floor(F.col("vec_id") / 100)), "batch", "embedding", 64)


def _entities(t: Tables, key: str):
    """Two selective entities for each vector: its eight neighbours by id, and those half a step on."""
    e = F.array(F.floor(F.col("vec_id") / 8), F.floor((F.col("vec_id") + 4) / 8) + F.lit(1_000_000_000))
    return t.embeddings.select(F.col("vec_id").alias(key), F.explode(e).alias("entity_id"))


ENT = "(SELECT vec_id, unnest([vec_id // 8, (vec_id + 4) // 8 + 1000000000]) AS entity_id FROM embeddings)"
SHARE = f"(SELECT a.vec_id AS a, b.vec_id AS b, count(*) AS shared FROM {ENT} a JOIN {ENT} b ON a.entity_id = b.entity_id AND a.vec_id <> b.vec_id GROUP BY 1, 2)"
LOW = -0.2


@query(f"SELECT probe_id, row_id, rank, shared, {R} FROM {NEAR} n JOIN {SHARE} s ON s.a = probe_id AND s.b = row_id WHERE rank <= 200 AND similarity >= {LOW}")
def join_candidates(t: Tables):
    guards = _entities(t, "id")
    out = clustering.join_candidates(_probes(t), _rows(t), guards, guards, LOW, 200)
    return out.select("probe_id", "row_id", "rank", "shared", _r())


@query(f"""WITH m AS (SELECT probe_id, row_id FROM {NEAR} n JOIN {SHARE} s ON s.a = probe_id AND s.b = row_id WHERE rank <= 200 AND similarity >= {LOW})
SELECT DISTINCT x.probe_id FROM m x JOIN m y ON x.probe_id = y.probe_id AND x.row_id < y.row_id JOIN embeddings a ON a.vec_id = x.row_id JOIN embeddings b ON b.vec_id = y.row_id
WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) < {LOW}""")
def digest_articles(t: Tables):
    guards = _entities(t, "id")
    out = clustering.join_candidates(_probes(t), _rows(t), guards, guards, LOW, 200)
    return clustering.digests(out, _rows(t), LOW)


def _stories(t: Tables):
    return t.embeddings.select(F.col("vec_id").alias("story_id"), F.col("vec_id").alias("at"), F.col("embedding").alias("vector"))


@query(f"SELECT s.a, s.b, shared, round_even(list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]), 4) + 0.0 AS similarity FROM {SHARE} s JOIN embeddings x ON x.vec_id = s.a JOIN embeddings y ON y.vec_id = s.b WHERE s.a < s.b AND list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]) >= 0.2")
def consolidation_pairs(t: Tables):
    return clustering.pairs_by_entity(_stories(t), _entities(t, "story_id"), 0.2).select("a", "b", "shared", _r())


@query()
def consolidate_fold(t: Tables):
    return clustering.consolidate(_stories(t), _entities(t, "story_id"), 0.2)


@query(f"""SELECT story_id, larger_id, shared, {R} FROM (SELECT s.a AS story_id, s.b AS larger_id, shared, list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]) AS similarity,
row_number() OVER (PARTITION BY s.a ORDER BY list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]) DESC, s.b) AS r
FROM {SHARE} s JOIN embeddings x ON x.vec_id = s.a JOIN embeddings y ON y.vec_id = s.b WHERE s.a % 3 = 0 AND s.b % 3 <> 0 AND list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]) >= 0.1) WHERE r = 1""")
def straggler_best(t: Tables):
    v, g = _stories(t).select("story_id", "vector"), _entities(t, "story_id")
    one, big = F.col("story_id") % 3 == 0, F.col("story_id") % 3 != 0
    return clustering.straggler_best(v.where(one), v.where(big), g.where(one), g.where(big), 0.1).select("story_id", "larger_id", "shared", _r())


@query()
def rejoin_fold(t: Tables):
    """Every third vector is a single story; the others have two members each, of two outlets."""
    v = t.embeddings.select(F.col("vec_id").alias("story_id"), F.col("vec_id").alias("at"), F.col("embedding").alias("vector"))
    n = F.when(F.col("story_id") % 3 == 0, 1).otherwise(2)
    members = v.select("story_id", F.explode(F.sequence(F.lit(1), n)).alias("k")).select("story_id", F.concat(F.lit("h"), F.col("k"), F.lit(".com")).alias("domain"))
    edges = _entities(t, "story_id")
    ents = edges.select("entity_id").distinct().select("entity_id", F.concat(F.lit("e"), "entity_id").alias("name"), F.lit("ORG").alias("entity_type"))
    none = ents.where("false").select("entity_id")
    return clustering.rejoin(v, members, edges, ents, none, 0.2)


@query()
def cluster_fold(t: Tables):
    """Join-or-create over all vectors: labels' digits are entities of a dozen articles each, hosts alternate."""
    start = F.lit("2024-01-01").cast("timestamp")
    arts = t.embeddings.select(F.col("vec_id").alias("article_id"), F.timestamp_add("MINUTE", F.col("vec_id"), start).alias("published_at"), F.concat(F.lit("h"), F.col("vec_id") % 5, F.lit(".com")).alias("domain"), F.col("embedding").alias("vector"))
    edges = _entities(t, "article_id")
    ents = edges.select("entity_id").distinct().select("entity_id", F.concat(F.lit("e"), "entity_id").alias("name"), F.lit("ORG").alias("entity_type"))
    none = ents.where("false").select("entity_id")
    return clustering.cluster(arts, edges, ents, none, 0.2)


@query(f"""SELECT why, count(*) AS n FROM (SELECT CASE WHEN similarity < 0.5 AND s.a IS NULL THEN 'both' WHEN similarity < 0.5 THEN 'threshold' WHEN s.a IS NULL THEN 'guard' ELSE 'other' END AS why
FROM {NEAR} n LEFT JOIN {SHARE} s ON s.a = probe_id AND s.b = row_id WHERE rank <= 10) GROUP BY 1""")
def blocker_histogram(t: Tables):
    near = clustering.nearest(_probes(t), _rows(t), 10)
    g = _entities(t, "id")
    from tidewire.operators import guard

    share = guard.shared(g.toDF("probe_id", "entity_id"), "probe_id", g.toDF("row_id", "entity_id"), "row_id")
    rows = near.join(share, ["probe_id", "row_id"], "left")
    return rows.select(clustering.blocker(F.col("similarity"), F.coalesce("shared", F.lit(0)), 0.5).alias("why")).groupBy("why").agg(F.count("*").alias("n"))


@query(f"""SELECT count(*) FILTER (WHERE a.label = b.label) AS joined, count(*) FILTER (WHERE a.label <> b.label) AS missed, round_even(count(*) FILTER (WHERE a.label = b.label) / nullif(count(*), 0), 4) AS recall
FROM {NEAR} n JOIN embeddings a ON a.vec_id = probe_id JOIN embeddings b ON b.vec_id = row_id WHERE rank <= 10""")
def knn_recall(t: Tables):
    near = clustering.nearest(_probes(t), _rows(t), 10).select("probe_id", "row_id")
    lab = t.embeddings.select("vec_id", "label")
    rows = near.join(lab.toDF("probe_id", "la"), "probe_id").join(lab.toDF("row_id", "lb"), "row_id")
    hit = F.count_if(F.col("la") == F.col("lb"))
    return rows.agg(hit.alias("joined"), F.count_if(F.col("la") != F.col("lb")).alias("missed"), F.bround(F.try_divide(hit, F.count("*")), 4).alias("recall"))
