"""Ranked search: BM25 over tokens, exact vector search in blocks, rank fusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gyeol.session import busy, cut_lineage, ship_package

#: Query terms that are broadcast; more of them are joined by a shuffle.
MAX_TERMS = 100_000
#: Query vectors in one broadcast block.
BLOCK = 4096


def tokens(c: Column) -> Column:
    """Lower-case runs of digits, Latin letters and Hangul syllables."""
    return F.filter(F.split(F.lower(c), "[^0-9a-z가-힣]+"), lambda x: x != "")


def bm25(docs: DataFrame, queries: DataFrame, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(query_id, doc_id, score) of all documents that share a term; docs: doc_id, text; queries: query_id, text.

    Only terms of the queries leave the scan: their occurrences are counted in the text's row, so the shuffle
    holds (term, document, count) of matching terms. Query terms are broadcast while there are at most MAX_TERMS.
    """
    q = queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))
    wanted = q.select("term").distinct()
    if wanted.count() <= MAX_TERMS:
        wanted = F.broadcast(wanted)
    sized = busy(docs.where("text is not null").select("doc_id", "text")).select("doc_id", tokens(F.col("text")).alias("ts")).withColumn("len", F.size("ts"))
    stats = sized.agg(F.count("*").alias("n_docs"), F.avg("len").alias("avg_len"))
    # the outer form keeps the optimizer from tokenising in the scan's filter as well
    terms = sized.select("doc_id", "len", F.explode_outer("ts").alias("term"))
    tf = cut_lineage(terms.join(wanted, "term", "left_semi").groupBy("term", "doc_id", "len").agg(F.count("*").alias("tf")))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    idf = df.join(F.broadcast(stats)).select("term", F.ln(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"), "avg_len")  # stats is one row
    part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))
    return tf.join(idf, "term").join(q, "term").groupBy("query_id", "doc_id").agg(F.sum(part).alias("score"))


def top_k(scored: DataFrame, k: int, digits: int = 6) -> DataFrame:
    """The k best of each query by rounded score, ties by doc_id. Ranked by parts first, so one query may match all rows."""
    s = scored.withColumn("score", F.round("score", digits)).withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(64)))
    order = [F.col("score").desc(), F.col("doc_id")]
    s = s.withColumn("r", F.row_number().over(Window.partitionBy("query_id", "part").orderBy(*order))).where(F.col("r") <= k)
    return s.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= k).select("query_id", "doc_id", "score", "rank")


def fuse_ranks(rankings: list[DataFrame], k: int = 60) -> DataFrame:
    """Reciprocal rank fusion: (query_id, doc_id, score) from rankings of (query_id, doc_id, rank)."""
    every = rankings[0].select("query_id", "doc_id", "rank")
    for r in rankings[1:]:
        every = every.unionByName(r.select("query_id", "doc_id", "rank"))
    return every.groupBy("query_id", "doc_id").agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"))


def vector_top_k(vectors: DataFrame, queries: DataFrame, k: int, vec_id: str = "vec_id", embedding: str = "embedding", digits: int = 6) -> DataFrame:
    """(query_id, doc_id, score, rank): exact cosine search of every query against all rows.

    Queries are streamed through the driver in blocks of ``BLOCK``; each block is broadcast, scored against all rows batch by
    batch as one matrix product, and only k rows a query leave a batch. Null or zero vectors match nothing.
    """
    import numpy as np

    spark = vectors.sparkSession
    ship_package(spark)
    rows = vectors.where(F.col(embedding).isNotNull()).select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).cast("array<double>").alias("v"))

    def search(block: list) -> DataFrame:
        ids = np.array([r[0] for r in block], dtype=np.int64)
        mat = np.array([r[1] for r in block], dtype=np.float64)
        norm = np.linalg.norm(mat, axis=1, keepdims=True)
        shared = spark.sparkContext.broadcast((ids[norm[:, 0] > 0], (mat / np.where(norm > 0, norm, 1))[norm[:, 0] > 0]))

        def run(batches):
            import numpy as np
            import pyarrow as pa

            qids, q = shared.value
            for batch in batches:
                own = np.array(batch.column(0).to_pylist(), dtype=np.int64)
                m = np.array(batch.column(1).to_pylist(), dtype=np.float64).reshape(len(own), -1)
                length = np.linalg.norm(m, axis=1)
                own, m = own[length > 0], m[length > 0] / length[length > 0, None]
                if not len(own) or not len(qids):
                    continue
                scores = np.round(q @ m.T, digits)
                order = np.lexsort((np.broadcast_to(own, scores.shape), -scores), axis=1)[:, :k]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(qids, order.shape[1])), pa.array(own[order].ravel()), pa.array(np.take_along_axis(scores, order, 1).ravel())], names=["query_id", "doc_id", "score"])

        return rows.mapInArrow(run, "query_id long, doc_id long, score double")

    out, block = None, []
    wanted = queries.where(F.col(embedding).isNotNull()).select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).cast("array<double>").alias("v"))
    for r in wanted.toLocalIterator():
        block.append((r[0], r[1]))
        if len(block) == BLOCK:
            out, block = search(block) if out is None else out.unionByName(search(block)), []
    if block or out is None:
        part = search(block) if block else rows.limit(0).select(F.lit(0).cast("long").alias("query_id"), F.col("id").alias("doc_id"), F.lit(0.0).alias("score"))
        out = part if out is None else out.unionByName(part)
    return top_k(out, k, digits)


def similar_pairs(names: DataFrame, others: DataFrame, limit: int) -> DataFrame:
    """(name, other, dist) of all pairs of a ``name`` and an ``other`` at most ``limit`` edits apart; both inputs are taken distinct.

    Lossless: cut into limit + 1 segments, the shorter text of a pair has one that the longer holds unchanged, moved by at most
    ``limit``. Segments are the join key; texts too short for segments meet by length alone.
    """
    parts = limit + 1
    base = lambda n: (n / parts).cast("int")
    # the last n % parts segments are one longer
    start = lambda n, i: i * base(n) + F.greatest(F.lit(0), i - (parts - n % parts))
    width = lambda n, i: base(n) + (i >= parts - n % parts).cast("int")
    key = lambda n, i, s: F.struct(n.alias("n"), i.alias("i"), s.alias("s"))
    every = F.sequence(F.lit(0), F.lit(limit))

    def pieces(t: Column) -> Column:
        n = F.length(t)
        cut = F.transform(every, lambda i: key(n, i, F.substring(t, start(n, i) + 1, width(n, i))))
        return F.when(n < parts, F.array(key(n, F.lit(-1), F.lit("")))).otherwise(cut)

    def probes(t: Column) -> Column:
        m = F.length(t)
        at = lambda n, i, by: key(n, i, F.substring(t, start(n, i) + by + 1, width(n, i)))
        inside = lambda n, i: F.filter(F.sequence(F.lit(-limit), F.lit(limit)), lambda by: (start(n, i) + by >= 0) & (start(n, i) + by + width(n, i) <= m))
        of = lambda n: F.when(n < parts, F.array(key(n, F.lit(-1), F.lit("")))).otherwise(F.flatten(F.transform(every, lambda i: F.transform(inside(n, i), lambda by: at(n, i, by)))))
        return F.array_distinct(F.flatten(F.transform(F.sequence(F.greatest(F.lit(0), m - limit), m), of)))

    name, other = F.col("name"), F.col("other")
    a, b = names.where("name is not null").select("name").distinct(), others.where("other is not null").select("other").distinct()
    short_a = a.select("name", F.explode(pieces(name)).alias("key")).join(b.select("other", F.explode(probes(other)).alias("key")), "key")
    short_b = b.select("other", F.explode(pieces(other)).alias("key")).join(a.select("name", F.explode(probes(name)).alias("key")), "key")
    met = short_a.where(F.length("name") <= F.length("other")).select("name", "other").unionByName(short_b.where(F.length("other") < F.length("name")).select("name", "other"))
    return met.distinct().withColumn("dist", F.levenshtein("name", "other")).where(F.col("dist") <= limit)
