"""A search index as tables: postings by token bucket, lengths and corpus figures; written once, read by bucket."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from folioscope.operators.retrieval import B, K1, top

#: Directories of postings; a query reads those of its tokens only.
BUCKETS = 256


def _bucket(token: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(buckets)).cast("int")


def write_index(docs: DataFrame, key: str, tokens: Column, path: str, buckets: int = BUCKETS) -> None:
    """Write the index of ``docs``: ``postings`` (bucket, token, key, tf, dl), ``tokens`` (bucket, token, df), ``stats`` (n, avgdl, buckets).

    Documents without tokens count among ``n``. Rows of one bucket lie together, by token, so a scan
    prunes directories first and row groups after. Writing again replaces the index.
    """
    t = docs.select(F.col(key).alias("key"), tokens.alias("t"))
    p = t.select("key", F.size("t").cast("bigint").alias("dl"), F.explode("t").alias("token")).groupBy("key", "dl", "token").agg(F.count("*").alias("tf"))
    p = p.withColumn("bucket", _bucket(F.col("token"), buckets))
    p.repartition("bucket", F.pmod(F.xxhash64("key"), F.lit(8))).sortWithinPartitions("bucket", "token", "key").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    stored = docs.sparkSession.read.parquet(f"{path}/postings")
    stored.groupBy("bucket", "token").agg(F.count("*").alias("df")).repartition("bucket").sortWithinPartitions("token").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/tokens")
    t.agg(F.count("*").alias("n"), F.coalesce(F.avg(F.size("t")), F.lit(0.0)).alias("avgdl"), F.lit(buckets).alias("buckets")).write.mode("overwrite").parquet(f"{path}/stats")


def search(spark: SparkSession, path: str, query: list[str], k: int) -> DataFrame:
    """``(key, score)``: the k best documents of a written index by BM25."""
    stats = spark.read.parquet(f"{path}/stats").first()
    asked = spark.createDataFrame([(w, query.count(w)) for w in sorted(set(query))], "token string, qtf int").withColumn("bucket", _bucket(F.col("token"), stats.buckets))
    wanted = [r.bucket for r in asked.select("bucket").distinct().collect()]  # at most as many as the query has words
    mine = lambda name: spark.read.parquet(f"{path}/{name}").where(F.col("bucket").isin(wanted) & F.col("token").isin(sorted(set(query))))
    idf = mine("tokens").join(F.broadcast(asked.select("token", "qtf")), "token").select("token", (F.col("qtf") * F.log((stats.n - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)).alias("w"))
    p = mine("postings").join(F.broadcast(idf), "token")  # a row per word of the query
    norm = K1 * (1 - B + B * F.col("dl") / max(stats.avgdl, 1.0))
    return top(p.withColumn("s", F.col("w") * F.col("tf") * (K1 + 1) / (F.col("tf") + norm)).groupBy("key").agg(F.sum("s").alias("score")), "key", k)
