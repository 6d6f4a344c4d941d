"""Mixing sources to target weights with DataFrame functions only.

Each row gets a hash-random key; a source's rows are range-cut by that key into
buckets of bounded size; a bucket's token sums give prefix sums over the
source's buckets, and a window inside each bucket completes the prefix sum of
every row. The mix takes whole epochs of a source while its budget lasts and
then the rows of the prefix that the rest of the budget reaches, the last one
in part, so that every source meets its budget to the token.

Defined results: null texts count zero tokens; a null source is a source of its
own, ranked last; rows equal in every column share a key and are
indistinguishable, so reruns agree; an empty table gives an empty mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, row_hash

WEIGHTS = (5, 2, 1)
#: No source is taken more often than this.
MOST_EPOCHS = 3
SEED = "mix-1"
#: Mean rows of a bucket; a source has as many buckets as its rows ask for.
BUCKET_ROWS = 8192
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def random_key(doc_id: Column, text: Column) -> Column:
    """32 hex digits that depend on the seed, the doc_id and the text only."""
    return F.md5(F.concat_ws(":", F.lit(SEED), F.coalesce(doc_id.cast("string"), F.lit("null")), F.md5(F.coalesce(text, F.lit("")))))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Water filling: (source_key, source_size, target) from (source_key, source, source_size).

    One row per source comes in. Sorted by cap over weight, the sources that
    stop at their cap come first; the level of the rest is what is left over
    their weights.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    caps = sizes.withColumn("rank", rank).withColumn("weight", weight).withColumn("cap", F.col("source_size") * MOST_EPOCHS)
    caps = caps.withColumn("ratio", F.col("cap") / F.col("weight"))
    order = Window.orderBy("ratio", "rank")
    before, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    caps = caps.withColumn("place", F.row_number().over(order)).withColumn("level", (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(rest))
    first = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("place", "level"))).over(everything)
    caps = caps.withColumn("first", first)
    target = F.when(F.col("place") < F.col("first.place"), F.col("cap").cast("double")).otherwise(F.col("first.level") * F.col("weight"))
    return caps.select("source_key", "source_size", target.alias("target"))


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, row_hash, source, source_key, key, size), written once."""
    text, source = F.col("text").cast("string"), F.col("source").cast("string")
    source_key = F.when(source.isNull(), F.lit("null")).otherwise(F.concat(F.lit("="), source))
    rows = docs.select(F.col("doc_id"), row_hash(docs).alias("row_hash"), source.alias("source"), source_key.alias("source_key"), random_key(F.col("doc_id"), text).alias("key"), word_count(text).alias("size"))
    return materialize(rows, "mix-sizes")


def plan(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(doc_id, row_hash, size, source_size, target, taken) of every row."""
    rows = sized(docs)
    per_source = materialize(rows.groupBy("source_key", "source").agg(F.count("*").alias("n_rows"), F.sum("size").alias("source_size")), "mix-sources")
    buckets = F.ceil(F.col("n_rows") / F.lit(BUCKET_ROWS))
    place = F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * buckets / F.lit(1 << 32))
    rows = rows.join(per_source.select("source_key", "n_rows"), "source_key").withColumn("bucket", place).drop("n_rows")
    sums = materialize(rows.groupBy("source_key", "bucket").agg(F.sum("size").alias("bucket_size")), "mix-buckets")
    earlier = Window.partitionBy("source_key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("source_key", "bucket", F.coalesce(F.sum("bucket_size").over(earlier), F.lit(0)).alias("bucket_start"))
    cuts = starts.join(targets(per_source.drop("n_rows"), weights), "source_key")
    inside = Window.partitionBy("source_key", "bucket").orderBy("key", "size", "row_hash").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.join(cuts, ["source_key", "bucket"]).withColumn("start", F.col("bucket_start") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    budget = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.greatest("source_size", F.lit(1)))).otherwise(F.lit(0))
    placed = placed.withColumn("epochs", epochs).withColumn("rest", budget - F.col("epochs") * F.col("source_size"))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("start")))
    return placed.select("doc_id", "row_hash", "size", "source_size", "target", (F.col("epochs") * F.col("size") + part).cast("long").alias("taken"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """The mix itself: a row of docs as often as it is taken, the last time perhaps in part.

    A row taken in part keeps its first words with the white space around them;
    its n_chars, if there is one, is counted anew.
    """
    names = docs.columns
    row = F.struct(*[F.col(f"`{c}`") for c in names])
    taken = plan(docs, weights).where("taken > 0").select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("k_id"), F.col("row_hash").alias("k_hash"), "size", "taken")
    taken = taken.groupBy("k_id", "k_hash", "size").agg(F.sum("taken").alias("taken"))
    packed = docs.select(row.alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("k_id"), row_hash(docs).alias("k_hash"))
    packed = packed.dropDuplicates(["k_id", "k_hash"])
    words = F.regexp_extract_all(F.col("row.text"), F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    short = F.array_join(F.slice(words, 1, F.greatest(F.col("words"), F.lit(0)).cast("int")), "")
    copies = F.transform(F.sequence(F.lit(1), F.ceil(F.col("taken") / F.col("size"))), lambda i: F.least(F.col("size"), F.col("taken") - (i - 1) * F.col("size")))
    out = packed.join(taken, ["k_id", "k_hash"]).select("row", "size", F.explode(copies).alias("words"))
    text = F.when(F.col("words") < F.col("size"), short).otherwise(F.col("row.text"))
    columns = [text.alias(c) if c == "text" else F.length(text).cast("long").alias(c) if c == "n_chars" else F.col(f"row.`{c}`") for c in names]
    return out.select(*columns)


ORACLE = r"""
WITH rows AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || md5(coalesce(text, ''))) AS k
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM rows GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rnk FROM s),
w AS (SELECT *, CASE (rnk - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, source_size * 3 AS cap FROM r),
x AS (SELECT *, CAST(cap AS DOUBLE) / weight AS ratio FROM w),
l AS (SELECT *, row_number() OVER (ORDER BY ratio, rnk) AS place,
        CAST((SELECT sum(source_size) FROM s) - coalesce(sum(cap) OVER (ORDER BY ratio, rnk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
        / sum(weight) OVER (ORDER BY ratio, rnk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM x),
f AS (SELECT min(place) AS place FROM l WHERE level <= ratio),
t AS (SELECT source, source_size,
        CASE WHEN l.place < f.place THEN CAST(cap AS DOUBLE) ELSE (SELECT level FROM l JOIN f USING (place)) * weight END AS target FROM l, f),
p AS (SELECT doc_id, size, source_size, target, k,
        coalesce(sum(size) OVER (PARTITION BY rows.source ORDER BY k, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
      FROM rows JOIN t ON rows.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(floor(target) / greatest(source_size, 1)) ELSE 0 END AS epochs FROM p)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(epochs * size + greatest(0, least(size, floor(target) - epochs * source_size - start)) AS BIGINT) AS taken
FROM e
"""
