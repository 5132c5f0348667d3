"""Mixing sources to target weights by hash-threshold histograms.

Every source gets a target of words: the budget is shared by weight, no target exceeds ``repeats`` times its source, and
what a capped source leaves is shared among the others by weight until none is above. A document's place in the mix is a
60-bit hash of its id and text. With ``whole = target div source_size`` all documents are taken ``whole`` times, and the
documents whose hash lies below the source's threshold once more, so budgets are nested: a larger target only adds.

The threshold comes from histograms: words are summed by source and by the hash's first 12 bits, the bucket in which the
budget ends is found, and only its rows are summed by the next 12 bits, until that bucket holds one document. No row is
sorted and no group gathered; a source of any size is partial sums and at most 4,096 buckets. The document at the
threshold is cut (``part`` words), so a source's taken words are its target, rounded down. Documents with one hash (rows
of equal id and text) cannot be told apart: if the budget ends among them, each gives the same share, rounded down.

The decision is a function of source, hash and size alone, so reruns agree and any scan of the table can apply it.

Cases: a null text has no words and stays with ``taken`` 0, like an empty one; a null source is a source of its own, the
last; a null doc_id is a value like any other; repeated rows are documents of their own; a source without words has
target 0; an empty table gives an empty result; further columns stay, and the new ones get a trailing underscore where a
name is taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clauselake.llm.common import fresh_name, quoted, staged, text_of
from clauselake.operators.skew import lookup_join

#: weights of the sources in order, repeating; words of the mix by those of the corpus; times a document is taken at most
WEIGHTS, SHARE, REPEATS = (3, 1, 2), 1.5, 2
#: bits of a histogram, and histograms until the hash's bits are used up
BITS, LEVELS = 12, 5
WORD = r"[^\x20\x09-\x0D]+"
_KEY = ["src", "no_src"]


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def place(doc_id: Column, text: Column) -> Column:
    """The first 60 bits of the md5 of id and text."""
    whole = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("|"), text)
    return F.conv(F.substring(F.md5(whole.cast("binary")), 1, 15), 16, 10).cast("long")


def measured(docs: DataFrame) -> DataFrame:
    """What the mix needs of each document: src, no_src (the source, null told apart), doc_id, size, place."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *[c.alias(n) for c, n in _own(docs)])


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """``sizes`` (src, no_src, source_size) with ``weight`` and ``target``.

    Sources are numbered by code point, null last, across range partitions. The water level (words for a weight of one)
    rises in rounds: what lies above its cap is capped, the rest shares the rest. A round returns three sums.
    """
    part = sizes.repartitionByRange("no_src", "src").withColumn("part", F.spark_partition_id())
    part = staged(part, "sources")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    offset = part.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    number = F.col("offset") + F.row_number().over(Window.partitionBy("part").orderBy("no_src", "src")) - 1
    cycle = F.array(*[F.lit(w) for w in weights])
    rows = part.join(offset, "part").withColumn("weight", F.get(cycle, F.pmod(number, F.lit(len(weights))).cast("int")))
    rows = staged(rows.select(*_KEY, "source_size", "weight", (F.lit(repeats) * F.col("source_size")).alias("cap")), "weights")
    budget = (rows.agg(F.sum("source_size")).first()[0] or 0) * share
    level, capped = 0.0, -1
    while True:
        above = F.lit(level) * F.col("weight") > F.col("cap")
        n, full, open_weight = rows.agg(
            F.count(F.when(above, 1)), F.coalesce(F.sum(F.when(above, F.col("cap"))), F.lit(0)), F.sum(F.when(above, F.lit(0)).otherwise(F.col("weight")))
        ).first()
        if n == capped or not open_weight:
            break
        capped, level = n, (budget - full) / open_weight
    share_of = F.lit(level) * F.col("weight")
    return rows.withColumn("target", F.when(share_of > F.col("cap"), F.col("cap").cast("double")).otherwise(share_of).cast("double"))


def thresholds(rows: DataFrame, goals: DataFrame) -> DataFrame:
    """Per source: src, no_src, source_size, target, whole, low, high, rest, words.

    Documents placed below ``low`` are taken once more than ``whole`` times; those from ``low`` to before ``high`` (one
    document, or rows of one hash) hold ``words`` and give ``rest`` of them.
    """
    goals = goals.filter("source_size > 0").withColumn("budget", F.floor("target").cast("long"))
    goals = goals.withColumn("whole", F.expr("budget div source_size")).withColumn("rest", F.col("budget") - F.col("whole") * F.col("source_size"))
    goals = staged(goals.select(*_KEY, "source_size", "target", "whole", "rest"), "goals")
    state = goals.select(*_KEY, "rest", F.lit(0).cast("long").alias("low"))
    inside = rows.filter("size > 0").select(*_KEY, "size", "place")
    for level in range(1, LEVELS + 1):
        width = 1 << BITS * (LEVELS - level)  # places in a bucket of this level
        sums = inside.withColumn("bucket", F.expr(f"place div {width}")).groupBy(*_KEY, "bucket").agg(F.sum("size").alias("words"), F.count("*").alias("n"))
        order = Window.partitionBy(*_KEY).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # 4,096 rows at most
        ends = sums.withColumn("before", F.coalesce(F.sum("words").over(order), F.lit(0))).join(state.select(*_KEY, "rest"), _KEY)
        ends = ends.filter("before <= rest AND rest < before + words")
        state = staged(ends.select(*_KEY, (F.col("rest") - F.col("before")).alias("rest"), (F.col("bucket") * width).alias("low"), ((F.col("bucket") + 1) * width).alias("high"), "words", "n"), "thresholds")
        if level == LEVELS or state.filter("n > 1 AND rest > 0").isEmpty():
            break
        inside = lookup_join(inside, state.select(*_KEY, "low", "high"), _KEY, "inner").filter("place >= low AND place < high")
        inside = staged(inside.select(*_KEY, "size", "place"), "boundary")
    return goals.drop("rest").join(state.drop("n"), _KEY)


def decided(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``rows`` (with src, no_src, size and place) with source_size, target, copies, part (words of a further, cut copy) and taken."""
    found = lookup_join(rows, plan, _KEY)
    share_of = F.expr("CAST(CAST(size AS DECIMAL(19, 0)) * rest / words AS BIGINT)")
    share_of = F.when(F.col("rest") == 0, F.lit(0)).when(F.col("words") == F.col("size"), F.col("rest")).otherwise(share_of)
    at = (F.col("place") >= F.col("low")) & (F.col("place") < F.col("high")) & (F.col("size") > 0)
    part = F.when(at, share_of).otherwise(0).cast("long")
    copies = (F.col("whole") + F.when(F.col("place") < F.col("low"), 1).otherwise(0)).cast("long")
    found = found.withColumns({"copies": F.coalesce(copies, F.lit(0)), "part": F.coalesce(part, F.lit(0))})
    found = found.withColumns({c: F.coalesce(c, F.lit(0).cast(found.schema[c].dataType)) for c in ("source_size", "target")})
    return found.withColumn("taken", F.col("copies") * F.col("size") + F.col("part")).drop("whole", "low", "high", "rest", "words")


def plan_mix(rows: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """The plan (one row a source) for ``measured`` rows; it may be applied to any scan of the same documents."""
    sizes = rows.groupBy(*_KEY).agg(F.sum("size").alias("source_size"))
    return staged(thresholds(rows, targets(sizes, weights, share, repeats)), "mix-plan")


def mix_sizes(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """Per document: doc_id, size, source_size, target, copies, part, taken; the texts are read once."""
    rows = staged(measured(docs), "measured")
    return decided(rows, plan_mix(rows, weights, share, repeats)).drop(*_KEY, "place")


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as it is taken, with all its columns and ``copy`` (from 1).

    The last copy of the document at a threshold holds its first ``part`` words, with one space between them.
    """
    rows = staged(measured(docs), "measured")
    plan = plan_mix(rows, weights, share, repeats)
    held = docs.select(F.struct(*quoted(docs.columns)).alias("doc"), *[c.alias(n) for c, n in _own(docs)])
    taken = decided(held, plan).withColumn("last", F.col("copies") + F.when(F.col("part") > 0, 1).otherwise(0)).filter("last > 0")
    taken = taken.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("last"))))
    words = F.filter(F.split(F.col("doc")["text"].cast("string"), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    cut = F.array_join(F.slice(words, F.lit(1), F.greatest(F.col("part"), F.lit(1)).cast("int")), " ")
    text = F.when(F.col("copy") > F.col("copies"), cut).otherwise(F.col("doc")["text"])
    columns = [(text if c == "text" else F.col("doc").getField(c)).alias(c) for c in docs.columns]
    return taken.select(*columns, F.col("copy").alias(fresh_name(docs, "copy")))


def _own(docs: DataFrame) -> list[tuple[Column, str]]:
    source = F.col("source").cast("string")
    return [
        (F.coalesce(source, F.lit("")), "src"), (source.isNull(), "no_src"),
        (word_count(F.col("text").cast("string")), "size"), (place(F.col("doc_id"), text_of(docs)), "place"),
    ]


def oracle() -> str:
    """The same rows for ``documents``: running sums over the sorted hashes instead of histograms."""
    return r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(text, '')), 1, 15) AS BIGINT) AS place FROM documents),
  s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS i FROM d GROUP BY source),
  w AS (SELECT *, CASE i % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight, 2 * source_size AS cap FROM s),
  -- in the order in which the rising level reaches the caps: the level when all before are capped
  f AS (SELECT *, row_number() OVER (ORDER BY cap * 6 // weight, i) AS j,
      (1.5::DOUBLE * CAST(sum(source_size) OVER () AS DOUBLE) - CAST(sum(cap) OVER (ORDER BY cap * 6 // weight, i ROWS UNBOUNDED PRECEDING) - cap AS DOUBLE))
      / CAST(sum(weight) OVER (ORDER BY cap * 6 // weight, i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level FROM w),
  l AS (SELECT level FROM f WHERE level * weight <= cap ORDER BY j LIMIT 1),
  g AS (SELECT f.*, CASE WHEN coalesce((FROM l) * weight <= cap, false) THEN (FROM l) * weight ELSE CAST(cap AS DOUBLE) END AS target FROM f),
  b AS (SELECT *, CAST(floor(target) AS BIGINT) // nullif(source_size, 0) AS whole, CAST(floor(target) AS BIGINT) % nullif(source_size, 0) AS rest FROM g),
  p AS (SELECT source, place, sum(size) AS words FROM d GROUP BY source, place),
  q AS (SELECT *, sum(words) OVER (PARTITION BY source ORDER BY place) - words AS before FROM p)
SELECT doc_id, size, source_size, target, CAST(CASE WHEN source_size = 0 THEN 0 ELSE whole * size + CASE WHEN words = 0 THEN 0
    ELSE size * greatest(0, least(words, rest - before)) // words END END AS BIGINT) AS taken
FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source JOIN q ON d.source IS NOT DISTINCT FROM q.source AND d.place = q.place"""
