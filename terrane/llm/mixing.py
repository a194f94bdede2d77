"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame functions alone.

Every source has a weight. The sources share ``share`` times the words of all documents in proportion to their weights; a
target stops at ``most`` times its source's words, and the excess is shared again by weight until no target is above.
A document of a source with rate r = target / words is taken floor(r) times, and once more with the fractional probability
r - floor(r). These fractions are rounded dependently: two documents are paired, a random transfer of words between
them (unbiased: each document's expected number of copies stays as it is) makes one of them whole, and the other goes on with
the residual.

First the documents that hold at least ``GIANT`` of their source's words (so at most 1 / GIANT of a source) are paired, the largest first, with the
pool of all smaller documents of the source, whose common fraction takes the other end of the transfer. The rest are paired
within hash groups of about ``GROUP`` of the same source and size class (power of two); the residuals of GROUP groups meet in a group of
the next level, and so on, until up to GROUP residuals of each size class are left; these are paired from the largest class down,
and the last is rounded to the nearest whole. So the words taken differ from the target by no more than about half of GIANT of the source's words,
unless a few documents dominate the source.

Only (key, source, size) rows are shuffled, in groups of bounded size whatever the source. What is random is drawn from
hashes of rows, so reruns agree, however the rows are partitioned; rows are told apart by numbers, not by these hashes. Rows that are equal in all of id, source and text (128 bits of hash) are
counted, and numbered ``CHUNK`` at a time, so that a third of all rows being equal is no single task's work.

Nulls and edges: null text has size 0; documents of size 0 are taken floor(r) times and take no words. Null sources are a source of
their own, last in order. A source without words has target 0. Without any words nothing is taken. Null and repeated ids are allowed.
Extra columns are kept by ``mixed``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrane.llm.common import materialise

SHARE = 1.5
MOST = 2.0
WEIGHTS = (3, 1, 2)
GROUP = 64
GIANT = 0.005
#: Source tables of up to so many rows (about 50 bytes each) are broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS = 100_000
#: Equal rows that one row stands for until it is multiplied.
CHUNK = 10_000


def word_count(text: Column) -> Column:
    """Number of runs of characters other than space and U+0009 to U+000D; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def ranked(sources: DataFrame, weights=WEIGHTS) -> DataFrame:
    """sources with weight: the weights in turn by the order of source, nulls last. Ranks by range partitions, without a single-task sort."""
    parts = sources.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id())
    parts = materialise(parts, "sources")
    before = parts.groupBy("part").agg(F.count("*").alias("n"), F.min(F.struct(F.col("source").isNull(), "source")).alias("low"))
    before = before.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("low").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rank = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1 + F.col("before")
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(rank, F.lit(len(weights))).cast("int") + 1)
    return parts.join(F.broadcast(before.select("part", "before")), "part").withColumn("weight", turn).drop("part", "before")


def targets(sources: DataFrame, share: float = SHARE, most: float = MOST) -> DataFrame:
    """sources (source, source_size, weight, ...) with target double. One aggregate row comes to the driver in each round of resharing."""
    sources = materialise(sources, "weighted")
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    cap = F.col("source_size") * F.lit(float(most))
    rate, full = 0.0, F.lit(False)
    while True:
        row = sources.agg(F.sum(F.when(full, cap)).alias("used"), F.sum(F.when(~full, F.col("weight"))).alias("open"), F.count_if(full).alias("n")).first()
        if not row.open:
            break
        rate = (share * total - (row.used or 0.0)) / row.open
        full = F.col("weight") * F.lit(rate) > cap
        if sources.where(full).count() == row.n:
            break
    return sources.withColumn("target", F.least(cap, F.col("weight") * F.lit(rate)))


def _uniform(*keys) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*keys), 11) * F.lit(2.0**-53)


def _decided(x: Column, take: Column) -> Column:
    return F.struct(x["uid"].alias("uid"), take.cast("int").alias("up"))


def _pivot(items: Column) -> Column:
    """Of an array of (h, uid, size, p): struct(rest: the last residual, done: those made whole). Transfers words, keeping their sum."""
    none = "array<struct<uid:bigint,up:int>>"

    def step(acc, x):
        a = acc["rest"]
        more = F.least((1 - a["p"]) * a["size"], x["p"] * x["size"])  # words that may go from x to a
        less = F.least(a["p"] * a["size"], (1 - x["p"]) * x["size"])  # and from a to x
        to_a = _uniform(a["h"], x["h"]) * (more + less) < less
        moved = F.when(to_a, more).otherwise(-less)
        pa, px = a["p"] + moved / a["size"], x["p"] - moved / x["size"]
        a_whole = F.when(to_a, (1 - a["p"]) * a["size"] <= x["p"] * x["size"]).otherwise(a["p"] * a["size"] <= (1 - x["p"]) * x["size"])
        rest = F.struct(*[F.when(a_whole, x[c]).otherwise(a[c]).alias(c) for c in ("h", "uid", "size")], F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.when(a_whole, px).otherwise(pa))).alias("p"))
        # One that is whole is at 1 if words went to it, else at 0.
        done = F.when(a_whole, _decided(a, F.when(to_a, 1).otherwise(0))).otherwise(_decided(x, F.when(to_a, 0).otherwise(1)))
        return F.struct(rest.alias("rest"), F.concat(acc["done"], F.array(done)).alias("done"))

    start = F.struct(items[0].alias("rest"), F.array().cast(none).alias("done"))
    return F.aggregate(F.slice(items, 2, F.greatest(F.size(items) - 1, F.lit(0))), start, step)


def _pool(items: Column, p: Column, words: Column) -> Column:
    """Giants (h, uid, size), largest first, paired in turn with the pool of the words after them: struct(p of the pool, words, done)."""
    none = "array<struct<uid:bigint,up:int>>"

    def step(acc, x):
        f, size = acc["p"], x["size"]
        words = acc["words"] - size
        more, less = F.least((1 - f) * size, f * words), F.least(f * size, (1 - f) * words)
        to_x = _uniform(F.lit(61), x["h"]) * (more + less) < less
        moved = F.when(to_x, more).otherwise(-less)
        px = f + moved / size
        rest = F.when(words > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), f - moved / F.greatest(words, F.lit(1))))).otherwise(f)
        done = _decided(x, F.when(px >= 0.5, 1).otherwise(0))
        return F.struct(rest.alias("p"), words.alias("words"), F.concat(acc["done"], F.array(done)).alias("done"))

    return F.aggregate(items, F.struct(p.alias("p"), words.alias("words"), F.array().cast(none).alias("done")), step)


def keyed(docs: DataFrame) -> DataFrame:
    """docs with __h and __g: 128 bits of hash of id, source and text, by which equal rows are known."""
    return docs.withColumns({c: F.xxhash64(F.lit(seed), "doc_id", "source", "text") for c, seed in (("__h", 47), ("__g", 48))})


def multiplied(rows: DataFrame, n: str, most: int, name: str) -> DataFrame:
    """Each row once for every number from 1 to its column n, at most ``most``, which is dropped: column name. Numbers of a row are dealt in chunks if there are more than one."""
    if most > CHUNK:
        rows = rows.withColumn("__c", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(n) - 1) / CHUNK))))
        rows = rows.repartition(F.xxhash64("__c", *[c for c, _ in rows.dtypes if c in ("h", "g", "__h", "__g")]))
        low, high = F.col("__c") * CHUNK + 1, F.least(F.col(n), (F.col("__c") + 1) * CHUNK)
    else:
        low, high = F.lit(1).cast("long"), F.col(n)
    return rows.withColumn(name, F.explode(F.sequence(low, high))).drop("__c", n)


def sizes(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> tuple[DataFrame, DataFrame]:
    """(rows: doc_id, source, h, g, size, source_size, target), and the source table."""
    rows = materialise(keyed(docs).select("doc_id", "source", F.col("__h").alias("h"), F.col("__g").alias("g"), word_count(F.col("text")).alias("size")), "sizes")
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    table = materialise(targets(ranked(sources, weights), share, most), "targets")
    small = F.broadcast(table) if table.count() <= BROADCAST_ROWS else table
    known = small.select(F.col("source").alias("__s"), "source_size", "target")
    return rows.join(known, F.col("source").eqNullSafe(F.col("__s"))).drop("__s"), table


def copies(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(doc_id, source, h, g, dup, size, source_size, target, copies): how often the mix takes each document. Equal rows have dup 1, 2, ..."""
    rows, _ = sizes(docs, weights, share, most)
    # Equal rows become one row and a count, and are numbered anew.
    rows = rows.groupBy("doc_id", "source", "h", "g", "size", "source_size", "target").agg(F.count("*").alias("m"))
    rows = materialise(rows, "counted")
    rows = multiplied(rows, "m", rows.agg(F.max("m")).first()[0] or 0, "dup").withColumns({"uid": F.monotonically_increasing_id(), "key": F.xxhash64("h", "g", "dup")})
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rows = rows.withColumn("base", F.floor(rate).cast("int")).withColumn("p", rate - F.floor(rate))
    rows = materialise(rows.withColumn("class", F.floor(F.log2(F.greatest(F.col("size"), F.lit(1)).cast("double"))).cast("int")), "rates")
    open_ = rows.where("p > 0 AND size > 0")
    giant = F.col("size") >= GIANT * F.col("source_size")
    order = lambda h, size: F.struct((-size).alias("o"), F.xxhash64(F.lit(59), h).alias("r"))
    giants = open_.where(giant).groupBy("source").agg(F.sort_array(F.collect_list(F.struct(order(F.col("key"), F.col("size")).alias("k"), F.col("key").alias("h"), "uid", "size"))).alias("items"), F.max("p").alias("p"), F.max("source_size").alias("words"))
    giants = materialise(giants.select("source", _pool(F.col("items"), F.col("p"), F.col("words")).alias("out")).select("source", "out.p", "out.done"), "giants")
    done = [giants.select(F.explode("done").alias("d")).select("d.*")]
    shifted = giants.select(F.col("source").alias("__g"), F.col("p").alias("__p"))
    shifted = F.broadcast(shifted) if shifted.count() <= BROADCAST_ROWS else shifted
    open_ = open_.where(~giant).join(shifted, F.col("source").eqNullSafe(F.col("__g")), "left").withColumn("p", F.coalesce("__p", "p")).drop("__g", "__p")
    counts = open_.groupBy("source", "class").agg(F.count("*").alias("n")).select(F.col("source").alias("__s"), F.col("class").alias("__c"), F.ceil(F.col("n") / GROUP).alias("groups"))
    counts = materialise(counts, "counts")
    most_groups = counts.agg(F.max("groups"), F.count("*")).first()
    small = F.broadcast(counts) if most_groups[1] <= BROADCAST_ROWS else counts
    live = open_.join(small, F.col("source").eqNullSafe(F.col("__s")) & (F.col("class") == F.col("__c")))
    live = live.select("source", "class", F.pmod(F.xxhash64(F.lit(53), "key"), F.col("groups")).alias("group"), F.struct(F.col("key").alias("h"), "uid", "size", "p").alias("item"))
    left = most_groups[0] or 0
    level = 0
    by_size = lambda: F.sort_array(F.collect_list(F.struct(order(F.col("item.h"), F.col("item.size")).alias("k"), "item")))
    while left:
        level += 1
        last = left == 1 and level > 1
        key = ["source"] if last else ["source", "class", "group"]
        met = live.groupBy(*key).agg(F.transform(by_size(), lambda x: x["item"]).alias("items")).withColumn("out", _pivot(F.col("items")))
        met = materialise(met.select(*key, "out.rest", "out.done"), f"pivot{level}")
        done.append(met.select(F.explode("done").alias("d")).select("d.*"))
        if last:
            done.append(met.select("rest.uid", (F.col("rest.p") >= 0.5).cast("int").alias("up")))
            break
        live = met.select("source", "class", F.floor(F.col("group") / GROUP).alias("group"), F.col("rest").alias("item"))
        left = -(-left // GROUP) if left > 1 else 1
    ups = done[0]
    for x in done[1:]:
        ups = ups.unionByName(x)
    out = rows.join(ups.where("up = 1").select("uid", "up"), "uid", "left")
    return out.select("doc_id", "source", "h", "g", "dup", "size", "source_size", "target", (F.col("base") + F.coalesce("up", F.lit(0))).alias("copies"))


def mixed(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """The mix itself: the rows of docs, each as often as it is taken."""
    names = docs.columns
    own = ["__h", "__g"]
    take = copies(docs, weights, share, most).select(F.col("h").alias("__h"), F.col("g").alias("__g"), F.col("copies").alias("__n"))
    # Equal rows share a key: their copies are counted together and dealt to any of them in turn.
    take = materialise(take.groupBy(*own).agg(F.sum("__n").alias("__n")).where("__n > 0"), "taken")
    whole = [F.col(f"`{c}`") for c in names]
    rows = keyed(docs).groupBy(*own).agg(F.min_by(F.struct(*whole), F.xxhash64(*whole)).alias("__row"))
    return multiplied(rows.join(take, own), "__n", take.agg(F.max("__n")).first()[0] or 0, "__k").select("__row.*")
