"""N-gram Jaccard self-join of documents by the Chosen-Path method (Christiani, Pagh and Sivertsen, 2018).

Documents are sets of hashed shingles of ``width`` words (words: runs of bytes other than ASCII white space; a text of
fewer words is one shingle, one without words an empty set that links with nothing). Two documents link when the Jaccard
similarity of their sets is at least ``threshold``.

1. Equal texts form a class (128 bits of hash), which is handled once.
2. Each class's set is embedded as ``SKETCH`` MinHash tokens, of which a pair shares the share given by its similarity.
3. Each run splits all sets on the value of a sampled token, and goes on splitting every bucket of more than ``leaf`` sets on
   ``BRANCH`` sampled tokens, up to ``DEPTH`` times. The number of runs follows from the target recall (see ``runs_for``).
4. Small buckets are brute-forced on sketches. So are large ones of sets so much alike that a split leaves ``TIGHT`` of them together, and
   those still large at the last level; they are cut into blocks of bounded size that are paired with each other. A pair passes when its sketches agree in more than ``LOOSE`` of the tokens, which a
   pair at the threshold misses about once in a million. Of the passing pairs a bucket yields a spanning forest only.
5. Connected classes form candidate groups. Their shingle sets are gathered once, in blocks of bounded size, and every pair of
   a group is verified exactly. Blocks yield counts of links and spanning forests, never pairs.
6. Links' components and counts return to all documents by class; copies of a text count as links of each other.

No task holds more than two blocks, nothing but counts comes to the driver, and no join lacks an equality key. The work in one
group grows with the square of the number of its different texts, as does the number of links that are counted.

Nulls and edges: a null text is an empty set. Null ids form no exception: they link as others do and are last in choosing
the least id (a component of null ids only has a null component_id). Repeated rows count as copies. Extra columns play no role.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrane.llm import textvec as tv
from terrane.llm.common import arrow_rows, give_back, grouped, map_texts, materialise
from terrane.llm.components import components

WIDTH = 5
THRESHOLD = 0.8
RECALL = 0.9999
SKETCH = 64
LEAF = 128
BRANCH = 2
DEPTH = 4
BLOCK = 512
TIGHT = 0.5
LOOSE = 0.55
_A = tv.rand64(37, SKETCH) | np.uint64(1)
_B = tv.rand64(41, SKETCH)


def runs_for(recall: float, threshold: float, depth: int = DEPTH, branch: int = BRANCH) -> int:
    """Runs after which a pair at the threshold has met, with probability ``recall``, in a bucket of the deepest level."""
    meet = 1.0
    for _ in range(depth - 1):
        meet = 1 - (1 - threshold * meet) ** branch
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - threshold * meet)))


def sketch(sh: np.ndarray) -> np.ndarray:
    """SKETCH MinHash tokens of 32 bits of a set of hashes."""
    low = np.full(SKETCH, 2**64 - 1, np.uint64)
    for k in range(0, len(sh), 2048):
        np.minimum(low, (sh[k : k + 2048, None] * _A + _B).min(0), out=low)
    return (low >> np.uint64(32)).astype(np.uint32)


def shingle_sets(raw: np.ndarray, at: np.ndarray, width: int) -> list[np.ndarray]:
    h, first = tv.words(raw, at)
    return [np.unique(tv.shingles(h[a:b], width)) for a, b in zip(first[:-1], first[1:], strict=True)]


def text_keys(text: str = "text") -> list:
    """128 bits of hash of a text, as two longs; null texts have keys too."""
    return [F.xxhash64(F.lit(1), F.col(text)).alias("k1"), F.xxhash64(F.lit(2), F.col(text)).alias("k2")]


def forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of a symmetric boolean matrix."""
    n, seen, out = len(linked), np.zeros(len(linked), bool), []
    for s in range(n):
        if seen[s]:
            continue
        seen[s] = True
        front = [s]
        while front:
            x = front.pop()
            new = np.flatnonzero(linked[x] & ~seen)
            seen[new] = True
            out += [(x, int(y)) for y in new]
            front += new.tolist()
    return out


def in_blocks(df: DataFrame, group: str, n: str, member: str, block: int) -> DataFrame:
    """Each row once for every pair of blocks that its own block is in: columns bi <= bj and mine, the row's own block.

    Groups of up to block rows have the one pair (0, 0). n: the rows of the row's group. Every key (group, bi, bj) has about
    2 * block rows at most.
    """
    blocks = F.greatest(F.lit(1), F.ceil(F.col(n) / F.lit(block))).cast("int")
    df = df.withColumn("nb", blocks).withColumn("mine", F.pmod(F.xxhash64(F.lit(43), member), F.col("nb")).cast("int"))
    df = df.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    return df.withColumn("bi", F.least("mine", "other")).withColumn("bj", F.greatest("mine", "other")).drop("other", "nb")


def candidate_edges(classes: DataFrame, threshold: float, recall: float) -> DataFrame:
    """(u, v): spanning forests of the pairs that meet in a bucket and have similar sketches. classes: cid, nsh, sketch."""
    loose = min(LOOSE, threshold - 0.25) if threshold > 0.3 else 0.0
    token = lambda c: F.substring("sketch", c * 4 + 1, 4)
    run_count = runs_for(recall, threshold)
    # The root of run r splits on token r: distinct tokens in all runs.
    start = F.posexplode(F.array(*[F.xxhash64(F.lit(r), token(F.lit(r))) for r in range(min(run_count, SKETCH))]))
    live = classes.select("cid", start.alias("run", "path")).select("cid", "path")
    leaves = []
    for level in range(1, DEPTH + 1):
        sizes = live.groupBy("path").agg(F.count("*").alias("n")).where("n > 1")
        live = materialise(live.join(sizes, "path"), f"paths{level}")
        last = level == DEPTH
        leaves.append(live if last else live.where(F.col("n") <= LEAF))
        if last:
            break
        big = live.where(F.col("n") > LEAF)
        if big.isEmpty():
            break
        pick = F.array_distinct(F.array(*[F.pmod(F.xxhash64(F.lit(b), "path"), F.lit(SKETCH)).cast("int") for b in range(BRANCH)]))
        split = big.join(classes.select("cid", "sketch"), "cid").withColumn("c", F.explode(pick))
        split = materialise(split.select("cid", "path", "n", "c", F.xxhash64("path", "c", token(F.col("c"))).alias("next")), f"split{level}")
        shares = split.groupBy("path", "c", "next").agg(F.count("*").alias("k"), F.max("n").alias("n")).groupBy("path", "c").agg((F.max("k") / F.max("n")).alias("share"))
        shares = materialise(shares.groupBy("path").agg((F.min("share") >= TIGHT).alias("tight")), "shares")
        leaves.append(big.join(shares.where("tight"), "path", "left_semi"))
        live = split.join(shares.where("NOT tight"), "path", "left_semi").select("cid", F.col("next").alias("path"))
    met = leaves[0]
    for x in leaves[1:]:
        met = met.unionByName(x)
    met = in_blocks(met, "path", "n", "cid", BLOCK).join(classes.select("cid", "nsh", "sketch"), "cid")
    met = met.select("path", "bi", "bj", "mine", "cid", "nsh", "sketch").repartition("path", "bi", "bj").sortWithinPartitions("path", "bi", "bj", "cid")

    def brute(batches):
        for _, t in grouped(batches, ["path", "bi", "bj"]):
            cid, n, mine = (t.column(c).to_numpy() for c in ("cid", "nsh", "mine"))
            s = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint32).reshape(len(cid), SKETCH)
            agree = np.zeros((len(cid), len(cid)), np.uint8)
            for c in range(SKETCH):
                agree += s[:, c, None] == s[None, :, c]
            ok = (agree > loose * SKETCH) & (np.minimum(n[:, None], n) >= threshold * np.maximum(n[:, None], n))
            if t.column("bi")[0].as_py() != t.column("bj")[0].as_py():
                ok &= mine[:, None] != mine
            np.fill_diagonal(ok, False)
            if ok.any() and (e := forest(ok)):
                u, v = np.array(e).T
                yield pa.RecordBatch.from_arrays([pa.array(cid[u]), pa.array(cid[v])], ["u", "v"])
        give_back()

    return met.mapInArrow(brute, "u long, v long").distinct()


def overlaps(a: list[np.ndarray], b: list[np.ndarray] | None) -> np.ndarray:
    """Sizes of the intersections of sets: all of a with all of b, or with each other."""
    sets = a if b is None else a + b
    values, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    new = np.r_[True, values[1:] != values[:-1]] if len(values) else np.zeros(0, bool)
    number = np.cumsum(new) - 1
    shared = np.bincount(number) > 1
    keep = shared[number]
    column = (np.cumsum(shared) - 1)[number[keep]]
    owner = owner[keep]
    m = len(a)
    total = np.zeros((m, m if b is None else len(b)), np.float32)
    wide = 4096
    bounds = np.searchsorted(column, np.arange(0, (column[-1] + 1 if len(column) else 0) + wide, wide))
    for k, (i, j) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
        if j > i:
            x = np.zeros((len(sets), int(column[j - 1]) - k * wide + 1), np.float32)
            x[owner[i:j], column[i:j] - k * wide] = 1
            total += x[:m] @ (x[:m] if b is None else x[m:]).T
    return total


def verified(members: DataFrame, threshold: float) -> DataFrame:
    """(u, v, n): rows with v null give the links n that class u has in one block; others are edges of spanning forests.

    members: path (the group), bi, bj, mine, cid, copies, sh (sorted distinct hashes as bytes).
    """

    def compare(batches):
        for (_, bi, bj), t in grouped(batches, ["path", "bi", "bj"]):
            cid, mine, copies = (t.column(c).to_numpy() for c in ("cid", "mine", "copies"))
            first = np.r_[True, cid[1:] != cid[:-1]]  # rows that repeat with the same id and text
            where = np.flatnonzero(first)
            cid, mine, copies = cid[where], mine[where], copies[where]
            sets = [np.frombuffer(x, np.uint64) for x in t.column("sh").take(pa.array(where)).to_pylist()]
            left = np.flatnonzero(mine == bi)
            right = left if bi == bj else np.flatnonzero(mine == bj)
            if not len(left) or not len(right):
                continue
            size = np.array([len(x) for x in sets], np.float64)
            both = overlaps([sets[i] for i in left], None if bi == bj else [sets[i] for i in right]).astype(np.float64)
            union = size[left][:, None] + size[right][None] - both
            ok = (both > 0) & (both / np.maximum(union, 1) >= threshold)
            if bi == bj:
                np.fill_diagonal(ok, False)
            if not ok.any():
                continue
            links = [(left, ok @ copies[right].astype(np.float64))] + ([] if bi == bj else [(right, ok.T @ copies[left].astype(np.float64))])
            whole = ok if bi == bj else np.block([[np.zeros((len(left),) * 2, bool), ok], [ok.T, np.zeros((len(right),) * 2, bool)]])
            ids = cid[left] if bi == bj else np.r_[cid[left], cid[right]]
            u, v = np.array(forest(whole)).T
            counted = np.concatenate([cid[i][x > 0] for i, x in links])
            n = np.concatenate([x[x > 0] for _, x in links]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.r_[counted, ids[u]]), pa.concat_arrays([pa.nulls(len(n), pa.int64()), pa.array(ids[v], pa.int64())]), pa.array(np.r_[n, np.zeros(len(u), np.int64)])], ["u", "v", "n"])
        give_back()

    rows = members.select("path", "bi", "bj", "mine", "cid", "copies", "sh").repartition("path", "bi", "bj").sortWithinPartitions("path", "bi", "bj", "cid")
    return rows.mapInArrow(compare, "u long, v long, n long")


def join(docs: DataFrame, width: int = WIDTH, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[DataFrame, DataFrame]:
    """Two tables: documents (doc_id, k1, k2, has_words), one row each, and classes of equal texts that have words (k1, k2, copies, doc_id, links, root_k1,
    root_k2, component_id): the least id of the class, links of each of its documents, and the component's class and least id."""
    arrow_rows(docs.sparkSession)
    source = docs.select("doc_id", "text", *text_keys())

    def make(raw, at):
        sets = shingle_sets(raw, at, width)
        return [pa.array([len(s) for s in sets], pa.int64()), pa.array([sketch(s).tobytes() for s in sets], pa.binary())]

    made = map_texts(source, "text", [T.StructField("nsh", T.LongType()), T.StructField("sketch", T.BinaryType())], make, keep=["doc_id", "k1", "k2"])
    rows = materialise(made, "sketches")
    classes = rows.where("nsh > 0").groupBy("k1", "k2").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), F.first("nsh").alias("nsh"), F.first("sketch").alias("sketch"))
    classes = materialise(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")

    groups = components(candidate_edges(classes, threshold, recall)).select(F.col("node").alias("cid"), F.col("root").alias("path"))
    groups = materialise(groups.join(groups.groupBy("path").agg(F.count("*").alias("n")), "path").join(classes.select("cid", "k1", "k2", "doc_id", "copies"), "cid"), "groups")
    # One document stands for each class: the text with the class's keys and least id.
    same = ["k1", "k2", "id", "none"]
    key = lambda df: df.withColumn("id", F.coalesce("doc_id", F.lit(0).cast("long"))).withColumn("none", F.col("doc_id").isNull()).drop("doc_id")
    found = key(source).join(key(groups).hint("merge"), same).select("path", "n", "cid", "copies", "text")
    sets = lambda raw, at: [pa.array([s.tobytes() for s in shingle_sets(raw, at, width)], pa.binary())]
    sets = map_texts(found, "text", [T.StructField("sh", T.BinaryType())], sets, keep=["path", "n", "cid", "copies"])
    links = materialise(verified(in_blocks(sets, "path", "n", "cid", BLOCK), threshold), "links")

    linked = components(links.where("v IS NOT NULL").select("u", "v")).withColumnRenamed("node", "cid")
    counts = links.where("v IS NULL").groupBy(F.col("u").alias("cid")).agg(F.sum("n").alias("n"))
    every = classes.select("cid", "k1", "k2", "copies", "doc_id").join(linked, "cid", "left").join(counts, "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    every = materialise(every.select("cid", "k1", "k2", "copies", "doc_id", "root", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("links")), "every")
    best = every.groupBy("root").agg(F.min_by(F.struct("cid", "k1", "k2", "doc_id"), F.struct(F.col("doc_id").isNull(), "doc_id", "cid")).alias("b"))
    best = best.select("root", F.col("b.k1").alias("root_k1"), F.col("b.k2").alias("root_k2"), F.col("b.doc_id").alias("component_id"))
    return rows.select("doc_id", "k1", "k2", (F.col("nsh") > 0).alias("has_words")), every.join(best, "root").drop("root", "cid")


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, class_id, n_links, component_id, kept), one row for each document.

    class_id: the least id among equal texts. n_links: other documents linked directly. component_id: the least id reachable by
    links, itself included. kept: doc_id = component_id. A document without words is alone in its class and component.
    """
    rows, classes = join(docs, **options)
    classes = classes.select("k1", "k2", F.col("doc_id").alias("class_id"), "links", "component_id")
    out = rows.join(classes, ["k1", "k2"], "left")
    own = F.col("has_words")
    return out.select(
        "doc_id",
        F.when(own, F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"),
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        F.when(own, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
    ).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """docs without all but one document of each component: the one of the least id stays, one row of it. Those without words all stay."""
    rows, classes = join(docs, **options)
    stay = classes.where("k1 = root_k1 AND k2 = root_k2").select("k1", "k2", F.coalesce("doc_id", F.lit(0).cast("long")).alias("__id"), F.col("doc_id").isNull().alias("__none"))
    names = docs.columns
    keyed = docs.select("*", *[k.alias(f"__{i}") for i, k in enumerate(text_keys())], F.coalesce("doc_id", F.lit(0).cast("long")).alias("__id"), F.col("doc_id").isNull().alias("__none"))
    wordless = ~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    on = ["__0", "__1", "__id", "__none"]
    kept = keyed.where(~wordless).join(stay.withColumnsRenamed({"k1": "__0", "k2": "__1"}), on)
    own = [F.col(f"`{c}`") for c in names]
    kept = kept.groupBy(on).agg(F.min_by(F.struct(*own), F.xxhash64(*own)).alias("__row")).select("__row.*")
    return kept.unionByName(docs.where(wordless))
