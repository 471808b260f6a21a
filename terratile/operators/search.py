"""Vector search, sampling, centroids and evaluation of rankings."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terratile.functions.columns import inner_product
from terratile.operators import scan
from terratile.storage import stage_table

SEED_BYTES = 8 << 20  # of a block of seeds and of the best rows kept for it
PRODUCTS = 1 << 20  # scores that a task works out at once


def top_k(vectors: DataFrame, seeds: DataFrame, k: int, keep_self: bool = False) -> DataFrame:
    """Per seed (query_id, query) the k vectors of largest inner product, with ``rank``; ties by vec_id.

    Seeds go out in blocks of ``SEED_BYTES`` at most, one matrix per block;
    a task multiplies it with its vectors, a batch of them at a time, and keeps
    k rows a seed, so no pair of rows is ever formed as a row of a join.
    Scores are summed in element order for the rows that can be among the k.
    Rows without a vector, and seeds that have another length, have no score.
    """
    width = seeds.agg(F.max(F.size("query"))).first()[0] or 0
    rows = max(1, SEED_BYTES // (8 * max(width, 1) + 32 * k))
    count = seeds.count()
    blocks = max(1, -(-count // rows))
    block = F.pmod(F.xxhash64("query_id"), F.lit(blocks))
    found = [_best_of_block(vectors, seeds.where(block == i).collect(), k, keep_self) for i in range(blocks)]
    if blocks > 1:
        found = [stage_table(f, "nearest") for f in found]
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return reduce(DataFrame.union, found).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _best_of_block(vectors: DataFrame, seeds: list, k: int, keep_self: bool) -> DataFrame:
    """(query_id, vec_id, label, score): for each task the k best rows of each seed of one block, and what may tie with them."""
    usable = [s for s in seeds if s.query is not None and None not in s.query]
    by_width = {n: [s for s in usable if len(s.query) == n] for n in {len(s.query) for s in usable}}
    packed = {n: (np.array([s.query_id for s in of], np.int64), np.array([s.query for s in of], float).reshape(len(of), n)) for n, of in by_width.items()}
    shared = vectors.sparkSession.sparkContext.broadcast(packed)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple] = {}
        for batch in batches:
            lists = batch.column("embedding")
            sizes = np.diff(lists.offsets.to_numpy())
            for n, (ids, queries) in shared.value.items():
                at = np.flatnonzero(sizes == n)
                for a in range(0, len(at), step := max(1, PRODUCTS // max(len(ids), n, 1))):
                    part = batch.take(pa.array(at[a : a + step]))
                    x = part.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(part.num_rows, n)
                    best[n] = _merged(best.get(n), part.select(["vec_id", "label"]), x, ids, queries, k, keep_self)
        for n, (seed, score, rows, _) in best.items():
            ids = shared.value[n][0]
            yield pa.record_batch([pa.array(ids[seed]), rows.column("vec_id"), rows.column("label"), pa.array(score)], names=["query_id", "vec_id", "label", "score"])

    whole = ~F.exists("embedding", lambda x: x.isNull())
    plain = vectors.where(whole).select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding")
    return plain.mapInArrow(search, f"query_id long, vec_id long, label {plain.schema['label'].dataType.simpleString()}, score double")


def _merged(old: tuple | None, rows: pa.RecordBatch, x: np.ndarray, ids: np.ndarray, queries: np.ndarray, k: int, keep_self: bool) -> tuple:
    """(seed number, score, rows, least score to be kept per seed) of the k best so far and a new batch of vectors ``x``."""
    seed, score, kept, least = old or (np.zeros(0, np.int64), np.zeros(0), rows.slice(0, 0), np.full(len(ids), -np.inf))
    product = queries @ x.T
    slack = 1e-12 * np.linalg.norm(queries, axis=1)[:, None] * np.linalg.norm(x, axis=1)  # a sum in another order differs by less
    open_ = product + slack >= least[:, None]
    vec_id = rows.column("vec_id").to_numpy(zero_copy_only=False)
    if not keep_self:
        open_ &= vec_id != ids[:, None]
    if product.shape[1] > k:  # of many, only what can be among the batch's own k best
        low = np.where(open_, product - slack, -np.inf)
        open_ &= product + slack >= np.partition(low, -k, axis=1)[:, -k][:, None]
    row, col = np.nonzero(open_)
    exact = np.zeros(len(row))
    for d in range(x.shape[1]):  # in element order
        exact += queries[row, d] * x[col, d]
    seed, score = np.append(seed, row), np.append(score, exact)
    kept = pa.concat_batches([kept, rows.take(pa.array(col))])
    order = np.lexsort((kept.column("vec_id").to_numpy(zero_copy_only=False), -score, seed))
    seed = seed[order]
    order = order[np.arange(len(seed)) - np.searchsorted(seed, seed) < k]
    kept, score = kept.take(pa.array(order)), score[order]
    seed = seed[np.arange(len(seed)) - np.searchsorted(seed, seed) < k]
    full = np.bincount(seed, minlength=len(ids)) == k
    least = np.full(len(ids), -np.inf)
    np.minimum.at(lowest := np.full(len(ids), np.inf), seed, score)
    least[full] = lowest[full]
    return seed, score, kept, least


def similar_to(vectors: DataFrame, seeds: DataFrame, k: int) -> DataFrame:
    """Per seed (vec_id) the k other vectors most like it; a seed without a vector finds nothing."""
    asked = vectors.join(seeds.select("vec_id").distinct(), "vec_id", "left_semi")
    return top_k(vectors, asked.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query")), k)


def centroids(vectors: DataFrame) -> DataFrame:
    """Mean of each label's vectors, by element: (label, pos, value, n)."""
    cells = vectors.select("label", F.posexplode("embedding").alias("pos", "x"))
    return cells.groupBy("label", "pos").agg(F.avg(F.col("x").cast("double")).alias("value"), F.count("*").alias("n"))


def stratified_sample(rows: DataFrame, group: str, key: str, n: int, floor: int) -> DataFrame:
    """About n rows: ``floor`` of each group, then in proportion; picked by a hash of the key."""
    sizes = rows.groupBy(group).agg(F.count("*").alias("size"))
    total = sizes.agg(F.sum("size").alias("total"), F.count("*").alias("groups"))
    spare = F.greatest(F.lit(n) - F.lit(floor) * F.col("groups"), F.lit(0))
    take = F.least("size", F.lit(floor) + F.floor(spare * F.col("size") / F.col("total")))
    alloc = sizes.crossJoin(F.broadcast(total)).select(group, take.alias("take"))  # total is one row
    order = Window.partitionBy(group).orderBy(F.md5(F.col(key).cast("string")), key)
    # no group gives more than this, so Spark cuts each partition's rows before the shuffle
    ranked = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= max(n, floor))
    return ranked.join(alloc, group).where(F.col("rank") <= F.col("take")).select(group, key, "rank")


def ranking_metrics(ranked: DataFrame, k: int) -> DataFrame:
    """Per query: precision, and discounted gain against the ideal order of the grades met, at k."""
    gain = F.col("grade") / F.log2(F.col("rank") + 1)
    ideal = Window.partitionBy("query_id").orderBy(F.desc("grade"), "rank")
    rows = ranked.withColumn("best", F.row_number().over(ideal)).where(F.col("rank") <= k)
    out = rows.groupBy("query_id").agg(
        (F.count_if(F.col("grade") > 0) / F.lit(k)).alias("precision"), F.sum(gain).alias("dcg"), F.sum(F.col("grade") / F.log2(F.col("best") + 1)).alias("idcg")
    )
    return out.select("query_id", "precision", F.when(F.col("idcg") > 0, F.round(F.col("dcg") / F.col("idcg"), 6)).otherwise(0.0).alias("ndcg"))


def ranking_metrics_at(ranked: DataFrame, ks: list[int]) -> DataFrame:
    """Per query and k of ``ks``, over its graded list (query_id, rank, grade): precision, recall of all graded above 0 (0 if none is), discounted gain against the ideal order."""
    ideal = Window.partitionBy("query_id").orderBy(F.desc("grade"), "rank")
    marked = ranked.withColumn("best", F.row_number().over(ideal)).select("query_id", "rank", "best", "grade", F.explode(F.array(*map(F.lit, ks))).alias("k"))
    hit, top = F.col("grade") > 0, F.col("rank") <= F.col("k")
    gain = lambda at: F.sum(F.when(F.col(at) <= F.col("k"), F.col("grade") / F.log2(F.col(at) + 1)))
    out = marked.groupBy("query_id", "k").agg(F.count_if(hit & top).alias("hits"), F.count_if(hit).alias("n_relevant"), gain("rank").alias("dcg"), gain("best").alias("idcg"))
    return out.select(
        "query_id", "k", (F.col("hits") / F.col("k")).alias("precision"), F.when(F.col("n_relevant") > 0, F.col("hits") / F.col("n_relevant")).otherwise(0.0).alias("recall"),
        F.when(F.col("idcg") > 0, F.col("dcg") / F.col("idcg")).otherwise(0.0).alias("ndcg"),
    )


def neighbour_overlap(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """Per query of two lists (query_id, vec_id, rank): how many of the first k they share, that share of k, and whether their first is the same."""
    left, right = (x.where(F.col("rank") <= k).select("query_id", "vec_id", F.col("rank").alias(n)) for x, n in ((a, "rank_a"), (b, "rank_b")))
    both = left.join(right, ["query_id", "vec_id"], "full")
    out = both.groupBy("query_id").agg(F.count_if(F.col("rank_a").isNotNull() & F.col("rank_b").isNotNull()).alias("shared"), F.max((F.coalesce("rank_a", F.lit(0)) == 1) & (F.coalesce("rank_b", F.lit(0)) == 1)).alias("same_first"))
    return out.select("query_id", "shared", (F.col("shared") / k).alias("overlap"), "same_first")


def index_check(vectors: DataFrame, catalogue: DataFrame, earlier: DataFrame, dim: int) -> DataFrame:
    """One row: size of the index (vec_id, embedding) and of the catalogue (vec_id, tile_id), whether they agree, vectors of another length, whether ids run from 0 without gaps or repeats, catalogue ids without a vector, earlier (vec_id, tile_id) pairs that are gone."""
    index = vectors.agg(F.count("*").alias("n"), F.count_if(F.coalesce(F.size("embedding"), F.lit(-1)) != dim).alias("n_other_length"), F.min("vec_id").alias("first"), F.max("vec_id").alias("last"))
    ids = vectors.select("vec_id").distinct().agg(F.count("*").alias("n_ids"))
    known = catalogue.where("vec_id IS NOT NULL")
    lost = earlier.join(known.select("vec_id", "tile_id").distinct(), ["vec_id", "tile_id"], "left_anti").agg(F.count("*").alias("n_lost_pairs"))
    bare = known.join(vectors.select("vec_id"), "vec_id", "left_anti").agg(F.count("*").alias("n_without_vector"))
    one = index.crossJoin(ids).crossJoin(known.agg(F.count("*").alias("n_catalogue"))).crossJoin(lost).crossJoin(bare)  # one row each
    whole = (F.col("first") == 0) & (F.col("last") == F.col("n") - 1) & (F.col("n_ids") == F.col("n"))
    return one.select("n", "n_catalogue", (F.col("n") == F.col("n_catalogue")).alias("agrees"), "n_other_length", F.coalesce(whole, F.lit(True)).alias("contiguous"), "n_without_vector", "n_lost_pairs")


def ranked_precision(rows: DataFrame, orders: dict[str, Column], key: str, ks: list[int]) -> DataFrame:
    """Per order (name -> score, best first) of rows with ``hit``: n, n_true, average precision over the hits, and ``at_<k>``, the share of hits among the first k (null if there are fewer)."""
    out = None
    for name, score in orders.items():
        hit = F.col("hit").cast("int")
        run = scan.running(rows.select(key, "hit", score.alias("_score")), [], [F.desc("_score"), F.col(key)], {"tp": hit, "at": F.lit(1)})
        tops = [F.when(F.max("at") >= k, F.max(F.when(F.col("at") == k, F.col("tp"))) / k).alias(f"at_{k}") for k in ks]
        one = run.agg(F.count("*").alias("n"), F.sum(hit).alias("n_true"), F.avg(F.when(F.col("hit"), F.col("tp") / F.col("at"))).alias("ap"), *tops).select(F.lit(name).alias("ordered_by"), "*")
        out = one if out is None else out.union(one)
    return out


def confusion(rows: DataFrame, truth: str, guess: str) -> DataFrame:
    """Counts, precision, recall, F1, IoU and Cohen's kappa of two 0/1 columns."""
    t, g = F.col(truth) == 1, F.col(guess) == 1
    n = rows.agg(F.count_if(t & g).alias("tp"), F.count_if(~t & g).alias("fp"), F.count_if(t & ~g).alias("fn"), F.count_if(~t & ~g).alias("tn"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    total = tp + fp + fn + tn
    chance = ((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn)) / (total * total)
    over = lambda a, b: F.when(b > 0, F.round(a / b, 6))
    return n.select(
        "tp", "fp", "fn", "tn", over(tp, tp + fp).alias("precision"), over(tp, tp + fn).alias("recall"),
        over(2 * tp, 2 * tp + fp + fn).alias("f1"), over(tp, tp + fp + fn).alias("iou"), F.round(((tp + tn) / total - chance) / (1 - chance), 6).alias("kappa"),
    )


def ranked_hits(detections: DataFrame) -> DataFrame:
    """Detections with running hits ``tp`` and position ``n`` in their class, best score first, and the class's hits ``n_true``."""
    hit = F.col("hit").cast("int")
    rows = scan.running(detections, ["class_id"], [F.desc("score"), F.col("det_id")], {"tp": hit, "n": F.lit(1)})
    return rows.join(detections.groupBy("class_id").agg(F.sum(hit).alias("n_true")), "class_id")


def average_precision(detections: DataFrame) -> DataFrame:
    """Per class the all-point average precision of scored hits (area under the precision envelope)."""
    rows = ranked_hits(detections).withColumn("precision", F.col("tp") / F.col("n"))
    rows = scan.running(rows, ["class_id"], [F.col("score"), F.desc("det_id")], maxima={"envelope": F.col("precision")}).where("hit")
    return rows.groupBy("class_id").agg(F.count("*").alias("n_true"), F.round(F.sum(F.col("envelope") / F.col("n_true")), 6).alias("ap"))


def prefix_above(ranked: DataFrame, least: float) -> DataFrame:
    """Per query the ranks before the first score below ``least`` (a later rise does not count)."""
    cut = ranked.groupBy("query_id").agg(F.min(F.when(F.col("score") < least, F.col("rank"))).alias("cut"))
    return ranked.join(cut, "query_id").where(F.col("cut").isNull() | (F.col("rank") < F.col("cut"))).drop("cut")


def collapse_near(ranked: DataFrame, vectors: DataFrame, least: float = 0.97) -> DataFrame:
    """In rank order, ``kept`` is false for a row whose inner product with a kept row of the query reaches ``least``.

    A query's list is as long as the k it was cut at; it is folded in place.
    """
    lists = ranked.join(vectors.select("vec_id", "embedding"), "vec_id").groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "vec_id", "embedding"))).alias("items")
    )
    none = F.expr("cast(array() as array<struct<rank:int,vec_id:bigint,embedding:array<float>>>)")
    kept = F.aggregate(
        "items", none, lambda acc, x: F.when(F.exists(acc, lambda y: inner_product(y["embedding"], x["embedding"]) >= least), acc).otherwise(F.array_append(acc, x))
    )
    rows = lists.select("query_id", F.transform(kept, lambda x: x["vec_id"]).alias("ids"), F.explode("items").alias("i"))
    return rows.select("query_id", "i.rank", "i.vec_id", F.array_contains("ids", F.col("i.vec_id")).alias("kept"))
