"""The change requests most like each query, exactly, under a bounded plan of work.

The score of a pair is 3 for the same group, two terms that fall with the gap of the sizes, and twice the share of the query's title words that the
other has (`similarity.similarity`). Rows of a group stand in the order of both sizes at once (the bits of the two, scaled as the score scales
them, by turns), so that neighbours in it are alike in both; 8 of them are a leaf, 32 leaves a node, and so on,
each with the range of both sizes, and so does all of the table once more without groups. As both exponentials fall monotonically, a
node's ranges bound the scores of all its rows. Each query is taken through three waves, and no pair of a query with all rows ever exists:

1. it walks down both trees to the leaf of the best bound (to more of them if k needs it); the k-th best score there is its floor;
2. rows that share a word of at most `common` rows with it are found by the word, and looked at if their sizes let them reach the floor;
3. what is left shares only words of more rows, so their share of the title bounds the overlap: the query walks down the trees again and opens every node whose
   bound with that share, rounded like a score, is above the floor of the first two waves, or equals it while the node has a smaller key than the k-th best, so
   copies of one row are not all opened.

A query's waves are joins by node or by word; words of many rows are never joined, so no key of a join by words is hot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mergelens.operators import ranks
from mergelens.operators.similarity import similarity
from mergelens.operators.stats import per_group_cap
from mergelens.storage import table

LEAF, BITS = 3, 5
COMMON = 4096
#: Bits of each size that make the order, the value of the lowest one in additions, and how many additions count like one file.
DEPTH, CELL, FILE = 18, 8, 50


def by_turns(files, additions) -> Column:
    """The bits of both sizes by turns."""
    parts = [F.least(F.floor(F.greatest(c, F.lit(0)) / CELL), F.lit((1 << DEPTH) - 1)).cast("long") for c in (files * FILE, additions)]
    return sum((F.shiftleft(F.shiftright(p, i).bitwiseAND(F.lit(1)), 2 * i + j) for i in range(DEPTH) for j, p in enumerate(parts)), F.lit(0).cast("long"))


class Tree:
    """Rows in the order of their groups and sizes, and the ranges of their nodes level by level."""

    def __init__(self, rows: DataFrame, grouped: bool):
        rows = rows.where("_g is not null").withColumn("_k", F.col("_g")) if grouped else rows.withColumn("_k", F.lit(0))
        self.grouped = grouped
        placed = ranks.positions(rows.withColumn("_z", by_turns(F.col("_f"), F.col("_a"))), ["_k", "_z", "_f", "_a", "_id"], "_at")
        self.rows = placed.withColumn("_p", F.shiftright("_at", LEAF)).drop("_at", "_z")
        level = self.rows.select("_k", "_p", *[F.col(c).alias(f"_{s}{c}") for c in ("_f", "_a") for s in ("l", "u")], F.col("_id").alias("_least"))
        self.levels: list[DataFrame] = []
        last = placed.agg(F.max("_at")).first()[0]
        for i in range(max(1, 1 + -(-((last or 0).bit_length() - LEAF) // BITS))):
            own = level.withColumn("_p", F.shiftright("_p", BITS)) if i else level
            level = table(own.groupBy("_k", "_p").agg(F.min("_l_f").alias("_l_f"), F.max("_u_f").alias("_u_f"), F.min("_l_a").alias("_l_a"), F.max("_u_a").alias("_u_a"), F.min("_least").alias("_least")), "nodes")
            self.levels.append(level)

    def leaves(self, asked: DataFrame, best: int = 0) -> DataFrame:
        """asked (_q, _qg, _qf, _qa, _share, _floor, _last: the key of the k-th best) with the leaves (_k, _p) that may hold a better row, or with so many of the best."""
        gap = lambda q, c: F.greatest(F.col(f"_l{c}") - F.col(q), F.col(q) - F.col(f"_u{c}"), F.lit(0))
        bound = F.round(similarity(F.lit(self.grouped), gap("_qf", "_f"), gap("_qa", "_a"), F.col("_share")), 4)
        better = F.col("_floor").isNull() | (F.col("_bound") > F.col("_floor")) | ((F.col("_bound") == F.col("_floor")) & (F.col("_least") < F.col("_last")))
        found = asked.where("_qg is not null").withColumn("_k", F.col("_qg")) if self.grouped else asked.withColumn("_k", F.lit(0))
        found = found.withColumn("_up", F.lit(0).cast("long"))
        for level in reversed(self.levels):
            below = found.join(level.withColumn("_up", F.shiftright("_p", BITS)), ["_k", "_up"]).withColumn("_bound", bound)
            if best:
                below = per_group_cap(below, "_q", best, F.desc("_bound"), "_p")
            found = below.where(better).select(*asked.columns, "_k", F.col("_p").alias("_up"))
        return found.withColumnRenamed("_up", "_p")


def _best(pairs: DataFrame, titles: DataFrame, k: int) -> DataFrame:
    """_q, _id, score of the k best of pairs (_q, _qg, _qf, _qa, _id, _g, _f, _a, _t)."""
    overlap = F.coalesce(F.try_divide(F.size(F.array_intersect("_qt", "_t")).cast("double"), F.size("_qt").cast("double")), F.lit(0.0))
    same = F.coalesce(F.col("_qg") == F.col("_g"), F.lit(False))
    scored = pairs.where("_q <> _id").join(titles, "_q").select("_q", "_id", F.round(similarity(same, F.col("_qf") - F.col("_f"), F.col("_qa") - F.col("_a"), overlap), 4).alias("score"))
    return per_group_cap(scored.groupBy("_q", "_id").agg(F.max("score").alias("score")), "_q", k, F.desc("score"), "_id")


def similar(rows: DataFrame, queries: DataFrame, key: str, group: str, files: str, additions: str, title: str, k: int, common: int = COMMON) -> DataFrame:
    """The k rows most like each query, of all rows but itself: key, similar, score to 4 digits; ties to the smaller key.

    title: words, each counted once; missing sizes count as 0, a missing group is no group, a missing title has no words. Rows without a key take no part;
    rows that share one are one candidate, with the best of their scores."""

    def shaped(df: DataFrame, names: tuple[str, ...]) -> DataFrame:
        size = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(0).cast("long"))
        words = F.coalesce(F.array_compact(F.array_distinct(title)), F.array().cast("array<string>"))
        return df.where(F.col(key).isNotNull()).select(*[c.alias(n) for c, n in zip((F.col(key), F.col(group), size(files), size(additions), words), names, strict=True)])

    held = table(shaped(rows, ("_id", "_g", "_f", "_a", "_t")), "held")
    asked = table(shaped(queries, ("_q", "_qg", "_qf", "_qa", "_qt")).dropDuplicates(["_q"]), "asked")
    titles = asked.select("_q", "_qt")
    known = table(held.select(F.explode("_t").alias("_w")).groupBy("_w").agg(F.count("*").alias("_n")), "words")
    said = table(asked.select("_q", F.explode("_qt").alias("_w")).join(known, "_w"), "said")
    shares = said.groupBy("_q").agg(F.count_if(F.col("_n") > common).alias("_many"))
    trees = [Tree(held, True), Tree(held, False)]

    plain = asked.withColumns({"_share": F.lit(0.0), "_floor": F.lit(None).cast("double"), "_last": F.lit(None).cast(asked.schema["_q"].dataType)}).drop("_qt")
    opened = [tree.rows.join(tree.leaves(plain, 1 + k // ((1 << LEAF) - 1)), ["_k", "_p"]).drop("_k", "_p", "_last") for tree in trees]
    first = table(_best(opened[0].unionByName(opened[1]), titles, k), "first")

    def floors(found: DataFrame) -> DataFrame:
        last = F.max_by("_id", F.struct(-F.col("score"), F.col("_id")))
        return found.groupBy("_q").agg(F.count("*").alias("_n"), F.min("score").alias("_floor"), last.alias("_last")).where(F.col("_n") >= k).drop("_n")

    floored = asked.drop("_qt").join(floors(first), "_q", "left")
    rare = said.where(F.col("_n") <= common).select("_q", "_w")
    there = held.select("_id", "_g", "_f", "_a", F.explode("_t").alias("_w")).join(rare.select("_w").distinct(), "_w", "left_semi")
    close = similarity(F.coalesce(F.col("_qg") == F.col("_g"), F.lit(False)), F.col("_qf") - F.col("_f"), F.col("_qa") - F.col("_a"), F.lit(1.0))
    sharing = floored.join(rare, "_q").join(there, "_w").where((F.col("_q") != F.col("_id")) & (F.col("_floor").isNull() | (F.round(close, 4) > F.col("_floor")) | ((F.round(close, 4) == F.col("_floor")) & (F.col("_id") < F.col("_last")))))
    pairs = sharing.select("_q", "_id").distinct().join(asked.drop("_qt"), "_q").join(held, "_id")
    second = table(_best(pairs, titles, k), "second")

    both = first.unionByName(second).distinct()
    reached = floors(per_group_cap(both, "_q", k, F.desc("score"), "_id"))
    share = F.coalesce(F.col("_many") / F.nullif(F.size("_qt"), F.lit(0)).cast("double"), F.lit(0.0))
    left = table(asked.join(shares, "_q", "left").withColumn("_share", share).drop("_many", "_qt").join(reached, "_q", "left"), "left")
    more = [tree.rows.join(tree.leaves(left), ["_k", "_p"]).drop("_k", "_p") for tree in trees]
    apart = more[1].where(~F.coalesce(F.col("_qg") == F.col("_g"), F.lit(False)))
    third = table(_best(more[0].unionByName(apart), titles, k), "third")
    return per_group_cap(both.unionByName(third).distinct(), "_q", k, F.desc("score"), "_id").select(F.col("_q").alias(key), F.col("_id").alias("similar"), "score")
