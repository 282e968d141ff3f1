"""Exact ranked lexical search by branch and bound over hierarchical max trees.

Documents that have a term stand in ascending order of doc_id (missing ids last, further ties by a hash of the text) and get places without gaps.
4,096 places are a segment. For each term and segment the index keeps the parts of scores that do not depend on the term's weight, with
their places, and a tree of maxima over ranges of 16 and 256 places and over the segment. Weights are never negative, so for a query the
sum over its terms of weight times maximum bounds every score in a range from above.

All segments' bounds come first, from the trees' roots by one aggregate. Each query opens its segment of the highest bound, the k-th best
score there is its floor, and of all others it opens those whose bound reaches the floor. Within a segment a heap gives the node of the
highest bound, which is opened until no bound reaches the k-th best score so far; nodes whose bound equals it are opened too, as an
earlier place wins a tie. Queries come in blocks of a stated size, and a task holds one segment for one block, with the block's terms only.

Only terms that some query has are indexed, and the few that share a hash with one: texts are filtered by a bitmap of 2^20 bits, however
many terms the queries have, and joins by the term itself come after it. Null texts and texts without terms have no place and no score. Items of equal id are one query that has the terms of all;
items without terms have no rows; a missing item id is an id of its own. Repeated documents are documents of their own. Other columns are not read.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mergelens.operators import ranks
from mergelens.operators.stats import per_group_cap

from .common import mapped, read, slices, table
from .words import cut, kinds

#: Fixed values of the terms: all ASCII but digits and letters stands between them.
BETWEEN = kinds([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
#: Fixed values of the score: 50 and the share of a document's length, and its weight in the divisor.
LEAST, SHARE, SCALE = 50, 50, 20
FAN, LEVELS = 16, 3
SEGMENT = FAN**LEVELS
BITS = 1 << 20
BLOCK = 512


def _terms(docs: DataFrame, keys: list[str], text: str, wanted: bytes | None = None) -> DataFrame:
    """keys, n (terms with repeats), terms and times of each row; of a term only if its bit in wanted is set."""
    rows = docs.select(*keys, F.col(text).cast("string").alias("_text"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    at = len(keys)

    def run(batches):
        bits = None if wanted is None else np.unpackbits(np.frombuffer(wanted, np.uint8)).astype(bool)
        for batch in slices(batches, at):
            words, starts, _ = cut(batch.column(at), BETWEEN)
            coded = words.dictionary_encode()
            known = coded.dictionary.to_numpy(zero_copy_only=False)
            codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            owner = np.repeat(np.arange(batch.num_rows), np.diff(starts))
            if bits is not None:
                keep = np.fromiter((bits[zlib.crc32(t.encode()) % BITS] for t in known), bool, len(known))[codes]
                codes, owner = codes[keep], owner[keep]
            found, times = np.unique(owner * max(len(known), 1) + codes, return_counts=True)
            owner, codes = np.divmod(found, max(len(known), 1))
            ends = pa.array(np.searchsorted(owner, np.arange(batch.num_rows + 1)), pa.int32())
            terms = pa.ListArray.from_arrays(ends, coded.dictionary.take(pa.array(codes)))
            times = pa.ListArray.from_arrays(ends, pa.array(times, pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(np.diff(starts), pa.int64()), terms, times], names=[*keys, "n", "terms", "times"])

    return rows.transform(mapped, run, f"{kept}, n bigint, terms array<string>, times array<bigint>")


@dataclass
class Index:
    """placed: doc_id, n and terms by position; lexicon: term, df; trees: of each term and segment; documents and length in all."""

    placed: DataFrame
    lexicon: DataFrame
    trees: DataFrame
    documents: int
    length: int


def queries_of(items: DataFrame, item: str = "item_id", text: str = "text") -> DataFrame:
    """query, a number, item and its distinct terms."""
    found = _terms(items, [item], text).groupBy(item).agg(F.array_distinct(F.flatten(F.collect_list("terms"))).alias("terms")).where(F.size("terms") > 0)
    return table(found.withColumn("query", F.monotonically_increasing_id()), "queries")


def build(docs: DataFrame, queries: DataFrame, key: str = "doc_id", text: str = "text") -> Index:
    """The index of docs for the terms of queries."""
    term = queries.select(F.explode("terms").alias("term")).distinct()
    bits = np.zeros(BITS, np.uint8)
    bits[[r[0] for r in term.select((F.crc32(F.col("term").cast("binary")) % BITS).cast("int")).distinct().collect()]] = 1  # BITS rows at most
    keyed = docs.select(F.col(key).alias("doc_id"), F.xxhash64(F.col(text).cast("string")).alias("_tie"), F.col(text).alias("_text"))
    counted = _terms(keyed, ["doc_id", "_tie"], "_text", np.packbits(bits).tobytes()).where("n > 0")
    placed = table(ranks.positions(counted, [F.asc_nulls_last("doc_id"), "_tie"]).select("position", "doc_id", "n", "terms", "times"), "placed")
    all_ = placed.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    documents, length = all_[0], max(all_[1], 1)
    df = placed.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    lexicon = table(df.join(term, "term", "left_semi"), "lexicon")
    out = pa.schema([("segment", pa.int64()), ("term", pa.string()), ("peak", pa.int64()), ("tree", pa.binary()), ("places", pa.binary()), ("parts", pa.binary())])

    def plant(group: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment = group[0].as_py()
        names, codes, places, parts = {}, [], [], []
        for batch in batches:
            lists, times = batch.column("terms"), batch.column("times")
            coded = lists.flatten().dictionary_encode()
            number = np.array([names.setdefault(t, len(names)) for t in coded.dictionary.to_pylist()], np.int64)
            sizes = np.diff(lists.offsets.to_numpy())
            tf = times.flatten().to_numpy(zero_copy_only=False)
            m = np.array([LEAST + SHARE * n * documents // length for n in batch.column("n").to_pylist()], np.int64)
            codes.append(number[coded.indices.to_numpy(zero_copy_only=False)] if len(coded) else np.zeros(0, np.int64))
            places.append(np.repeat(batch.column("position").to_numpy() % SEGMENT, sizes))
            parts.append(np.array(1_000_000_000 * tf // (1000 * tf + SCALE * np.repeat(m, sizes)), np.int64))
        code, place, part = map(np.concatenate, (codes, places, parts))
        order = np.lexsort((place, code))
        code, place, part = code[order], place[order], part[order]
        edges, terms = np.searchsorted(code, np.arange(len(names) + 1)).tolist(), list(names)
        for at in range(0, len(terms), 256):
            rows = []
            for i in range(at, min(at + 256, len(terms))):
                where, what = place[edges[i] : edges[i + 1]], part[edges[i] : edges[i + 1]]
                tree = grown(where, what)
                rows.append((segment, terms[i], int(what.max()), tree.astype("<u4").tobytes(), where.astype("<u2").tobytes(), what.astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), out, strict=True)], schema=out)

    dealt = placed.select(F.floor(F.col("position") / SEGMENT).cast("long").alias("segment"), "position", "n", "terms", "times")
    trees = dealt.groupBy("segment").applyInArrow(plant, "segment long, term string, peak long, tree binary, places binary, parts binary")
    return Index(placed, lexicon, table(trees, "trees"), documents, length)


def grown(places: np.ndarray, parts: np.ndarray) -> np.ndarray:
    """The maxima over ranges of a segment, from the finest level to the one below the root, one after another."""
    level = np.zeros(SEGMENT, np.int64)
    level[places] = parts
    out = []
    for _ in range(LEVELS - 1):
        level = level.reshape(-1, FAN).max(axis=1)
        out.append(level)
    return np.concatenate(out)


def best_first(weights: np.ndarray, trees: list[np.ndarray], leaves: np.ndarray, k: int, floor: int = 0, opened: list | None = None) -> list[tuple[int, int]]:
    """(score, place) of a segment's k best with a score above 0 and not below the floor, ties to the smaller place.

    trees: from the finest level of ranges to the coarsest, maxima by term and node; leaves: parts by term and place. opened gets the
    number of nodes that were opened at each level and last that of scored places."""
    w = weights[:, None]
    tops = (w * trees[-1]).sum(axis=0)
    heap = [(-int(b), len(trees) - 1, i) for i, b in enumerate(tops) if b]
    heapq.heapify(heap)
    best: list[tuple[int, int]] = []
    while heap:
        bound, level, node = heapq.heappop(heap)
        if -bound < floor or len(best) == k and -bound < best[0][0]:
            break
        below = (trees[level - 1] if level else leaves)[:, node * FAN : node * FAN + FAN]
        sums = (w * below).sum(axis=0).tolist()
        least = max(floor, best[0][0] if len(best) == k else 1, 1)
        if opened is not None:
            opened[level] += 1
        for i, s in enumerate(sums, node * FAN):
            if s < least:
                continue
            if level:
                heapq.heappush(heap, (-s, level - 1, i))
            elif len(best) < k:
                heapq.heappush(best, (s, -i))
            elif (s, -i) > best[0]:
                heapq.heapreplace(best, (s, -i))
    return [(s, -i) for s, i in sorted(best, reverse=True)]


def _open(index: Index, queries: DataFrame, terms: DataFrame, jobs: DataFrame, k: int) -> DataFrame:
    """query, position, score: the k best of each of jobs (query, segment, floor) in its segment."""
    block = F.pmod("query", F.lit(max(1, -(-queries.count() // BLOCK)))).cast("int")
    said = jobs.join(queries.select("query", "weighted"), "query").select("segment", block.alias("block"), "query", "floor", "weighted")
    needed = terms.select(block.alias("block"), "term").distinct().join(jobs.select("segment", block.alias("block")).distinct(), "block")
    held = index.trees.join(needed, ["segment", "term"])
    out = pa.schema([("query", pa.int64()), ("position", pa.int64()), ("score", pa.int64())])
    sizes = [FAN ** (LEVELS - 1 - i) for i in range(LEVELS - 1)]

    def run(asked: pa.Table, held: pa.Table) -> pa.Table:
        names = {t: i for i, t in enumerate(held.column("term").to_pylist())}
        cuts = np.cumsum([0, *sizes])
        flat = np.frombuffer(b"".join(held.column("tree").to_pylist()), "<u4").reshape(len(names), -1).astype(np.int64)
        trees = [flat[:, a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        places, parts = held.column("places"), held.column("parts")
        rows = []
        for segment, query, floor, weighted in zip(*(asked.column(c).to_pylist() for c in ("segment", "query", "floor", "weighted")), strict=True):
            own = [(names[x["term"]], x["w"]) for x in weighted if x["term"] in names]
            if not own:
                continue
            at = [i for i, _ in own]
            leaves = np.zeros((len(own), SEGMENT), np.int64)
            for row, i in enumerate(at):
                leaves[row, np.frombuffer(places[i].as_buffer(), "<u2")] = np.frombuffer(parts[i].as_buffer(), "<u4")
            found = best_first(np.array([w for _, w in own], np.int64), [t[at] for t in trees], leaves, k, floor)
            rows += [(query, segment * SEGMENT + i, s) for s, i in found]
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else ((), (), ()))], schema=out)

    both = said.groupBy("segment", "block").cogroup(held.select("segment", "block", "term", "tree", "places", "parts").groupBy("segment", "block"))
    return both.applyInArrow(run, "query long, position long, score long")


def search(index: Index, queries: DataFrame, item: str = "item_id", k: int = 50) -> DataFrame:
    """Each item's k best documents with a score above 0: item, rank from 1, doc_id, score; ties to the smaller doc_id, missing ids last."""
    weight = F.floor(1000 * F.log((2 * F.lit(index.documents) + 2).cast("double") / (2 * F.col("df") + 1).cast("double"))).cast("long")
    terms = queries.select("query", F.explode("terms").alias("term")).join(index.lexicon, "term").select("query", "term", weight.alias("w")).where("w > 0")
    terms = table(terms, "weights")
    asked = table(queries.join(terms.groupBy("query").agg(F.collect_list(F.struct("term", "w")).alias("weighted")), "query"), "asked")
    roots = table(terms.join(index.trees.select("segment", "term", "peak"), "term").groupBy("query", "segment").agg(F.sum(F.col("w") * F.col("peak")).alias("bound")).where("bound > 0"), "roots")
    first = per_group_cap(roots, "query", 1, F.desc("bound"), "segment")
    opened = table(_open(index, asked, terms, first.withColumn("floor", F.lit(0).cast("long")), k), "first")
    floors = opened.groupBy("query").agg(F.count("*").alias("n"), F.min("score").alias("floor")).where(F.col("n") >= k).select("query", "floor")
    rest = roots.join(first.select("query", "segment"), ["query", "segment"], "left_anti").join(floors, "query", "left").withColumn("floor", F.coalesce("floor", F.lit(0).cast("long"))).where("bound >= floor")
    more = table(_open(index, asked, terms, table(rest, "rest"), k), "more")
    best = per_group_cap(opened.unionByName(more), "query", k, F.desc("score"), "position")
    named = best.join(index.placed.select("position", "doc_id"), "position").join(asked.select("query", item), "query")
    numbered = named.withColumn("_b", F.struct((-F.col("score")).alias("a"), F.col("position").alias("b")))
    ranked = numbered.groupBy("query", item).agg(F.sort_array(F.collect_list(F.struct("_b", "doc_id", "score"))).alias("x")).select(item, F.posexplode("x").alias("i", "x"))
    return ranked.select(item, (F.col("i") + 1).alias("rank"), F.col("x.doc_id").alias("doc_id"), F.col("x.score").alias("score"))


def op12_lexical(spark, sf_dir: str) -> DataFrame:
    queries = queries_of(read(spark, sf_dir, "benchmark"))
    index = build(read(spark, sf_dir, "documents"), queries)
    return search(index, queries).withColumn("doc_id", F.col("doc_id").cast("long"))


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLE = f"""
WITH d AS (SELECT doc_id, {_TERMS} AS t FROM documents), s AS (SELECT doc_id, t, len(t) AS n FROM d WHERE len(t) > 0),
c AS (SELECT count(*) AS docs, sum(n)::BIGINT AS len FROM s),
i AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
p AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, n, unnest(t) AS term FROM s) WHERE term IN (SELECT term FROM i) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM p GROUP BY term), c),
r AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // len))))::BIGINT AS score FROM i JOIN w USING (term) JOIN p USING (term), c GROUP BY item_id, doc_id),
k AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM r WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM k WHERE rank <= 50"""
