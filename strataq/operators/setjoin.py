"""Pairs of sets with a Jaccard similarity of at least t, within buckets, by prefix and length filters.

All tokens stand in one order, rare ones first. A set of n shares at least ceil(t n) tokens with any partner, so the two
have a token in common among the first n - ceil(t n) + 1 of each: only these meet, so sets that share nothing but frequent
tokens never do. Sets whose sizes are too far apart are dropped by the join's condition, each pair is taken at its first
common token only, and the overlap is counted from the sorted arrays at once: no pair is shuffled. Equal sets of a bucket
are one class that meets others once; pairs of its members are made from the class afterwards. A token that many sets have
first is one key of a join of two shuffled sides, whose large partitions Spark splits.

A low similarity has prefixes that are nearly whole, so that filter would bring the same pairs together once for each
token they share. Then, and where all pairs count anyway (a mean), the sets of a bucket are dealt in blocks, every two of
which meet in a task. It counts what each two sets share without making a row for a pair: by a product of matrices for
tokens that many of them have, by adding ones for the others. What a task holds is bounded; the time is quadratic in the
sets of a bucket, and each set goes to as many tasks as its bucket has blocks.

Tokens are known by 64-bit hashes, and so are buckets where they meet in blocks. Empty sets are similar to nothing; a null
id takes no part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataq.session import checkpointed, forget, ship_package, small

#: Similarities below this are found in blocks.
LOW = 0.5
#: Tokens and sets of a block, pairs that are counted at once, ones that are added at once.
TOKENS, SETS, CELLS, ONES = 2_000_000, 8192, 1 << 20, 1 << 22
#: Tokens are counted by a product of matrices if more than this share of the pairs have them, up to so many of them.
DENSE, COLUMNS = 0.01, 1024


def ordered(sets: DataFrame) -> DataFrame:
    """(bucket, id, t): each set of (bucket, id, tokens) as hashes in the order of all tokens: by frequency, then by hash."""
    rows = sets.where("id IS NOT NULL").select("bucket", "id", F.explode(F.array_distinct("tokens")).alias("token")).where("token IS NOT NULL").select("bucket", "id", F.xxhash64("token").alias("h"))
    counts = rows.groupBy("h").agg(F.count("*").alias("df"))
    placed = rows.join(counts, "h").groupBy("bucket", "id").agg(F.array_sort(F.collect_list(F.struct("df", "h"))).alias("s"))
    return placed.select("bucket", "id", F.transform("s", lambda x: x["h"]).alias("t"))


def similar(sets: DataFrame, least: float) -> DataFrame:
    """(a, b, na, nb, shared) with a < b, for sets (bucket, id, tokens) and a similarity least > 0."""
    own = checkpointed(ordered(sets))
    classes = own.groupBy("bucket", "t").agg(F.min("id").alias("of"), F.count("*").alias("copies"))
    n = F.size("t")
    whole = classes.select("bucket", "of", "t", n.alias("n"), F.slice("t", F.lit(1), n - F.ceil(n * F.lit(least) - 1e-9).cast("int") + 1).alias("prefix"))
    if least < LOW:
        kept = checkpointed(_in_blocks(whole, least))
    else:
        kept = checkpointed(_by_prefix(whole, least))
    # Members of classes: those that are alone stand for themselves.
    many = classes.where("copies > 1").select("bucket", "t", "of")
    member = _members(own, many)
    end = lambda pairs, side: pairs.join(member.select(F.col("of").alias(side), F.col("id").alias(f"id_{side}")), side, "left").withColumn(f"id_{side}", F.coalesce(f"id_{side}", side))
    across = end(end(kept.select("x", "y", "nx", "ny", "shared"), "x"), "y")
    first = F.col("id_x") < F.col("id_y")
    pairs = across.select(
        F.least("id_x", "id_y").alias("a"), F.greatest("id_x", "id_y").alias("b"), F.when(first, F.col("nx")).otherwise(F.col("ny")).alias("na"), F.when(first, F.col("ny")).otherwise(F.col("nx")).alias("nb"), F.col("shared").cast("long").alias("shared"),
    )
    x, y = member.select("of", F.col("id").alias("a"), "n"), member.select("of", F.col("id").alias("b"))
    inside = x.join(y, "of").where("a < b").select("a", "b", F.col("n").alias("na"), F.col("n").alias("nb"), F.col("n").cast("long").alias("shared"))
    out = checkpointed(pairs.unionByName(inside))
    forget(own)
    forget(kept)
    return out


def _by_prefix(whole: DataFrame, least: float) -> DataFrame:
    """(x, y, nx, ny, shared) of similar classes (bucket, of, t, n, prefix), from those that share a token of their prefixes."""
    met = whole.select("*", F.explode("prefix").alias("token"))
    near = met.alias("x").join(met.alias("y").hint("merge"), F.expr(f"x.bucket <=> y.bucket AND x.token = y.token AND x.of < y.of AND x.n >= {least!r}D * y.n - 1e-9D AND y.n >= {least!r}D * x.n - 1e-9D"))
    once = near.where("array_intersect(x.prefix, y.prefix)[0] = x.token")
    counted = once.select(F.col("x.of").alias("x"), F.col("y.of").alias("y"), F.col("x.n").alias("nx"), F.col("y.n").alias("ny"), F.expr("size(array_intersect(x.t, y.t))").alias("shared"))
    return counted.where(F.col("shared") >= least * (F.col("nx") + F.col("ny") - F.col("shared")) - 1e-9)


def _in_blocks(whole: DataFrame, least: float) -> DataFrame:
    """The same from all pairs of a bucket, as they are counted in blocks."""

    def pairs(x: pa.Table, y: pa.Table, same: bool) -> Iterator[pa.RecordBatch]:
        nx, ny = x.column("n").to_numpy(), y.column("n").to_numpy()
        for begin, shared in _shared(x, y):
            end = begin + len(shared)
            keep = (shared > 0) & (shared >= least * (nx[begin:end, None] + ny - shared) - 1e-9)
            if same:
                keep &= np.arange(len(ny)) > np.arange(begin, end)[:, None]
            a, b = np.nonzero(keep)
            if len(a):
                at = pa.array(a + begin), pa.array(b)
                ids = [t.column("id").take(i).combine_chunks() for t, i in zip((x, y), at, strict=True)]
                yield from pa.table([*ids, pa.array(nx[a + begin]), pa.array(ny[b]), pa.array(shared[a, b].astype(np.int32))], ["x", "y", "nx", "ny", "shared"]).to_batches(max_chunksize=100_000)

    kind = whole.schema["of"].dataType.simpleString()
    rows = whole.select(F.xxhash64("bucket").alias("key"), F.col("of").alias("id"), "n", "t")
    return _dealt(rows).mapInArrow(_cells(pairs), f"x {kind}, y {kind}, nx int, ny int, shared int")


def mean_jaccard(rows: DataFrame) -> DataFrame:
    """(mean_jaccard): the mean similarity of all pairs of sets, from their (id, token), each once; null without a pair."""
    own = checkpointed(rows.where("id IS NOT NULL AND token IS NOT NULL").select("id", F.xxhash64("token").alias("h")))
    several = own.groupBy("h").count().where("count > 1").select("h", F.lit(1).alias("met"))  # what one set has adds to its size only
    sets = own.join(several, "h", "left").groupBy("id").agg(F.count("*").cast("int").alias("n"), F.collect_list(F.when(F.col("met") == 1, F.col("h"))).alias("t"))
    sets = checkpointed(sets)
    forget(own)
    count = sets.count()

    def sums(x: pa.Table, y: pa.Table, same: bool) -> Iterator[pa.RecordBatch]:
        nx, ny = x.column("n").to_numpy(), y.column("n").to_numpy()
        total = 0.0
        for begin, shared in _shared(x, y):
            end = begin + len(shared)
            shared = shared.astype(float)
            part = shared / (nx[begin:end, None] + ny - shared)
            total += float(part[np.arange(len(ny)) > np.arange(begin, end)[:, None]].sum() if same else part.sum())
        yield pa.RecordBatch.from_arrays([pa.array([total])], ["total"])

    totals = _dealt(sets.select(F.lit(0).cast("long").alias("key"), "id", "n", "t")).mapInArrow(_cells(sums), "total double")
    pairs = count * (count - 1) // 2
    found = checkpointed(totals.agg(F.round(F.coalesce(F.sum("total"), F.lit(0.0)) / F.lit(float(pairs) or None).cast("double"), 4).alias("mean_jaccard")))
    forget(sets)
    return found


def _dealt(rows: DataFrame) -> DataFrame:
    """Rows (key, i, j, side, id, n, t) of (key, id, n, t): the sets of blocks i (side 0) and j (side 1) of a key come together."""
    ship_package(rows.sparkSession)
    sizes = rows.groupBy("key").agg(F.count("*").alias("sets"), F.sum(F.size("t")).alias("tokens"))
    # At least three blocks of what is worth more than a task.
    blocks = F.greatest(F.ceil(F.col("tokens") / TOKENS), F.ceil(F.col("sets") / SETS), F.when(F.col("sets") > SETS // 8, 3).otherwise(1)).cast("int")
    sizes = checkpointed(sizes.select("key", blocks.alias("blocks")))
    cells = sizes.agg(F.coalesce(F.sum(F.expr("blocks * (blocks + 1) div 2")), F.lit(0)).alias("cells")).first()["cells"]
    own = rows.join(small(sizes), "key").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    sent = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = sent.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), (F.col("block") > F.col("other")).cast("int").alias("side"), "id", "n", "t")
    many = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return placed.repartition(max(1, min(cells, max(many, 4096))), "key", "i", "j").sortWithinPartitions("key", "i", "j", "side")


def _cells(of: Callable[[pa.Table, pa.Table, bool], Iterator[pa.RecordBatch]]):
    """Gives of() the sets of the two blocks of each cell, in turn, and whether they are one."""

    def flush(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(held).combine_chunks()
        split = int(np.searchsorted(rows.column("side").to_numpy(), 1))
        if rows.column("i")[0] == rows.column("j")[0]:
            yield from of(rows, rows, True)
        elif 0 < split < rows.num_rows:
            yield from of(rows.slice(0, split), rows.slice(split), False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = [], None
        for batch in batches:
            key = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in (0, 1, 2)], axis=1)
            cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist(), batch.num_rows]
            for begin, end in zip(cuts, cuts[1:], strict=False):
                if begin < end:
                    if held and tuple(key[begin]) != last:
                        yield from flush(held)
                        held = []
                    held.append(batch.slice(begin, end - begin))
                    last = tuple(key[begin])
        if held:
            yield from flush(held)

    return run


def _flat(sets: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(set, token) of each token of sets, in their order."""
    column = sets.column("t").combine_chunks()
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(column.offsets.to_numpy())
    return np.repeat(np.arange(len(sizes)), sizes), column.flatten().to_numpy(zero_copy_only=False)


def _shared(x: pa.Table, y: pa.Table) -> Iterator[tuple[int, np.ndarray]]:
    """(first, counts): what each set of x, some of them at a time, shares with each of y."""
    n, m = x.num_rows, y.num_rows
    own, token = _flat(x)
    other, names = _flat(y)
    order = np.argsort(names, kind="stable")
    other, names = other[order], names[order]
    first = np.flatnonzero(np.append(True, names[1:] != names[:-1])) if len(names) else np.zeros(0, int)
    many, names = np.diff(np.append(first, len(names))), names[first]
    at = np.minimum(np.searchsorted(names, token), max(0, len(names) - 1))
    hit = names[at] == token if len(names) else np.zeros(len(token), bool)
    own, at = own[hit], at[hit]
    worth = np.bincount(at, minlength=len(names)).astype(float) * many
    thick = np.argsort(-worth, kind="stable")[:COLUMNS]
    thick = thick[worth[thick] > DENSE * n * m]
    column = np.full(len(names), -1)
    column[thick] = np.arange(len(thick))
    right = np.zeros((len(thick), m), np.float32)
    for c, t in enumerate(thick):
        right[c, other[first[t] : first[t] + many[t]]] = 1
    step = max(1, CELLS // max(1, m))
    for begin in range(0, n, step):
        end = min(n, begin + step)
        low, high = np.searchsorted(own, [begin, end])
        row, place = own[low:high] - begin, at[low:high]
        in_product = column[place] >= 0
        left = np.zeros((end - begin, len(thick)), np.float32)
        left[row[in_product], column[place[in_product]]] = 1
        counts = left @ right
        row, place = row[~in_product], place[~in_product]
        total = np.cumsum(many[place])
        cuts = [0, *np.unique(np.searchsorted(total, np.arange(ONES, total[-1], ONES), side="right")).tolist(), len(row)] if len(row) else []
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a < b:
                size = many[place[a:b]]
                start = np.cumsum(size) - size
                mate = other[np.repeat(first[place[a:b]] - start, size) + np.arange(size.sum())]
                counts += np.bincount(np.repeat(row[a:b] * m, size) + mate, minlength=counts.size).reshape(counts.shape)
        yield begin, counts


def _members(own: DataFrame, many: DataFrame) -> DataFrame:
    """(of, id, n) of all sets that have equals in their bucket."""
    print_ = F.xxhash64("bucket", "t")
    right = many.select(print_.alias("p"), F.col("t").alias("u"), F.col("bucket").alias("in"), "of")
    return own.withColumn("p", print_).join(right, "p").where(F.col("t") == F.col("u")).where(F.col("bucket").eqNullSafe(F.col("in"))).select("of", "id", F.size("t").alias("n"))
