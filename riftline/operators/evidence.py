"""Evidence reads: filters, canonical sides, dedup, densities, the multi-scale cascade and clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import orientation
from ..settings import DEFAULTS
from ..storage import stored

#: Positions to a part of a contig, whose rows are ordered together; parts are then put together by a row each.
PART = 1_000_000
#: Rows to a task that orders them by keys.
ROWS = 500_000
#: Tasks to which Spark deals rows without sorting them first in memory (spark.shuffle.sort.bypassMergeThreshold).
UNSORTED = 200
#: Reads from which on a cell is found by counting and isn't ordered.
CROWD = ROWS // 10


def parts(rows: DataFrame, each: int = ROWS) -> int:
    """Tasks that hold ``each`` rows or so. ``rows`` are counted: pass a table whose files tell how many it has."""
    return rows.count() // each + 1


def _exceeds(rows: DataFrame, parts: int | None) -> bool:
    """Whether ``parts`` are more than the tasks that the session's shuffles have."""
    return bool(parts) and parts > int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def dealt(rows: DataFrame, keys: list[str], parts: int | None) -> DataFrame:
    """Rows dealt by ``keys`` to ``parts`` tasks, if that is more than the session's shuffles have: what a task holds doesn't grow with the input."""
    return rows.repartition(parts, *keys) if _exceeds(rows, parts) else rows


def fewer(parts: int | None, rows: DataFrame, less: int = 0) -> int | None:
    """``parts``, or as many as ``rows`` without ``less`` of them need, which are counted where Spark would sort them for so many tasks."""
    return min(parts, max(rows.count() - less, 0) // ROWS + 1) if parts and parts > UNSORTED else parts


def matched(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join on equal ``keys``, where nulls are equal as they are in groups; the right side's keys go."""
    other = right.withColumnsRenamed({k: f"other_{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"other_{k}")) for k in keys]
    return left.join(other, on, how).drop(*(f"other_{k}" for k in keys))


def discordant(reads: DataFrame, min_mapq: int = DEFAULTS.min_mapq) -> DataFrame:
    """Reads whose mate is on another contig, with enough mapping quality."""
    return reads.where((F.col("mapq") >= min_mapq) & (F.col("chrom") != F.col("mate_chrom")))


def deduped(reads: DataFrame) -> DataFrame:
    """One read per (name, contig, mate contig): the first by position."""
    w = Window.partitionBy("read_name_hash", "chrom", "mate_chrom").orderBy("pos", "mate_pos", "mapq")
    return reads.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def canonical(reads: DataFrame) -> DataFrame:
    """Sides ordered by contig name; strands follow their side."""
    first = F.col("chrom") <= F.col("mate_chrom")
    orient = orientation(F.col("is_reverse"), F.col("mate_is_reverse"))
    return reads.select(
        "read_name_hash", "mapq", "evidence_type", "flag",
        F.least("chrom", "mate_chrom").alias("ca"), F.greatest("chrom", "mate_chrom").alias("cb"),
        F.when(first, F.col("pos")).otherwise(F.col("mate_pos")).alias("pos_a"), F.when(first, F.col("mate_pos")).otherwise(F.col("pos")).alias("pos_b"),
        F.when(first, orient).otherwise(F.reverse(orient)).alias("orient"),
    )


def pair_density(reads: DataFrame) -> DataFrame:
    return reads.groupBy(F.least("chrom", "mate_chrom").alias("ca"), F.greatest("chrom", "mate_chrom").alias("cb")).agg(F.count("*").alias("n"))


def _bin(pos: str, size: int):
    return F.floor(F.col(pos) / size).cast("long")


CELL = ["ca", "cb", "bin_a", "bin_b"]


def _placed(canon: DataFrame, scale: int) -> DataFrame:
    return canon.withColumns({f"bin_{s}": _bin(f"pos_{s}", scale) for s in "ab"})


def crowded(canon: DataFrame, parts: int, scale: int = DEFAULTS.scales[-1], each: int = CROWD) -> DataFrame:
    """The cells (columns CELL) of at least ``each`` reads, with how many (``n``).

    Reads are counted by hashes of their cells, 256 for each of ``parts``, then one by one the cells of those hashes that
    have ``each`` reads: at most a few in a hundred. ``canon`` is read twice.
    """
    placed = _placed(canon, scale).select(*CELL, F.pmod(F.xxhash64(*CELL), F.lit(256 * parts)).alias("hash"))
    full = placed.groupBy("hash").agg(F.count("*").alias("n")).where(F.col("n") >= each)
    some = placed.join(F.broadcast(full.select("hash")), "hash", "left_semi")
    return stored(some.groupBy(*CELL).agg(F.count("*").alias("n")).where(F.col("n") >= each))


def dense_at(canon: DataFrame, scale: int, least: int = 2, parts: int | None = None, crowd: DataFrame | None = None) -> DataFrame:
    """Reads whose cell (contig pair, both bins) holds at least ``least``. ``parts``: see ``dealt``.

    Reads of a cell are ordered in one task, but for those of ``crowd``, cells that are known to be dense (see ``crowded``).
    """
    rest = placed = _placed(canon, scale)
    if crowd is not None:
        rest = matched(placed, F.broadcast(crowd), CELL, "left_anti")
    out = dealt(rest, CELL, parts).withColumn("n", F.count("*").over(Window.partitionBy(*CELL))).where(F.col("n") >= least).drop("n")
    if crowd is not None:
        out = out.unionByName(matched(placed, F.broadcast(crowd), CELL, "left_semi"))
    return out.drop("bin_a", "bin_b")


def cascade(canon: DataFrame, scales=DEFAULTS.scales, parts: int | None = None, crowd: DataFrame | None = None) -> DataFrame:
    """Dense cells at each scale in turn, on the survivors of the one before.

    Where bins nest, a cell that holds two reads puts them into one cell of every coarser scale, so that the finest
    scale decides: one shuffle and one sort, by its cells. ``parts``: see ``dealt``; ``crowd``: see ``dense_at``, cells of the finest scale.
    """
    nested = all(wide % fine == 0 for wide, fine in zip(scales, scales[1:]))
    out = canon
    for scale in scales[-1:] if nested else scales:
        out = dense_at(out, scale, parts=parts, crowd=crowd if scale == scales[-1] else None)
    return out


def survivors(canon: DataFrame, parts: int | None = None) -> DataFrame:
    """The cascade of all scales; where ``parts`` (see ``dealt``) count, reads are written first, and those of crowded cells aren't ordered."""
    if not _exceeds(canon, parts):
        return cascade(canon, parts=parts)
    canon = stored(canon)  # it is read four times
    crowd = crowded(canon, parts)
    return cascade(canon, parts=fewer(parts, canon, crowd.agg(F.sum("n")).first()[0] or 0), crowd=crowd)


def islands(rows: DataFrame, keys: list[str], pos: str, distance: int, out: str, parts: int | None = None) -> DataFrame:
    """Gaps and islands: a new island where ``pos`` is more than ``distance`` after all before it.

    Positions are dealt to parts, each ordered on its own; an island that a part begins with may go on from the part
    before, which a row a part tells. ``parts``: see ``dealt``.
    """
    part, first, last, begun = (f"{out}_{x}" for x in ("part", "first", "last", "begun"))
    own = Window.partitionBy(*keys, part).orderBy(pos)
    before = F.lag(pos).over(own)
    opens = F.when(before.isNull() | (F.col(pos) - before > distance), F.col(pos))
    placed = dealt(rows.withColumn(part, F.floor(F.col(pos) / PART).cast("long")), [*keys, part], parts)
    placed = stored(placed.withColumn(out, F.max(opens).over(own.rowsBetween(Window.unboundedPreceding, 0))))
    up = Window.partitionBy(*keys).orderBy(part)
    ends = placed.groupBy(*keys, part).agg(F.min(pos).alias(first), F.max(pos).alias(last), F.max(out).alias(begun))
    ends = ends.withColumn("joined", F.coalesce(F.col(first) - F.lag(last).over(up) <= distance, F.lit(False)))
    # where the island that a part ends with begins, null where it goes back beyond the part
    ends = ends.withColumn(begun, F.when(F.col(begun) != F.col(first), F.col(begun)).when(~F.col("joined"), F.col(first)))
    moved = ends.withColumn(last, F.max(begun).over(up.rowsBetween(Window.unboundedPreceding, -1))).where("joined")
    moved = stored(moved.select(*keys, F.col(first).alias(out), F.col(last).alias(begun)))
    return matched(placed.drop(part), moved, [*keys, out], "left").withColumn(out, F.coalesce(begun, out)).drop(begun)


def clustered(canon: DataFrame, distance: int = DEFAULTS.merge_distance, parts: int | None = None) -> DataFrame:
    """Reads with the first position of their island on each side, which identify the cluster. ``parts``: see ``dealt``."""
    key = ["ca", "cb", "orient"]
    first = islands(canon, key, "pos_a", distance, "isl_a", parts)
    return islands(first, [*key, "isl_a"], "pos_b", distance, "isl_b", fewer(parts, first))


def coherent(canon: DataFrame, clusters: DataFrame, distance: int = DEFAULTS.merge_distance, most: int = 2, parts: int | None = None) -> DataFrame:
    """Clusters with ``orientations``, how many the reads around them have, and ``coherent``: ``most`` at most.

    Around a cluster are the reads of its contig pair that islands join on both sides whatever their orientation; each cluster
    lies in one such place, as islands of one orientation lie in those of all. ``parts``: see ``dealt``.
    """
    key = ["ca", "cb"]
    placed = islands(islands(canon, key, "pos_a", distance, "any_a", parts), [*key, "any_a"], "pos_b", distance, "any_b", parts)
    places = placed.groupBy(*key, "any_a", "any_b").agg(F.countDistinct("orient").alias("orientations"))
    # the place of a cluster is that of its first read by both sides
    first = clustered(placed, distance, parts).groupBy(*CLUSTER).agg(F.min(F.struct("any_a", "any_b")).alias("at"))
    own = first.select(*CLUSTER, "at.any_a", "at.any_b").join(places, [*key, "any_a", "any_b"]).select(*CLUSTER, "orientations")
    return clusters.join(own, CLUSTER).withColumn("coherent", F.col("orientations") <= most)


CLUSTER = ["ca", "cb", "orient", "isl_a", "isl_b"]


def clusters(rows: DataFrame, least: int = DEFAULTS.min_cluster_support, parts: int | None = None) -> DataFrame:
    """One row per cluster of at least ``least`` reads: support by type, medians, bounds, starts, qualities.

    Reads are first counted by quality and by position, so that no task holds a cluster's reads. ``parts``: see ``dealt``.
    """
    is_split = F.col("evidence_type") == "split"
    per = rows.groupBy(*CLUSTER, "mapq").agg(
        F.count("*").alias("support"), F.count_if(is_split).alias("sr"), F.count_if(~is_split).alias("pr"),
        *(f(f"pos_{s}").alias(f"{name}_{s}") for s in "ab" for name, f in (("lo", F.min), ("hi", F.max))),
        F.count_if(F.col("flag").bitwiseAND(1024) != 0).alias("dup"), F.count("flag").alias("flags"),
    )
    out = per.groupBy(*CLUSTER).agg(
        *(F.sum(c).alias(c) for c in ("support", "sr", "pr")),
        *(f(f"{name}_{s}").alias(f"{name}_{s}") for s in "ab" for name, f in (("lo", F.min), ("hi", F.max))),
        F.percentile(F.when(F.col("mapq") > 0, F.col("mapq")), F.lit(0.5), F.col("support")).alias("median_mapq"),
        F.try_divide(F.sum("dup").cast("double"), F.sum("flags")).alias("dup_fraction"),
    )
    out = matched(out.where(F.col("support") >= least), _positions(rows, parts), CLUSTER, "left").fillna({"starts_a": 0, "starts_b": 0})
    columns = [*CLUSTER, "support", "sr", "pr", "median_a", "median_b", "lo_a", "hi_a", "lo_b", "hi_b", "starts_a", "starts_b", "median_mapq", "dup_fraction"]
    return out.select(*columns, F.concat_ws("_", *CLUSTER).alias("event_id"))


def _positions(rows: DataFrame, parts: int | None) -> DataFrame:
    """Of each cluster (its columns are CLUSTER) and side the median position, rounded towards 0, and how many positions there are.

    Counted positions are added up in parts, and the parts by a row each.
    """
    side = F.array(*(F.struct(F.lit(s).alias("side"), F.col(f"pos_{s}").alias("pos")) for s in "ab"))
    counted = rows.select(*CLUSTER, F.explode(side).alias("e")).select(*CLUSTER, "e.*").where("pos is not null")
    counted = counted.groupBy(*CLUSTER, "side", "pos").agg(F.count("*").alias("n")).withColumn("part", F.floor(F.col("pos") / PART).cast("long"))
    key = [*CLUSTER, "side"]
    whole = Window.partitionBy(*key)
    sums = counted.groupBy(*key, "part").agg(F.sum("n").alias("held"))
    before = F.sum("held").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select(*key, "part", F.coalesce(before, F.lit(0)).alias("before"), F.sum("held").over(whole).alias("total"))
    upto = F.sum("n").over(Window.partitionBy(*key, "part").orderBy("pos"))
    placed = matched(dealt(counted, [*key, "part"], parts).withColumn("upto", upto), sums, [*key, "part"]).withColumn("upto", F.col("before") + F.col("upto"))
    low, high = (F.floor((F.col("total") - x) / 2) for x in (1, 0))

    def at(s: str, rank: Column) -> Column:
        return F.min(F.when((F.col("side") == s) & (F.col("upto") > rank), F.col("pos")))

    medians = (((at(s, low) + at(s, high)) / 2).cast("long").alias(f"median_{s}") for s in "ab")
    return placed.groupBy(*CLUSTER).agg(*medians, *(F.count_if(F.col("side") == s).alias(f"starts_{s}") for s in "ab"))


def intervals(c: DataFrame) -> DataFrame:
    """Confidence intervals: the bounds, or 500 (2 without discordant reads) around the median where they coincide."""
    pad = F.when(F.col("pr") > 0, 500).otherwise(2)
    side = lambda s: [F.when(F.col(f"lo_{s}") < F.col(f"hi_{s}"), F.col(f"lo_{s}")).otherwise(F.col(f"median_{s}") - pad).alias(f"ci_lo_{s}"), F.when(F.col(f"lo_{s}") < F.col(f"hi_{s}"), F.col(f"hi_{s}")).otherwise(F.col(f"median_{s}") + pad).alias(f"ci_hi_{s}")]
    return c.select("event_id", *side("a"), *side("b"))
