"""Greedy one-to-one decisions: reciprocal absorption, and matching of calls with a truth set.

Both are sequential by definition. Rows are first dealt by gaps on the first side that no
pair can cross, so that a group is a neighbourhood and not a whole contig pair.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..settings import DEFAULTS
from .evidence import islands

OPPOSITE = {"++": "--", "--": "++", "+-": "-+", "-+": "+-"}


def absorbed(calls: DataFrame, band: int = DEFAULTS.band) -> DataFrame:
    """Calls (event_id, ca, cb, orient, median_a, median_b, support, score) that keep, with what they absorb.

    By falling support (then id; scores come later), a call takes the best remaining one of opposite orientation
    within ``band`` on both sides; that one goes. Returns event_id, score, donor (null
    without one) and support with the donor's.
    """
    fields = ["event_id", "ca", "cb", "orient", "median_a", "median_b", "support", "score"]

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        ranked = pdf.sort_values(["support", "event_id"], ascending=[False, True]).reset_index(drop=True)
        gone, out = set(), []
        for i, own in enumerate(ranked.itertuples()):
            if i in gone:
                continue
            close = ((ranked.median_a - own.median_a).abs() <= band) & ((ranked.median_b - own.median_b).abs() <= band) & (ranked.orient == OPPOSITE.get(own.orient, ""))
            free = [j for j in ranked.index[close] if j > i and j not in gone][:1]
            gone.update(free)
            donor = ranked.loc[free[0]] if free else None
            out.append((own.event_id, own.score, donor.event_id if free else None, own.support + (donor.support if free else 0)))
        return pd.DataFrame(out, columns=["event_id", "score", "donor", "support"])

    dealt = islands(calls.select(*fields), ["ca", "cb"], "median_a", band, "near")
    return dealt.groupBy("ca", "cb", "near").applyInPandas(run, "event_id string, score double, donor string, support long")


def matched(truth: DataFrame, calls: DataFrame, window: int = 1_000_000) -> DataFrame:
    """One row per truth event (truth_id, chrom_a, pos_a, chrom_b, pos_b): the nearest call that no earlier event took.

    Both sides must lie within the event's own match_window, or ``window`` where that is null, 0 or
    missing. Nearness is the sum of both distances, ties to the smaller event_id; sides match in either
    order and contig names with or without ``chr``. Truth goes by its id. Returns truth_id, event_id and
    distance, both null without a match.
    """
    bare = lambda c: F.regexp_replace(c, "^chr", "")
    swapped = bare("chrom_a") > bare("chrom_b")
    pick = lambda x, y: F.when(swapped, F.col(y)).otherwise(F.col(x)).cast("long")
    wide = F.coalesce(F.nullif(F.col("match_window").cast("long"), F.lit(0).cast("long")), F.lit(window)) if "match_window" in truth.columns else F.lit(window)
    events = truth.select(F.col("truth_id").cast("long").alias("truth_id"), F.least(bare("chrom_a"), bare("chrom_b")).alias("ca"), F.greatest(bare("chrom_a"), bare("chrom_b")).alias("cb"), pick("pos_a", "pos_b").alias("a"), pick("pos_b", "pos_a").alias("b"), wide.cast("long").alias("wide"))
    most = events.agg(F.max("wide")).first()[0] or window
    # events further apart than both windows can't want the same call
    dealt = islands(events, ["ca", "cb"], "a", 2 * most, "near")
    cell = lambda x: F.floor(x / window).cast("long")
    at = dealt.withColumn("cell", F.explode(F.sequence(cell(F.col("a") - F.col("wide")), cell(F.col("a") + F.col("wide")))))
    own = calls.select("event_id", bare("ca").alias("ca"), bare("cb").alias("cb"), F.col("median_a").cast("long").alias("x"), F.col("median_b").cast("long").alias("y")).withColumn("cell", cell(F.col("x")))
    da, db = F.abs(F.col("x") - F.col("a")), F.abs(F.col("y") - F.col("b"))
    pairs = at.join(own, ["ca", "cb", "cell"]).where((da <= F.col("wide")) & (db <= F.col("wide"))).select("ca", "cb", "near", "truth_id", "event_id", (da + db).alias("distance"))

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        taken, out = set(), {}
        for t in pdf.sort_values(["truth_id", "distance", "event_id"]).itertuples():
            if t.truth_id not in out and t.event_id not in taken:
                taken.add(t.event_id)
                out[t.truth_id] = (t.truth_id, t.event_id, t.distance)
        return pd.DataFrame(list(out.values()), columns=["truth_id", "event_id", "distance"])

    took = pairs.groupBy("ca", "cb", "near").applyInPandas(run, "truth_id long, event_id string, distance long")
    return events.select("truth_id").join(took, "truth_id", "left")


def metrics(matches: DataFrame, calls: DataFrame) -> DataFrame:
    """One row: true and false positives, misses, sensitivity and precision."""
    found = matches.agg(F.count("event_id").alias("tp"), F.count_if(F.col("event_id").isNull()).alias("fn"))
    wrong = calls.join(matches.where("event_id is not null"), "event_id", "left_anti").agg(F.count("*").alias("fp"))
    share = lambda other: F.round(F.col("tp") / F.greatest(F.col("tp") + F.col(other), F.lit(1)), 6)
    return found.join(wrong).select("tp", "fp", "fn", share("fn").alias("sensitivity"), share("fp").alias("precision"))
