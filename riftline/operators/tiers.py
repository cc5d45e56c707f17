"""Gates, tiers, scores, merging and selection of clusters."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar
from ..settings import DEFAULTS
from ..storage import stored
from .reads import PRIMARY

TIERS = ("confirmed", "validated", "likely", "strong_candidate", "candidate", "filtered")


def hard_exclude(coherent: Column | None = None) -> Column:
    """The first reason that excludes a cluster, of columns ca, cb, and tracks_a, tracks_b; ``coherent``: see ``tier``."""
    # fixed values: the reasons' names
    cores = {"encode_blacklist": "blacklist", "centromere": "centromere_core", "telomere": "telomere_core"}
    reasons = [F.when(scalar.normalized_chrom(F.col("ca")).eqNullSafe("chrM") | scalar.normalized_chrom(F.col("cb")).eqNullSafe("chrM"), "mt_involvement")]
    reasons += [F.when(~scalar.normalized_chrom(F.col(f"c{s}")).isin(*PRIMARY), F.concat(F.lit("non_primary_chrom:"), f"c{s}")) for s in "ab"]
    reasons += [F.when(F.array_contains(f"tracks_{s}", track), f"{name}_{s}") for track, name in cores.items() for s in "ab"]
    if coherent is not None:
        reasons.append(F.when(~coherent, "orientation_incoherent"))
    return F.coalesce(*reasons)


def reject_reason(promiscuous: int = DEFAULTS.promiscuous_threshold) -> Column:
    """The first reason that rejects a cluster."""
    c = F.col
    return F.coalesce(
        F.when((c("sr") == 0) & (c("pr") < 10), "sr0_pr_lt10"),
        F.when(c("dup_fraction") > 0.7, "duplicate_fraction"),
        F.when(c("starts_a") + c("starts_b") < 5, "low_unique_starts"),
        F.when((c("sr") == 0) & ((c("lcr_a") > 3) | (c("lcr_b") > 3)), "local_coverage"),
        F.when((c("sr") == 0) & (F.greatest("partners_a", "partners_b") >= promiscuous) & (c("n_ext") == 0), "promiscuous"),
    )


def _gates(unique: Column, coherent: Column) -> dict[str, Column]:
    """Which gates a cluster passes, each by its own rule, from the lowest up."""
    c = F.col
    few = (c("segdup_pct_a") < 95) & (c("segdup_pct_b") < 95)
    unmasked = ~F.exists(F.concat("tracks_a", "tracks_b"), lambda t: t.contains("blacklist")) & few
    clean = unmasked & (F.greatest("partners_a", "partners_b") < DEFAULTS.promiscuous_threshold)
    low = F.greatest("lcr_a", "lcr_b") <= 1.5
    starts = F.least("starts_a", "starts_b") >= 10
    wide = (c("pr") >= 15) & (c("sr") == 0) & unique & low & starts & unmasked & coherent
    strong = wide | ((c("pr") >= 5) & (c("sr") >= 1) & clean)
    likely = strong & ((c("sr") >= 2) | (c("n_ext") >= 1))
    own = (c("pr") >= 6) & (c("sr") >= 3) & (c("p_a") < 1e-6) & (c("p_b") < 1e-6) & clean & coherent
    return {"few": few, "low": low, "starts": starts, "strong": strong, "likely": likely, "own": own, "validated": own | (likely & (c("n_ext") >= 2))}


def tier(reviewed: Column | None = None, unique: Column | None = None, coherent: Column | None = None) -> Column:
    """Tier of a cluster that isn't excluded or rejected (column ``gone``).

    ``reviewed``: an assembly or a person has confirmed it (default no); ``unique``: both
    flanks map to one place only; ``coherent``: its reads have two orientations at most
    (both default yes, clusters being made by orientation).
    """
    c, yes = F.col, F.lit(True)
    g = _gates(yes if unique is None else unique, yes if coherent is None else coherent)
    confirmed = g["validated"] & ((c("n_ext") >= 3) | (F.lit(False) if reviewed is None else reviewed))
    return (
        F.when(c("gone"), "filtered").when(confirmed, "confirmed").when(g["validated"], "validated").when(g["likely"], "likely")
        .when(g["strong"], "strong_candidate").when((c("pr") >= 3) | (c("sr") >= 1), "candidate").otherwise("filtered")
    )


def reject_reasons() -> Column:
    """Every gate above its tier that a cluster (columns as for ``tier``, with ``tier``) has not passed; of one that is gone, why."""
    c, yes = F.col, F.lit(True)
    g = _gates(yes, yes)
    below = ~g["own"]
    sr0 = below & ~g["strong"] & (c("pr") >= 15) & (c("sr") == 0)
    why = [
        F.when(sr0 & ~g["low"], F.format_string("lcr_high:%.1f", F.greatest("lcr_a", "lcr_b"))), F.when(sr0 & ~g["starts"], "low_unique_starts_for_sr0"), F.when(sr0 & ~g["few"], "segdup_high_identity"),
        F.when(below & ~g["strong"] & (c("pr") < 5), F.format_string("pr_lt5:%d", "pr")), F.when(below & g["strong"] & ~g["likely"], "no_split_or_external"),
        F.when(~g["validated"] & (c("pr") < 6), F.format_string("pr_lt6:%d", "pr")), F.when(~g["validated"] & (c("sr") < 3), F.format_string("sr_lt3:%d", "sr")),
        *(F.when(~g["validated"] & (c(f"p_{s}") >= 1e-6), F.format_string(f"pval_{s}_high:%.2e", f"p_{s}")) for s in "ab"),
        F.when(~g["validated"], "not_validated"), F.when(g["validated"] & (c("tier") != "confirmed"), "no_confirmation_evidence"),
        F.when((c("pr") < 3) & (c("sr") < 1), "below_minimum_support"),
    ]
    return F.when(c("gone"), F.array(F.coalesce("excluded", "rejected"))).otherwise(F.array_compact(F.array(*why)))


def label(reviewed: Column | None = None) -> Column:
    """How far a cluster has come, whatever its tier: six names, each of which asks for the one before."""
    c = F.col
    enriched = (c("pr") >= 3) | (c("sr") >= 1)
    strong = enriched & (c("p_a") < 0.01) & (c("p_b") < 0.01) & (c("dup_fraction") <= 0.7)
    quiet = F.greatest("partners_a", "partners_b") < DEFAULTS.promiscuous_threshold
    junction = strong & (F.least("starts_a", "starts_b") >= 5) & (c("dup_fraction") <= 0.5) & quiet & (F.coalesce("median_mapq", F.lit(0)) >= 20)
    likely = junction & ((c("sr") >= 2) | (c("n_ext") >= 1))
    sure = likely & ((c("n_ext") >= 3) | ((c("sr") >= 3) & (c("pr") >= 6)) | (F.lit(False) if reviewed is None else reviewed))
    return (
        F.when(sure, "confirmed").when(likely, "likely_translocation").when(junction, "candidate_junction").when(strong, "strong_cluster")
        .when(enriched, "enriched_cluster").otherwise("raw_cluster")
    )


def evidence_kind(clip: Column | None = None) -> Column:
    """The first-generation name of a cluster's kinds of evidence; without a clip count there are no clips."""
    split, disc, clips = F.col("sr") >= 1, F.col("pr") >= 1, F.lit(False) if clip is None else clip >= 1
    return (
        F.when(split & disc, "multi-evidence").when(split & clips, "split+clip").when(disc & clips, "discordant+clip").when(split, "split-supported")
        .when(disc, "discordant-supported").when(clips, "softclip-supported").otherwise("unknown")
    )


def components(clip: Column | None = None) -> dict[str, Column]:
    """The parts of the score, each rounded to one decimal."""
    c = F.col
    decades = lambda p: F.least(-F.log10(F.greatest(c(p), F.lit(1e-300))), F.lit(20.0))
    tight = ((c("hi_a") - c("lo_a")) < 1000) & ((c("hi_b") - c("lo_b")) < 1000) & (c("support") >= 3)
    parts = {
        "support_pr": 5 * F.log2(c("pr") + 1), "support_sr": 10 * F.log2(c("sr") + 1), "support_clip": F.lit(0.0) if clip is None else 2 * F.log2(clip + 1),
        "pvalue_a": decades("p_a"), "pvalue_b": decades("p_b"), "unique_starts": 0.5 * F.least("starts_a", "starts_b"), "tightness_bonus": F.when(tight, 5.0).otherwise(0.0),
        "enrichment_over_bg": F.least(0.5 * c("enrichment"), F.lit(10.0)), "reciprocal": F.when(c("partner").isNotNull(), 10.0).otherwise(0.0), "external": 15.0 * c("n_ext"),
        "mapq": 0.2 * F.coalesce("median_mapq", F.lit(0.0)), "dup_penalty": F.when(c("dup_fraction") > 0.5, -5.0).otherwise(0.0),
        "promiscuous_penalty": F.when(F.greatest("partners_a", "partners_b") >= DEFAULTS.promiscuous_threshold, -10.0).otherwise(0.0),
    }
    return {k: F.round(v, 1) for k, v in parts.items()}


def score(clip: Column | None = None) -> Column:
    """The sum of the parts; filtered clusters have 0."""
    return F.when(F.col("tier") == "filtered", 0.0).otherwise(F.round(sum(components(clip).values(), F.lit(0.0)), 1))


def v1_score() -> Column:
    """The linear score of support, starts and mapping quality."""
    c = F.col
    starts = F.least(2 * F.greatest(c("starts_a") - 1, F.lit(0)) + 2 * F.greatest(c("starts_b") - 1, F.lit(0)), F.lit(20))
    return 5.0 * c("sr") + 3.0 * c("pr") + starts + 10 * (F.least(F.greatest(c("median_mapq"), F.lit(20)), F.lit(60)) - 20) / 40


def anchored(rows: DataFrame, window: int = DEFAULTS.breakpoint_merge_window) -> DataFrame:
    """Merges clusters of a pair and orientation that lie within ``window`` of a fixed anchor on both sides.

    A merged cluster is its anchor with the sums of support, sr and pr, how many are ``merged``, and of what else there is the
    greatest median_mapq, the least background_p, and all callers. Filtered clusters (column ``tier``, where there is one) come through as they are.
    Clusters are first dealt by gaps on the first side wider than the window, which no merge
    can cross, so that a group is a neighbourhood and not a whole contig pair.
    """
    from .evidence import islands

    more = {"median_mapq": "double", "background_p": "double", "callers": "array<string>"}
    more = {c: t for c, t in more.items() if c in rows.columns}
    fields = ["ca", "cb", "orient", "median_a", "median_b", "support", "sr", "pr", "event_id", *more]

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        anchor, out = None, []
        for row in pdf.sort_values(["median_a", "median_b", "event_id"]).to_dict("records"):
            if anchor and abs(row["median_a"] - anchor["median_a"]) <= window and abs(row["median_b"] - anchor["median_b"]) <= window:
                for f in ("support", "sr", "pr"):
                    anchor[f] += row[f]
                anchor["merged"] += 1
                if "median_mapq" in more:
                    anchor["median_mapq"] = np.fmax(anchor["median_mapq"], row["median_mapq"])
                if "background_p" in more:
                    anchor["background_p"] = np.fmin(anchor["background_p"], row["background_p"])
                if "callers" in more:
                    held = [] if anchor["callers"] is None else list(anchor["callers"])
                    anchor["callers"] = held + [c for c in dict.fromkeys(() if row["callers"] is None else row["callers"]) if c not in held]
            else:
                anchor = row | {"merged": 1}
                out.append(anchor)
        return pd.DataFrame(out)[[*fields, "merged"]]

    typed = rows.select(*(F.col(f).cast(more[f]) if f in more else F.col(f) for f in fields), *(["tier"] if "tier" in rows.columns else []))
    passing = typed.where("tier <> 'filtered'").drop("tier") if "tier" in rows.columns else typed
    dealt = islands(passing, ["ca", "cb", "orient"], "median_a", window, "near")
    schema = "ca string, cb string, orient string, median_a long, median_b long, support long, sr long, pr long, event_id string" + "".join(f", {c} {t}" for c, t in more.items()) + ", merged long"
    out = dealt.groupBy("ca", "cb", "orient", "near").applyInPandas(run, schema)
    return out.unionByName(typed.where("tier = 'filtered'").drop("tier").withColumn("merged", F.lit(1).cast("long"))) if "tier" in rows.columns else out


def cross_merged(rows: DataFrame, distance: int = DEFAULTS.merge_distance) -> DataFrame:
    """Merges a cluster into the one before if both medians lie within ``distance``; medians are recomputed after each merge.

    ``rows`` are reads with their cluster; returns (event_id, into, support). Reads are first
    counted by position, so that a group grows with distinct positions and not with reads.
    """
    from .evidence import CLUSTER, islands

    side = F.array(*(F.struct(F.lit(s).alias("side"), F.col(f"pos_{s}").alias("pos")) for s in "ab"))
    counted = rows.select(*CLUSTER, F.explode(side).alias("e")).groupBy(*CLUSTER, "e.side", "e.pos").agg(F.count("*").alias("n")).withColumn("event_id", F.concat_ws("_", *CLUSTER))

    def mid(held: tuple[np.ndarray, np.ndarray]) -> int:
        """The median of counted positions, which are sorted; of two middles their mean, rounded down."""
        total = np.cumsum(held[1])
        low, high = (held[0][np.searchsorted(total, k, side="right")] for k in ((total[-1] - 1) // 2, total[-1] // 2))
        return int(low + high) // 2

    def both(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        pos, at = np.unique(np.r_[x[0], y[0]], return_inverse=True)
        n = np.zeros(len(pos), np.int64)
        np.add.at(n, at, np.r_[x[1], y[1]])
        return pos, n

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        seen = {k: (g["pos"].to_numpy(), g["n"].to_numpy()) for k, g in pdf.sort_values("pos").groupby(["event_id", "side"])}
        last, out = None, []
        for *at, event in sorted((mid(seen[i, "a"]), mid(seen[i, "b"]), i) for i in pdf["event_id"].unique()):
            own = [seen[event, s] for s in "ab"]
            if last and all(abs(m - x) <= distance for m, x in zip(at, last[1], strict=True)):
                joined = [both(x, y) for x, y in zip(last[2], own, strict=True)]
                last = (last[0], [mid(x) for x in joined], joined)
            else:
                last = (event, at, own)
            out.append((event, last[0], int(own[0][1].sum())))
        return pd.DataFrame(out, columns=["event_id", "into", "support"])

    medians = rows.groupBy(*CLUSTER).agg(F.median("pos_a").cast("long").alias("median_a"))
    near = islands(medians.withColumn("event_id", F.concat_ws("_", *CLUSTER)), ["ca", "cb"], "median_a", 4 * distance, "near").select("event_id", "near")
    dealt = counted.join(near, "event_id").select("ca", "cb", "near", "event_id", "side", "pos", "n")
    return dealt.groupBy("ca", "cb", "near").applyInPandas(run, "event_id string, into string, support long")


def split(rows: DataFrame, n: int = DEFAULTS.top_n_candidates) -> tuple[DataFrame, DataFrame]:
    """All high tiers with the candidates that fill them up to ``n`` rows, best first; and the candidates that are left."""
    kept = stored(rows.where("tier <> 'filtered'").select("event_id", "tier", "score"))
    high, candidates = kept.where("tier <> 'candidate'"), kept.where("tier = 'candidate'")
    fill = stored(candidates.orderBy(F.desc("score"), "event_id").limit(max(0, n - high.count())))  # at most n rows
    return high.unionByName(fill), candidates.join(F.broadcast(fill.select("event_id")), "event_id", "left_anti")


def selected(rows: DataFrame, n: int = DEFAULTS.top_n_candidates) -> DataFrame:
    """All high tiers, and candidates up to ``n`` rows in all, by score; numbered."""
    top, _ = split(rows, n)
    # high tiers are as many as the data has: numbered from each sorted partition's count, not in one task
    row = F.monotonically_increasing_id()
    placed = stored(top.orderBy(F.desc("score"), "event_id").select("*", F.shiftright(row, 33).alias("part"), row.bitwiseAND((1 << 33) - 1).alias("at")))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    starts = placed.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    out = placed.join(F.broadcast(starts), "part")
    return out.withColumn("cluster_id", F.format_string("CLU_%03d", F.col("start") + F.col("at") + 1)).select("cluster_id", "event_id", "tier", "score")


def tier_counts(rows: DataFrame) -> DataFrame:
    """Clusters of every tier, zeros included."""
    names = rows.sparkSession.createDataFrame([(t,) for t in TIERS], "tier string")
    return names.join(rows.groupBy("tier").agg(F.count("*").alias("n")), "tier", "left").fillna({"n": 0})
