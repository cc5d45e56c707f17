"""Registered queries over the test views, and the SQL each is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import annotate, background, evidence, legacy, output, quantiles, report, tiers
from ..sources import views
from ..storage import stored
from ..streaming import live

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _duck(sql: str) -> str:
    return sql.replace("STR", "varchar")


_CASCADE = "".join(
    f", s{i} as (select * from (select *, count(*) over (partition by ca, cb, floor(pos_a/{w}), floor(pos_b/{w})) k from {src}) where k >= 2)".replace("select *, count", "select * exclude (k), count" if i > 1 else "select *, count")
    for i, (w, src) in enumerate(((1_000_000, "canon"), (100_000, "s1"), (10_000, "s2"), (1_000, "s3")), 1)
)
#: The views, then the spine: canonical reads, cascade s1..s4, islands, clusters.
WITH = _duck(f"""with reads as ({views.READS}), masks as ({views.MASKS}), bnds as ({views.BNDS}),
disc as (select * from reads where mapq >= 20 and chrom <> mate_chrom),
canon as (select read_name_hash, mapq, evidence_type, flag, least(chrom, mate_chrom) ca, greatest(chrom, mate_chrom) cb,
  case when chrom <= mate_chrom then pos else mate_pos end pos_a, case when chrom <= mate_chrom then mate_pos else pos end pos_b,
  case when chrom <= mate_chrom then (case when is_reverse then '-' else '+' end) || (case when mate_is_reverse then '-' else '+' end)
       else (case when mate_is_reverse then '-' else '+' end) || (case when is_reverse then '-' else '+' end) end orient from disc){_CASCADE},
ia as (select *, sum(g) over (partition by ca, cb, orient order by pos_a range unbounded preceding) ga from (select * exclude (k), case when pos_a - lag(pos_a) over (partition by ca, cb, orient order by pos_a) > 500 then 1 else 0 end g from s4)),
fa as (select *, min(pos_a) over (partition by ca, cb, orient, ga) isl_a from ia),
ib as (select *, sum(h) over (partition by ca, cb, orient, ga order by pos_b range unbounded preceding) gb from (select *, case when pos_b - lag(pos_b) over (partition by ca, cb, orient, ga order by pos_b) > 500 then 1 else 0 end h from fa)),
fb as (select *, min(pos_b) over (partition by ca, cb, orient, ga, gb) isl_b from ib),
clusters as (select ca, cb, orient, isl_a, isl_b, count(*) support, count(*) filter (evidence_type = 'split') sr, count(*) filter (evidence_type <> 'split') pr,
  cast(trunc(median(pos_a)) as bigint) median_a, cast(trunc(median(pos_b)) as bigint) median_b, min(pos_a) lo_a, max(pos_a) hi_a, min(pos_b) lo_b, max(pos_b) hi_b,
  count(distinct pos_a) starts_a, count(distinct pos_b) starts_b, median(mapq) filter (mapq > 0) median_mapq, avg(case when flag & 1024 <> 0 then 1.0 else 0.0 end) dup_fraction,
  concat_ws('_', ca, cb, orient, isl_a, isl_b) event_id from fb group by 1, 2, 3, 4, 5 having count(*) >= 3),
ends as (select chrom, pos, mate_chrom partner from disc union all select mate_chrom, mate_pos, chrom from disc),
bins10 as (select chrom, cast(floor(pos/10000) as bigint) bin, count(*) n, count(distinct partner) partners from ends group by 1, 2),
med10 as (select chrom, median(n) median_n from bins10 group by 1),
rate10 as (select chrom, bin, n / greatest(median_n, 1) lcr, partners from bins10 join med10 using (chrom)),
merged as (select track, chrom, min(start_pos) start_pos, max(end_pos) end_pos from (select *, sum(o) over (partition by track, chrom order by start_pos range unbounded preceding) isl from
  (select *, case when start_pos > max(end_pos) over (partition by track, chrom order by start_pos range between unbounded preceding and 1 preceding) then 1 else 0 end o from masks)) group by track, chrom, isl),
sides as (select event_id, 'a' side, ca chrom, median_a pos from clusters union all select event_id, 'b', cb, median_b from clusters),
stabs as (select distinct event_id, side, track from sides s join merged m on s.chrom = m.chrom and s.pos between m.start_pos and m.end_pos),
calls as (select caller, chrom_a, pos_a, chrom_b, pos_b from bnds where chrom_a <> chrom_b union all select caller, chrom_b, pos_b, chrom_a, pos_a from bnds where chrom_a <> chrom_b),
ext as (select event_id, count(distinct caller) n_ext from clusters join calls on ca = chrom_a and cb = chrom_b and abs(median_a - pos_a) <= 1000 and abs(median_b - pos_b) <= 1000 group by 1),
recip as (select x.event_id, min(y.event_id) partner from clusters x join clusters y on x.ca = y.ca and x.cb = y.cb and translate(y.orient, '+-', '-+') = x.orient and abs(x.median_a - y.median_a) <= 1000 and abs(x.median_b - y.median_b) <= 1000 group by 1),
bins1 as (select chrom, cast(floor(pos/1000) as bigint) bin, count(*) n from ends where pos >= 0 and pos < 20000000 group by 1, 2),
mom as (select chrom, sum(w)/20000.0 mean, sum(w*w)/20000.0 - (sum(w)/20000.0)*(sum(w)/20000.0) var from (select chrom, i, sum(n) w from (select chrom, n, unnest(range(greatest(bin - 4, 0), least(bin + 5, 19999) + 1)) i from bins1) group by 1, 2) group by 1)
""")

_ALL_COLUMNS = "event_id, support, sr, pr, median_a, median_b, lo_a, hi_a, lo_b, hi_b, starts_a, starts_b, cast(median_mapq as double) median_mapq, round(dup_fraction, 6) dup_fraction"


def _query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = WITH + _duck(sql) if "events" not in sql and "lineitem" not in sql else _duck(sql)
        return f

    return add


def _disc(spark, d):
    return evidence.discordant(views.reads(spark, d))


def _parts(spark, d):
    return evidence.parts(views.reads(spark, d))


def _survivors(spark, d, *unused):
    return evidence.survivors(evidence.canonical(_disc(spark, d)).drop(*unused), _parts(spark, d))


def _clustered(spark, d):
    return evidence.clustered(_survivors(spark, d), parts=_parts(spark, d))


def _clusters(spark, d):
    """Clusters, which don't need the reads' names."""
    parts = _parts(spark, d)
    return evidence.clusters(evidence.clustered(_survivors(spark, d, "read_name_hash"), parts=parts), parts=parts)


def _merged(spark, d):
    masks = views.masks(spark, d)
    return annotate.merged_intervals(masks, evidence.parts(masks))


def annotated(spark: SparkSession, d: str) -> DataFrame:
    """Clusters with everything the gates ask for."""
    disc, own = _disc(spark, d), stored(_clusters(spark, d))
    c = annotate.local_coverage(own, stored(annotate.end_bins(disc)))
    c = c.join(annotate.external_support(own, views.bnds(spark, d)), "event_id", "left").fillna({"n_ext": 0})
    c = c.join(annotate.reciprocal(own), "event_id", "left")
    stabs = annotate.stabbed(own, _merged(spark, d))
    per = stabs.groupBy("event_id").agg(*(F.array_sort(F.collect_set(F.when(F.col("side") == s, F.col("track")))).alias(f"tracks_{s}") for s in "ab"))
    c = c.join(per, "event_id", "left")
    for s in "ab":
        c = c.withColumn(f"tracks_{s}", F.coalesce(f"tracks_{s}", F.array().cast("array<string>")))
    c = annotate.with_identity(c, annotate.best_identity(views.masks(spark, d).where("track = 'segdup'")))
    c = c.join(annotate.pair_enrichment(evidence.pair_density(disc), 6).select("ca", "cb", "enrichment"), ["ca", "cb"], "left")
    tails = background.background(own, disc).select("event_id", "rate_a", "rate_b", "p_a", "p_b", "background_p")
    return c.join(tails, "event_id")


def tiered(spark: SparkSession, d: str) -> DataFrame:
    c = annotated(spark, d).withColumn("excluded", tiers.hard_exclude()).withColumn("rejected", tiers.reject_reason())
    c = c.withColumn("gone", F.coalesce("excluded", "rejected").isNotNull()).withColumn("tier", tiers.tier())
    return c.withColumn("score", tiers.score())


@_query("evidence_funnel", """select 'discordant' step, (select count(*) from disc) n union all select '1mb', (select count(*) from s1) union all select '100kb', (select count(*) from s2)
 union all select '10kb', (select count(*) from s3) union all select '1kb', (select count(*) from s4)""")
def _q(spark, d):
    canon = evidence.canonical(_disc(spark, d))
    parts = _parts(spark, d)
    out = canon.agg(F.lit("discordant").alias("step"), F.count("*").alias("n"))
    for k, name in enumerate(("1mb", "100kb", "10kb", "1kb"), 1):
        out = out.union(evidence.cascade(canon, (1_000_000, 100_000, 10_000, 1_000)[:k], parts).agg(F.lit(name), F.count("*")))
    return out


@_query("pair_density", "select least(chrom, mate_chrom) ca, greatest(chrom, mate_chrom) cb, count(*) n from disc group by 1, 2")
def _q(spark, d):
    return evidence.pair_density(_disc(spark, d))


@_query("pair_matrix", "select a, b, count(*) n from (select chrom a, mate_chrom b from disc union all select mate_chrom, chrom from disc) group by 1, 2")
def _q(spark, d):
    p = evidence.pair_density(_disc(spark, d))
    return p.select(F.explode(F.array(F.struct(F.col("ca").alias("a"), F.col("cb").alias("b")), F.struct(F.col("cb").alias("a"), F.col("ca").alias("b")))).alias("m"), "n").groupBy("m.a", "m.b").agg(F.sum("n").alias("n"))


@_query("top_pairs", "select least(chrom, mate_chrom) ca, greatest(chrom, mate_chrom) cb, count(*) n from disc group by 1, 2 order by n desc, 1, 2 limit 10")
def _q(spark, d):
    return evidence.pair_density(_disc(spark, d)).orderBy(F.desc("n"), "ca", "cb").limit(10)


@_query("bin_counts_100k", "select chrom, cast(floor(pos/100000) as bigint) bin, count(*) filter (evidence_type='discordant') d, count(*) filter (evidence_type='split') s from disc group by 1, 2")
def _q(spark, d):
    return _disc(spark, d).groupBy("chrom", F.floor(F.col("pos") / 100_000).cast("long").alias("bin")).agg(F.count_if(F.col("evidence_type") == "discordant").alias("d"), F.count_if(F.col("evidence_type") == "split").alias("s"))


@_query("contig_totals", "select coalesce(chrom, 'all') chrom, count(*) n from disc group by rollup(chrom)")
def _q(spark, d):
    return _disc(spark, d).rollup("chrom").agg(F.count("*").alias("n")).select(F.coalesce("chrom", F.lit("all")).alias("chrom"), "n")


@_query("dedup_reads", "select read_name_hash, chrom, mate_chrom, min(pos) pos from disc group by 1, 2, 3")
def _q(spark, d):
    return evidence.deduped(_disc(spark, d)).select("read_name_hash", "chrom", "mate_chrom", "pos")


@_query("library_stats", "select count(*) n, median(v) median_v, round(avg(v),6) mean_v, round(stddev_pop(v),6) std_v, quantile_cont(v,0.25) q25, quantile_cont(v,0.75) q75, (select median(abs(v-m)) from t2) mad from t2 where 1=1 group by ()".replace("t2", "(select cast(abs(mate_pos-pos) as double) v, median(cast(abs(mate_pos-pos) as double)) over () m from reads where chrom = mate_chrom)"))
def _q(spark, d):
    v = views.reads(spark, d).where("chrom = mate_chrom").select(F.abs(F.col("mate_pos") - F.col("pos")).cast("double").alias("v"))
    one = lambda x: F.lit(x).cast("double")
    q25, mid, q75 = quantiles.quantiles(v, "v", [0.25, 0.5, 0.75])
    mad = quantiles.quantiles(v.select(F.abs(F.col("v") - one(mid)).alias("v")), "v", [0.5])[0]
    base = v.agg(F.count("*").alias("n"), F.round(F.avg("v"), 6).alias("mean_v"), F.round(F.stddev_pop("v"), 6).alias("std_v"))
    return base.select("n", one(mid).alias("median_v"), "mean_v", "std_v", one(q25).alias("q25"), one(q75).alias("q75"), one(mad).alias("mad"))


@_query("cigar_length", "select l_orderkey, l_linenumber, cast(l_quantity as bigint) + l_linenumber aligned, case when l_suppkey % 7 > 0 then 'right' else 'none' end side, cast(l_suppkey % 7 as int) clip from lineitem")
def _q(spark, d):
    t = spark.read.parquet(f"{d}/lineitem.parquet").withColumn("cigar", F.concat(F.col("l_quantity").cast("int"), F.lit("M3I"), F.col("l_linenumber"), F.lit("D"), F.when(F.col("l_suppkey") % 7 > 0, F.concat((F.col("l_suppkey") % 7).cast("string"), F.lit("S"))).otherwise("")))
    clip = scalar.clip_side_length(F.col("cigar"))
    return t.select("l_orderkey", "l_linenumber", scalar.aligned_length(F.col("cigar")).alias("aligned"), F.coalesce(clip["side"], F.lit("none")).alias("side"), F.coalesce(clip["len"], F.lit(0)).alias("clip"))


@_query("sa_parse", "select l_orderkey, l_linenumber, 'chr' || (l_suppkey % 6 + 1) chrom, l_partkey pos, cast(l_quantity as int) mapq from lineitem where l_linenumber <= 3")
def _q(spark, d):
    t = spark.read.parquet(f"{d}/lineitem.parquet")
    tag = F.when(F.col("l_linenumber") <= 3, F.format_string("chr%d,%d,+,60M40S,%d,0;bad,x,+,1M,1,0;", F.col("l_suppkey") % 6 + 1, "l_partkey", F.col("l_quantity").cast("int"))).otherwise("")
    return t.select("l_orderkey", "l_linenumber", F.explode(scalar.parsed_sa(tag)).alias("s")).select("l_orderkey", "l_linenumber", "s.chrom", "s.pos", "s.mapq")


@_query("canonical_reads", "select read_name_hash, ca, cb, pos_a, pos_b, orient from canon")
def _q(spark, d):
    return evidence.canonical(_disc(spark, d)).select("read_name_hash", "ca", "cb", "pos_a", "pos_b", "orient")


@_query("preaggregate_1mb", "select read_name_hash, pos_a, pos_b from s1")
def _q(spark, d):
    return evidence.dense_at(evidence.canonical(_disc(spark, d)), 1_000_000, parts=_parts(spark, d)).select("read_name_hash", "pos_a", "pos_b")


@_query("cascade_survivors", "select read_name_hash, ca, cb, pos_a, pos_b, orient from s4")
def _q(spark, d):
    return _survivors(spark, d).select("read_name_hash", "ca", "cb", "pos_a", "pos_b", "orient")


@_query("islands_ab", "select read_name_hash, ca, cb, orient, isl_a, isl_b from fb")
def _q(spark, d):
    return _clustered(spark, d).select("read_name_hash", *evidence.CLUSTER)


@_query("cluster_stats", f"select {_ALL_COLUMNS} from clusters")
def _q(spark, d):
    return _clusters(spark, d).selectExpr("event_id", "support", "sr", "pr", "median_a", "median_b", "lo_a", "hi_a", "lo_b", "hi_b", "starts_a", "starts_b", "cast(median_mapq as double) median_mapq", "round(dup_fraction, 6) dup_fraction")


@_query("cluster_ci", """select event_id, case when lo_a<hi_a then lo_a else median_a - p end ci_lo_a, case when lo_a<hi_a then hi_a else median_a + p end ci_hi_a,
 case when lo_b<hi_b then lo_b else median_b - p end ci_lo_b, case when lo_b<hi_b then hi_b else median_b + p end ci_hi_b from (select *, case when pr > 0 then 500 else 2 end p from clusters)""")
def _q(spark, d):
    return evidence.intervals(_clusters(spark, d))


@_query("orientation_hist", "select ca, cb, orient, count(*) n from s4 group by 1, 2, 3")
def _q(spark, d):
    return _survivors(spark, d).groupBy("ca", "cb", "orient").agg(F.count("*").alias("n"))


@_query("reciprocal_pairs", "select event_id, partner from recip")
def _q(spark, d):
    return annotate.reciprocal(_clusters(spark, d))


@_query("disc_bin_10k", "select chrom, bin, n, partners from bins10")
def _q(spark, d):
    return annotate.end_bins(_disc(spark, d))


@_query("chrom_median_cov", "select chrom, median_n from med10")
def _q(spark, d):
    return annotate.chrom_medians(annotate.end_bins(_disc(spark, d)))


@_query("local_cov_ratio", """select event_id, round(coalesce(a.lcr,0),6) lcr_a, round(coalesce(b.lcr,0),6) lcr_b, coalesce(a.partners,0) partners_a, coalesce(b.partners,0) partners_b from clusters
 left join rate10 a on a.chrom=ca and a.bin=floor(median_a/10000) left join rate10 b on b.chrom=cb and b.bin=floor(median_b/10000)""")
def _q(spark, d):
    c = annotate.local_coverage(_clusters(spark, d), annotate.end_bins(_disc(spark, d)))
    return c.select("event_id", F.round("lcr_a", 6).alias("lcr_a"), F.round("lcr_b", 6).alias("lcr_b"), "partners_a", "partners_b")


@_query("pair_enrichment", "select ca, cb, n, round(n / greatest(sum(n) over () / 15.0, 1), 6) enrichment from (select ca, cb, count(*) n from canon group by 1, 2)")
def _q(spark, d):
    return annotate.pair_enrichment(evidence.pair_density(_disc(spark, d)), 6).withColumn("enrichment", F.round("enrichment", 6))


@_query("nb_window_moments", "select chrom, round(mean, 6) mean, round(var, 10) var from mom")
def _q(spark, d):
    return background.window_moments(background.bins(_disc(spark, d))).select("chrom", F.round("mean", 6).alias("mean"), F.round("var", 10).alias("var"))


@_query("nb_params", "select chrom, round(case when mean<=0 or var<=mean then 1e6 else least(greatest(mean*mean/(var-mean),0.01),1e8) end, 5) r, round(case when mean<=0 then 0.999 when var<=mean then 1e6/(1e6+mean) else mean/var end, 6) p from mom")
def _q(spark, d):
    return background.nb_params(background.window_moments(background.bins(_disc(spark, d)))).select("chrom", F.round("r", 5).alias("r"), F.round("p", 6).alias("p"))


@_query("local_rate", """select event_id, cast(coalesce((select sum(n) from bins1 b where b.chrom=ca and b.bin between floor(median_a/1000)-5 and floor(median_a/1000)+5),0) as bigint) rate_a,
 cast(coalesce((select sum(n) from bins1 b where b.chrom=cb and b.bin between floor(median_b/1000)-5 and floor(median_b/1000)+5),0) as bigint) rate_b from clusters""")
def _q(spark, d):
    return background.local_rates(_clusters(spark, d), background.bins(_disc(spark, d)))


@_query("bh_adjust", """select event_id, round(q, 9) q from (select event_id, least(min(p * n / r) over (order by p desc range unbounded preceding), 1) q from (select event_id, p, count(*) over () n, count(*) over (order by p range unbounded preceding) r from (select event_id, 1.0 / (1 + support * support) p from clusters)))""")
def _q(spark, d):
    rows = _clusters(spark, d).select("event_id", (1.0 / (1 + F.col("support") * F.col("support"))).alias("p"))
    return background.bh_adjusted(rows, "p").select("event_id", F.round("q", 9).alias("q"))


@_query("mask_merge", "select track, chrom, start_pos, end_pos from merged")
def _q(spark, d):
    return _merged(spark, d)


@_query("mask_stab", "select event_id, side, track from stabs")
def _q(spark, d):
    return annotate.stabbed(_clusters(spark, d), _merged(spark, d))


@_query("segdup_max", "select chrom, bin, max(pct_identity) max_pct from (select chrom, pct_identity, unnest(range(start_pos // 1000, end_pos // 1000 + 1)) bin from masks where track = 'segdup') group by 1, 2")
def _q(spark, d):
    return annotate.best_identity(views.masks(spark, d).where("track = 'segdup'"))


@_query("ext_match", "select event_id, n_ext from ext")
def _q(spark, d):
    return annotate.external_support(_clusters(spark, d), views.bnds(spark, d))


@_query("v1_score", "select event_id, round(5.0*sr + 3.0*pr + least(2*greatest(starts_a-1,0)+2*greatest(starts_b-1,0),20) + 10*(least(greatest(median_mapq,20),60)-20)/40.0, 6) score from clusters")
def _q(spark, d):
    return _clusters(spark, d).select("event_id", F.round(tiers.v1_score(), 6).alias("score"))


_REASON = """select c.event_id, case when exists (select 1 from stabs s where s.event_id=c.event_id and side='a' and track='encode_blacklist') then 'blacklist_a'
 when exists (select 1 from stabs s where s.event_id=c.event_id and side='b' and track='encode_blacklist') then 'blacklist_b'
 when exists (select 1 from stabs s where s.event_id=c.event_id and side='a' and track='centromere') then 'centromere_core_a'
 when exists (select 1 from stabs s where s.event_id=c.event_id and side='b' and track='centromere') then 'centromere_core_b' end excluded,
 case when sr=0 and pr<10 then 'sr0_pr_lt10' when dup_fraction>0.7 then 'duplicate_fraction' when starts_a+starts_b<5 then 'low_unique_starts'
 when sr=0 and (coalesce(a.lcr,0)>3 or coalesce(b.lcr,0)>3) then 'local_coverage'
 when sr=0 and greatest(coalesce(a.partners,0),coalesce(b.partners,0))>=5 and coalesce(n_ext,0)=0 then 'promiscuous' end rejected
 from clusters c left join rate10 a on a.chrom=ca and a.bin=floor(median_a/10000) left join rate10 b on b.chrom=cb and b.bin=floor(median_b/10000) left join ext e on e.event_id=c.event_id"""


#: Negative-binomial and Poisson tails as sums of their terms; ``TERMS`` are past double precision.
TERMS = 6000
_TAILS = f"""fitted as (select chrom, case when mean<=0 or var<=mean then 1e6 else least(greatest(mean*mean/(var-mean),0.01),1e8) end r, case when mean<=0 then 0.999 when var<=mean then 1e6/(1e6+mean) else mean/var end p from mom),
near as (select s.event_id, s.side, s.chrom, cast(coalesce(sum(n),0) as double) rate from sides s left join bins1 b on b.chrom = s.chrom and b.bin between floor(s.pos/1000)-5 and floor(s.pos/1000)+5 group by 1, 2, 3),
held as (select n.event_id, side, support k, n.rate obs, greatest(n.rate, 1e-300) rate, case when coalesce(r, 1e6) < 1e5 then greatest(0.01, r*n.rate/(r*(1-p)/p)) end r2 from near n join clusters using (event_id) left join fitted f on f.chrom = n.chrom),
tails as (select event_id, side, case when max(obs) <= 0 then 0.0 else least(sum(case when r2 is null then exp(i*ln(rate)-rate-lgamma(i+1)) else exp(lgamma(i+r2)-lgamma(r2)-lgamma(i+1)+r2*ln(r2/(r2+rate))+i*ln(rate/(r2+rate))) end), 1.0) end p
  from (select *, k + j i from held, (select unnest(range({TERMS})) j)) group by 1, 2),
ps as (select event_id, max(p) filter (side = 'a') p_a, max(p) filter (side = 'b') p_b from tails group by 1)"""
_FULL = f"""{_TAILS}, reasons as ({_REASON}), kb as (select chrom, bin, max(pct_identity) pct from (select chrom, pct_identity, unnest(range(start_pos // 1000, end_pos // 1000 + 1)) bin from masks where track = 'segdup') group by 1, 2),
enr as (select ca, cb, n / greatest(sum(n) over () / 15.0, 1) enrichment from (select ca, cb, count(*) n from canon group by 1, 2)),
wide as (select c.*, p_a, p_b, least(p_a, p_b) bp, excluded, rejected, coalesce(excluded, rejected) is not null gone, greatest(coalesce(a.lcr,0), coalesce(b.lcr,0)) lcr, greatest(coalesce(a.partners,0), coalesce(b.partners,0)) >= 5 prom, coalesce(n_ext,0) ext,
  greatest(coalesce(ka.pct,0), coalesce(kb2.pct,0)) pct, exists (select 1 from stabs s where s.event_id = c.event_id and track like '%blacklist%') black, enrichment, r.partner is not null rec
  from clusters c join ps using (event_id) join reasons using (event_id) left join rate10 a on a.chrom=ca and a.bin=floor(median_a/10000) left join rate10 b on b.chrom=cb and b.bin=floor(median_b/10000) left join ext e on e.event_id=c.event_id
  left join kb ka on ka.chrom=ca and ka.bin=floor(median_a/1000) left join kb kb2 on kb2.chrom=cb and kb2.bin=floor(median_b/1000) left join enr on enr.ca=c.ca and enr.cb=c.cb left join recip r on r.event_id=c.event_id),
gates as (select *, (pr>=15 and sr=0 and lcr<=1.5 and starts_a>=10 and starts_b>=10 and pct<95 and not black) or (pr>=5 and sr>=1 and pct<95 and not black and not prom) strong,
  pr>=6 and sr>=3 and p_a<1e-6 and p_b<1e-6 and pct<95 and not black and not prom own from wide),
graded as (select *, strong and (sr>=2 or ext>=1) likely, own or (strong and ext>=2) valid from gates),
tiered as (select *, case when gone then 'filtered' when valid and ext>=3 then 'confirmed' when valid then 'validated' when likely then 'likely' when strong then 'strong_candidate' when pr>=3 or sr>=1 then 'candidate' else 'filtered' end tier from graded),
parts as (select *, round(5*log2(pr+1),1) support_pr, round(10*log2(sr+1),1) support_sr, 0.0::double support_clip, round(least(-log10(greatest(p_a,1e-300)),20),1) pvalue_a, round(least(-log10(greatest(p_b,1e-300)),20),1) pvalue_b, round(0.5::double*least(starts_a,starts_b),1) unique_starts,
  case when hi_a-lo_a<1000 and hi_b-lo_b<1000 and support>=3 then 5.0::double else 0 end tightness_bonus, round(least(0.5*enrichment,10),1)::double enrichment_over_bg, case when rec then 10.0::double else 0 end reciprocal, 15.0::double*ext as external, round(0.2::double*coalesce(median_mapq,0),1) mapq,
  case when dup_fraction>0.5 then -5.0::double else 0 end dup_penalty, case when prom then -10.0::double else 0 end promiscuous_penalty from tiered),
scored as (select *, case when tier='filtered' then 0.0 else round(support_pr+support_sr+support_clip+pvalue_a+pvalue_b+unique_starts+tightness_bonus+enrichment_over_bg+reciprocal+external+mapq+dup_penalty+promiscuous_penalty,1) end score from parts),
fill as (select event_id from scored where tier='candidate' order by score desc, event_id limit (select greatest(0, 100 - count(*)) from scored where tier not in ('candidate','filtered'))),
top as (select *, 'CLU_' || lpad(cast(row_number() over (order by score desc, event_id) as varchar), greatest(3, length(cast(row_number() over (order by score desc, event_id) as varchar))::int), '0') cluster_id from scored where tier not in ('candidate','filtered') or event_id in (select event_id from fill)),
names as (select unnest(['confirmed','validated','likely','strong_candidate','candidate','filtered']) tier)"""
_PARTS = ("support_pr", "support_sr", "support_clip", "pvalue_a", "pvalue_b", "unique_starts", "tightness_bonus", "enrichment_over_bg", "reciprocal", "external", "mapq", "dup_penalty", "promiscuous_penalty")


def _tiered_sql(select: str) -> str:
    """SQL over the views, the clusters and their tiers."""
    return f", {_FULL} {select}"


@_query("exclude_and_reject", _REASON)
def _q(spark, d):
    return tiered(spark, d).select("event_id", "excluded", "rejected")


@_query("filter_breakdown", f"select coalesce(excluded, rejected) reason, count(*) n from ({_REASON}) where coalesce(excluded, rejected) is not null group by 1")
def _q(spark, d):
    return tiered(spark, d).select(F.coalesce("excluded", "rejected").alias("reason")).where("reason is not null").groupBy("reason").agg(F.count("*").alias("n"))


@_query("nb_pvalues", f", {_TAILS} select event_id, round(p_a, 6) p_a, round(p_b, 6) p_b, round(least(p_a, p_b), 6) background_p, round(-log10(greatest(least(p_a, p_b), 1e-300)), 6) as minus_log10 from ps")
def _q(spark, d):
    p = background.background(_clusters(spark, d), _disc(spark, d))
    decades = F.round(-F.log10(F.greatest("background_p", F.lit(1e-300))), 6)
    return p.select("event_id", *(F.round(c, 6).alias(c) for c in ("p_a", "p_b", "background_p")), decades.alias("minus_log10"))


@_query("tier_assign", _tiered_sql("select event_id, tier, score from scored"))
def _q(spark, d):
    return tiered(spark, d).select("event_id", "tier", "score")


@_query("tier_counts", _tiered_sql("select tier, count(event_id) n from names left join scored using (tier) group by 1"))
def _q(spark, d):
    return tiers.tier_counts(tiered(spark, d))


@_query("top_n", _tiered_sql("select cluster_id, event_id, tier, score from top"))
def _q(spark, d):
    return tiers.selected(tiered(spark, d))


@_query("window_merge", _tiered_sql("""select * from (with recursive ordered as (select *, row_number() over (partition by ca, cb, orient order by median_a, median_b, event_id) k from tiered where tier <> 'filtered'),
 walk as (select ca, cb, orient, k, median_a a, median_b b, event_id g, event_id from ordered where k = 1 union all
  select o.ca, o.cb, o.orient, o.k, case when abs(o.median_a - a) <= 5000 and abs(o.median_b - b) <= 5000 then a else o.median_a end, case when abs(o.median_a - a) <= 5000 and abs(o.median_b - b) <= 5000 then b else o.median_b end,
   case when abs(o.median_a - a) <= 5000 and abs(o.median_b - b) <= 5000 then g else o.event_id end, o.event_id from walk w join ordered o on o.ca = w.ca and o.cb = w.cb and o.orient = w.orient and o.k = w.k + 1)
 select g event_id, cast(sum(support) as bigint) support, cast(sum(sr) as bigint) sr, cast(sum(pr) as bigint) pr, max(median_mapq) median_mapq, round(min(bp), 6) background_p, count(*) merged from walk w join ordered o using (event_id) group by g
 union all select event_id, support, sr, pr, median_mapq, round(bp, 6), 1 from tiered where tier = 'filtered')"""))
def _q(spark, d):
    return tiers.anchored(tiered(spark, d)).select("event_id", "support", "sr", "pr", "median_mapq", F.round("background_p", 6).alias("background_p"), "merged")


@_query("cross_merge")
def _q(spark, d):
    return tiers.cross_merged(_clustered(spark, d))


@_query("vcf_rows", """select ca chrom, median_a + 1 pos, event_id || '_1' id, case orient when '++' then 'N['||cb||':'||(median_b+1)||'[' when '+-' then 'N]'||cb||':'||(median_b+1)||']' when '-+' then ']'||cb||':'||(median_b+1)||']N' else '['||cb||':'||(median_b+1)||'[N' end alt, event_id||'_2' mate_id, 'SVTYPE=BND;MATEID='||event_id||'_2;SUPPORT='||support info from clusters
 union all select cb, median_b + 1, event_id || '_2', case reverse(orient) when '++' then 'N['||ca||':'||(median_a+1)||'[' when '+-' then 'N]'||ca||':'||(median_a+1)||']' when '-+' then ']'||ca||':'||(median_a+1)||']N' else '['||ca||':'||(median_a+1)||'[N' end, event_id||'_1', 'SVTYPE=BND;MATEID='||event_id||'_1;SUPPORT='||support from clusters""")
def _q(spark, d):
    return output.vcf_rows(_clusters(spark, d))


@_query("bedpe_rows", _tiered_sql("""select ca chrom1, median_a start1, median_a+1 end1, cb chrom2, median_b start2, median_b+1 end2, replace(cluster_id,'CLU','TRA') as name, printf('%.4f', score) score, orient[1] strand1, orient[2] strand2, tier, support, printf('%.6e', bp) bg_pval from top"""))
def _q(spark, d):
    rows = stored(tiered(spark, d))
    return output.bedpe_rows(tiers.selected(rows).join(rows.drop("tier", "score"), "event_id"))


@_query("score_v2", _tiered_sql(f"select event_id, score, {', '.join(_PARTS)} from scored where tier <> 'filtered'"))
def _q(spark, d):
    return tiered(spark, d).where("tier <> 'filtered'").select("event_id", "score", *(v.alias(k) for k, v in tiers.components().items()))


@_query("progressive_label", _tiered_sql("""select event_id, case when pr<3 and sr<1 then 'raw_cluster' when not (p_a<0.01 and p_b<0.01 and dup_fraction<=0.7) then 'enriched_cluster' when not (starts_a>=5 and starts_b>=5 and dup_fraction<=0.5 and not prom and coalesce(median_mapq,0)>=20) then 'strong_cluster'
 when not (sr>=2 or ext>=1) then 'candidate_junction' when not (ext>=3 or (sr>=3 and pr>=6)) then 'likely_translocation' else 'confirmed' end as label, case when sr>0 and pr>0 then 'multi-evidence' when sr>0 then 'split-supported' else 'discordant-supported' end kind from tiered"""))
def _q(spark, d):
    return annotated(spark, d).select("event_id", tiers.label().alias("label"), tiers.evidence_kind().alias("kind"))


@_query("reject_reasons", _tiered_sql("""select event_id, case when gone then coalesce(excluded, rejected) else concat_ws(',', case when not own and not strong and pr>=15 and sr=0 and lcr>1.5 then printf('lcr_high:%.1f', lcr) end,
 case when not own and not strong and pr>=15 and sr=0 and least(starts_a,starts_b)<10 then 'low_unique_starts_for_sr0' end, case when not own and not strong and pr>=15 and sr=0 and pct>=95 then 'segdup_high_identity' end, case when not own and not strong and pr<5 then 'pr_lt5:'||pr end,
 case when not own and strong and not likely then 'no_split_or_external' end, case when not valid and pr<6 then 'pr_lt6:'||pr end, case when not valid and sr<3 then 'sr_lt3:'||sr end, case when not valid and p_a>=1e-6 then printf('pval_a_high:%.2e', p_a) end, case when not valid and p_b>=1e-6 then printf('pval_b_high:%.2e', p_b) end,
 case when not valid then 'not_validated' end, case when valid and ext<3 then 'no_confirmation_evidence' end, case when pr<3 and sr<1 then 'below_minimum_support' end) end reasons from tiered"""))
def _q(spark, d):
    return tiered(spark, d).select("event_id", F.concat_ws(",", tiers.reject_reasons()).alias("reasons"))


@_query("qc_report", _tiered_sql("""select *, case when chimeric_pct<1 then 'normal' when chimeric_pct<5 then 'elevated' else 'high' end chimeric_assessment, case when med between 200 and 600 then 'normal' else 'atypical' end insert_assessment,
 case when confirmed+validated+likely=0 then 'No high-confidence translocations detected.' else (confirmed+validated+likely+strong_candidate+candidate)||' translocation call'||case when confirmed+validated+likely+strong_candidate+candidate=1 then '' else 's' end||': '
 ||concat_ws(', ', case when confirmed>0 then confirmed||' confirmed' end, case when validated>0 then validated||' validated' end, case when likely>0 then likely||' likely' end, case when candidate>0 then candidate||' candidate' end)||'.' end summary from
 (select count(*) filter (tier='confirmed') confirmed, count(*) filter (tier='validated') validated, count(*) filter (tier='likely') likely, count(*) filter (tier='strong_candidate') strong_candidate, count(*) filter (tier='candidate') candidate, count(*) filter (tier='filtered') filtered,
 (select round(100*(select count(*) from disc)/count(*),6) from reads) chimeric_pct, (select median(abs(mate_pos-pos)) from reads where chrom=mate_chrom) med from tiered)""").replace("select *, case when chimeric_pct<1", "select * exclude (med), case when chimeric_pct<1"))
def _q(spark, d):
    reads = views.reads(spark, d)
    sizes = reads.where("chrom = mate_chrom").select(F.abs(F.col("mate_pos") - F.col("pos")).alias("v"))
    insert = spark.createDataFrame([tuple(quantiles.quantiles(sizes, "v", [0.5]))], "median_v double")
    rate = legacy.rate(reads, _disc(spark, d)).select((F.col("interchrom") / F.greatest("reads", F.lit(1))).alias("rate"))
    return report.qc_report(tiered(spark, d), rate, insert)


@_query("stream_tumbling", "select strftime(time_bucket(interval '1 hour', ts), '%Y-%m-%d %H:%M:%S') as start, event_type, count(*) n, round(sum(value),3) total from events group by 1, 2")
def _q(spark, d):
    return live.drained(live.counts(live.events(spark, d), "1 hour"))


@_query("stream_conflated", "select strftime(time_bucket(interval '1 hour', ts), '%Y-%m-%d %H:%M:%S') as start, event_type, arg_max(user_id, event_id) last_user, max(event_id) last_event from events group by 1, 2")
def _q(spark, d):
    return live.drained(live.conflated(live.events(spark, d), "1 hour"))


@_query("stream_sessions", """select strftime(min(ts), '%Y-%m-%d %H:%M:%S') as start, user_id, count(*) n from (select *, sum(o) over (partition by user_id order by ts range unbounded preceding) s from
 (select *, case when ts >= lag(ts) over (partition by user_id order by ts) + interval '2 hours' then 1 else 0 end o from events)) group by user_id, s""")
def _q(spark, d):
    return live.drained(live.sessions(live.events(spark, d), "2 hours"))


@_query("stall_detect", """select event_type, start, max(n) over (partition by event_type order by start rows between 4 preceding and current row) < 0.2 * median_n stalled from
 (select event_type, strftime(time_bucket(interval '1 hour', ts), '%Y-%m-%d %H:%M:%S') as start, count(*) n from events group by 1, 2) join (select event_type, median(n) median_n from (select event_type, time_bucket(interval '1 hour', ts) as b, count(*) n from events group by 1, 2) group by 1) using (event_type)""")
def _q(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    return live.stalls(live.counts(e, "1 hour").select("event_type", "start", "n"))


@_query("milestones", "select event_type, event_id, k from (select event_type, event_id, row_number() over (partition by event_type order by event_id) k from events) where k in (1, 5, 10, 25, 50, 100)")
def _q(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("event_type").orderBy("event_id")
    ranked = spark.read.parquet(f"{d}/events.parquet").select("event_type", "event_id", F.row_number().over(w).alias("k")).where("k <= 100")  # tasks keep 100 of a type
    return ranked.where(F.col("k").isin(1, 5, 10, 25, 50, 100)).withColumn("k", F.col("k").cast("long"))
