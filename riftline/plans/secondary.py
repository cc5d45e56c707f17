"""More registered queries: clips, first-generation rules, greedy decisions, evaluation, telemetry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalar
from ..storage import stored
from ..operators import annotate, background, clips, evidence, legacy, reads, resolve, tiers
from ..sources import views
from . import queries as own
from .queries import ORACLES, QUERIES, _query  # noqa: F401

CLIPS = """select concat('chr',cast(l_suppkey % 6 + 1 as STR)) as chrom, case when l_linenumber % 2 = 0 then 'left' else 'right' end as clip_side,
 1000000 + (l_partkey % 40) * 50000 + l_orderkey % 30 as pos from lineitem"""


def _clips(spark: SparkSession, d: str) -> DataFrame:
    return views.view(spark, d, "lineitem", CLIPS)


def _truth(spark: SparkSession, d: str) -> DataFrame:
    """External calls between contigs, numbered by key, as the truth set."""
    sql = views.BNDS.replace("select 'caller1' as caller", "select s_suppkey as truth_id")
    return views.view(spark, d, "supplier", sql).where("chrom_a <> chrom_b")


@_query("cascade_log", " union all ".join(f"select '{name}' scale, ca, cb, count(*) n from {t} group by 2, 3" for name, t in (("all", "canon"), ("1mb", "s1"), ("100kb", "s2"), ("10kb", "s3"), ("1kb", "s4"))))
def _q(spark, d):
    canon = evidence.canonical(own._disc(spark, d))
    per = lambda rows, name: rows.groupBy("ca", "cb").agg(F.count("*").alias("n")).select(F.lit(name).alias("scale"), "ca", "cb", "n")
    out, parts = per(canon, "all"), own._parts(spark, d)
    for k, name in enumerate(("1mb", "100kb", "10kb", "1kb"), 1):
        out = out.unionByName(per(evidence.cascade(canon, (1_000_000, 100_000, 10_000, 1_000)[:k], parts), name))
    return out


@_query("islands_a", "select read_name_hash, ca, cb, orient, isl_a from fa")
def _q(spark, d):
    return own._clustered(spark, d).select("read_name_hash", "ca", "cb", "orient", "isl_a")


@_query("promiscuous", """select event_id, greatest(coalesce(a.partners,0), coalesce(b.partners,0)) partners, greatest(coalesce(a.partners,0), coalesce(b.partners,0)) >= 5 promiscuous from clusters
 left join rate10 a on a.chrom=ca and a.bin=floor(median_a/10000) left join rate10 b on b.chrom=cb and b.bin=floor(median_b/10000)""")
def _q(spark, d):
    c = annotate.local_coverage(own._clusters(spark, d), annotate.end_bins(own._disc(spark, d)))
    most = F.greatest("partners_a", "partners_b")
    return c.select("event_id", most.alias("partners"), (most >= 5).alias("promiscuous"))


@_query("nb_bins", "select chrom, bin, n from bins1")
def _q(spark, d):
    return background.bins(own._disc(spark, d)).select("chrom", "bin", "n")


@_query("chimeric_rate", """select *, round(interchrom / (greatest(bins, 1) * greatest(bins, 1)), 9) rate from (select (select count(*) from reads) reads, (select count(*) from disc) interchrom,
 (select count(*) from (select distinct chrom, floor(pos/100000) from ends)) bins)""")
def _q(spark, d):
    return legacy.rate(views.reads(spark, d), own._disc(spark, d))


@_query("v1_cov_bins", "select chrom, cast(floor(least(greatest(pos,0),19999999)/100000) as bigint) bin, count(*) n from ends group by 1, 2")
def _q(spark, d):
    return legacy.coverage_bins(own._disc(spark, d))


@_query("v1_noise_floor", "select count(*) bin_pairs, max(m) + 3 * greatest(median(abs(n - m)), 1) noise_floor from (select n, median(n) over () m from (select count(*) n from canon group by ca, cb, floor(pos_a/100000), floor(pos_b/100000)))")
def _q(spark, d):
    return legacy.noise_floor(legacy.pair_bins(evidence.canonical(own._disc(spark, d))))


_HELD = """select c.*, p.support partner_support, exists (select 1 from sides s join merged m on s.chrom = m.chrom and s.pos between m.start_pos - 1000000 and m.end_pos + 1000000 where s.event_id = c.event_id and m.track = 'centromere') cen,
 least(c.median_a, c.median_b) <= 500000 or greatest(c.median_a, c.median_b) >= 19500000 tel, exists (select 1 from stabs s where s.event_id = c.event_id and track = 'encode_blacklist') bla,
 exists (select 1 from stabs s where s.event_id = c.event_id and track = 'segdup') seg, c.support > 100 hig, coalesce(greatest(c.support, p.support) > 3 * least(c.support, p.support) and p.support is not null, false) une
 from clusters c left join recip r on r.event_id = c.event_id left join clusters p on p.event_id = r.partner"""


def _flagged(spark, d):
    masks = views.masks(spark, d)
    return legacy.flagged(stored(own._clusters(spark, d)), masks, parts=evidence.parts(masks))


@_query("v1_soft_flags", f"select event_id, concat_ws(',', case when cen then 'centromere_proximity' end, case when tel then 'telomere_proximity' end, case when bla then 'blacklist' end, case when seg then 'segdup' end, case when hig then 'high_local_coverage' end, case when une then 'uneven_support' end) flags from ({_HELD})")
def _q(spark, d):
    return _flagged(spark, d).select("event_id", F.concat_ws(",", "flags").alias("flags"))


@_query("v1_tier", f"""select event_id, round(score, 6) score, case when support < 2 or coalesce(median_mapq, 0) < 10 then 'filtered' when sr >= 3 and pr >= 5 and median_mapq >= 30 and starts_a >= 2 and starts_b >= 2 and not bla then 'confirmed'
 when sr > 0 and pr > 0 and support >= 8 and median_mapq >= 25 and not bla then 'validated' when support >= 5 and median_mapq >= 20 and score > 15 then 'likely' else 'candidate' end tier from
 (select *, 5.0*sr + 3.0*pr + least(2*greatest(starts_a-1,0)+2*greatest(starts_b-1,0),20) + 10*(least(greatest(median_mapq,20),60)-20)/40.0
  - 30*cen::int - 30*tel::int - 50*bla::int - 20*seg::int - 10*hig::int - 5*une::int score from ({_HELD}))""")
def _q(spark, d):
    c = _flagged(spark, d)
    return c.select("event_id", F.round(legacy.penalised(), 6).alias("score"), legacy.tier().alias("tier"))


@_query("clip_pileups")
def _q(spark, d):
    return clips.pileups(_clips(spark, d))


@_query("bnd_parse", """select s_suppkey, 'chr' || (s_suppkey % 6 + 1) chrom, 1000 + s_suppkey pos from supplier where s_suppkey % 3 < 2""")
def _q(spark, d):
    alt = "case s_suppkey % 3 when 0 then format_string('N[chr%d:%d[', s_suppkey % 6 + 1, 1000 + s_suppkey) when 1 then format_string(']chr%d:%d]N', s_suppkey % 6 + 1, 1000 + s_suppkey) else '<DEL>' end"
    t = spark.read.parquet(f"{d}/supplier.parquet").select("s_suppkey", scalar.bnd_mate(F.expr(alt)).alias("m"))
    return t.where("m is not null").select("s_suppkey", "m.chrom", "m.pos")


@_query("reciprocal_dedup")
def _q(spark, d):
    return resolve.absorbed(own.tiered(spark, d).where("tier <> 'filtered'"))


@_query("truth_match")
def _q(spark, d):
    return resolve.matched(_truth(spark, d), own._clusters(spark, d))


@_query("eval_metrics")
def _q(spark, d):
    calls = own._clusters(spark, d)
    return resolve.metrics(resolve.matched(_truth(spark, d), calls), calls)


@_query("near_miss", own._tiered_sql("""select event_id, support, 'beyond_top_n' reason from scored where tier = 'candidate' and event_id not in (select event_id from fill)
 union all select * from (select event_id, support, coalesce(excluded, rejected) reason from scored where tier = 'filtered' and support >= 3 order by support desc, event_id limit 20)"""))
def _q(spark, d):
    """The candidates that ``top_n`` has no room for, and the 20 best filtered clusters."""
    rows = stored(own.tiered(spark, d).select("event_id", "tier", "score", "support", F.coalesce("excluded", "rejected").alias("reason")))
    _, left = tiers.split(rows)
    left = rows.join(left.select("event_id"), "event_id", "left_semi").select("event_id", "support", F.lit("beyond_top_n").alias("reason"))
    return left.unionByName(rows.where("tier = 'filtered' and support >= 3").orderBy(F.desc("support"), "event_id").limit(20).select("event_id", "support", "reason"))


@_query("ring_last_k", "select event_type, event_id, k from (select event_type, event_id, row_number() over (partition by event_type order by event_id desc) k from events) where k <= 60")
def _q(spark, d):
    place = F.row_number().over(Window.partitionBy("event_type").orderBy(F.desc("event_id"))).cast("long")
    return spark.read.parquet(f"{d}/events.parquet").select("event_type", "event_id", place.alias("k")).where("k <= 60")


@_query("stream_topbins", "select * from (select strftime(time_bucket(interval '1 hour', ts), '%Y-%m-%d %H:%M:%S') as start, event_type, count(*) n from events group by 1, 2 order by n desc, 1, 2 limit 12) where n >= 2")
def _q(spark, d):
    from ..streaming import live

    counts = live.drained(live.counts(live.events(spark, d), "1 hour"))
    return counts.select("start", "event_type", "n").orderBy(F.desc("n"), "start", "event_type").limit(12).where("n >= 2")


_RECORDS = """select l_orderkey, l_linenumber, cast((l_orderkey * 37 + l_linenumber * 101) % 4096 as int) as flag, cast(l_quantity as int) + 10 as mapq,
 case when l_suppkey % 9 = 8 then 'chrUn' else concat('chr', cast(l_suppkey % 6 + 1 as STR)) end as chrom,
 case when l_partkey % 11 = 10 then 'chrUn' else concat('chr', cast(l_partkey % 6 + 1 as STR)) end as mate_chrom,
 cast(l_partkey % 900 as int) - 200 as tlen, cast(l_quantity as int) + 30 as aligned, cast(l_suppkey % 60 as int) as clipped,
 cast(l_partkey % 60 as int) as sa_mapq, cast(l_suppkey % 45 as int) + 10 as sa_aligned from lineitem"""


def _records(spark: SparkSession, d: str) -> DataFrame:
    rows = views.view(spark, d, "lineitem", _RECORDS)
    cigar = F.concat(F.col("aligned").cast("string"), F.lit("M"), F.when(F.col("clipped") > 0, F.format_string("%dS", "clipped")).otherwise(""))
    return rows.withColumns({"cigar": cigar, "sa": F.when(F.col("l_linenumber") <= 4, F.format_string("%s,1000,+,%dM,%d,0;", "mate_chrom", "sa_aligned", "sa_mapq"))})


@_query("read_kinds", f"""select l_orderkey, l_linenumber, (flag & 3840) = 0 and mapq >= 20 and (flag & 8) = 0 and mate_chrom <> chrom and mate_chrom <> 'chrUn' discordant,
 mapq >= 20 and (flag & 3328) = 0 and l_linenumber <= 4 split, clipped >= 20 clip from ({_RECORDS}) where (flag & 4) = 0 and chrom <> 'chrUn'""")
def _q(spark, d):
    rows = reads.primary(_records(spark, d))
    return rows.select("l_orderkey", "l_linenumber", reads.is_discordant().alias("discordant"), reads.is_split().alias("split"), reads.is_clipped().alias("clip"))


@_query("split_partners", f"""select l_orderkey, l_linenumber, case when mate_chrom = 'chrUn' then 'non_primary_chrom' when sa_mapq < 20 then 'sa_mapq_low(' || sa_mapq || ')'
 when aligned < least_ or sa_aligned < least_ then 'aligned_too_short(pri=' || aligned || ',sa=' || sa_aligned || ',min=' || least_ || ')' else 'accepted' end reason
 from (select *, greatest({reads.DEFAULTS.min_split_aligned}, cast(floor((aligned + clipped) * cast(0.3 as double)) as bigint)) least_ from ({_RECORDS}))
 where (flag & 4) = 0 and chrom <> 'chrUn' and mapq >= 20 and (flag & 3328) = 0 and l_linenumber <= 4 and mate_chrom <> chrom""")
def _q(spark, d):
    rows = reads.partners(reads.primary(_records(spark, d)).where(reads.is_split()))
    return rows.select("l_orderkey", "l_linenumber", F.coalesce("reason", F.lit("accepted")).alias("reason"))


@_query("insert_sizes", f"select l_orderkey, l_linenumber, tlen from ({_RECORDS}) where (flag & 2) = 2 and (flag & 3852) = 0 and chrom = mate_chrom and tlen > 0")
def _q(spark, d):
    return reads.insert_sizes(_records(spark, d)).select("l_orderkey", "l_linenumber", "tlen")


@_query("anomalous_contigs", "select * from (select chrom, count(*) reads from reads group by 1) join (select chrom, count(*) discordant from disc group by 1) using (chrom) where discordant > 0.05 * reads")
def _q(spark, d):
    return reads.anomalous_contigs(views.reads(spark, d), own._disc(spark, d))


@_query("name_numbers", "select read_name_hash, ('0x' || read_name_hash)::bigint number from reads")
def _q(spark, d):
    return views.reads(spark, d).select("read_name_hash", scalar.name_number(F.col("read_name_hash")).alias("number"))


@_query("region_reads", "select read_name_hash, chrom, pos from reads where (chrom = 'chr1' and pos between 2000000 and 6000000) or (chrom = 'chr2' and pos between 13000000 and 17000000)")
def _q(spark, d):
    return reads.in_regions(views.reads(spark, d), ["chr1:4000000", "2:15000000", "nowhere"]).select("read_name_hash", "chrom", "pos")
