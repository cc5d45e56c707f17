"""Registered queries from raw alignment records to clusters, and the SQL each is checked against."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar, udtf
from ..operators import clips, evidence, legacy, quantiles, reads
from ..settings import DEFAULTS
from ..sources import views
from ..storage import stored
from . import queries as own
from . import secondary
from .queries import ORACLES, QUERIES, _duck, _query  # noqa: F401

#: Each kind of evidence on its own, then the first of each read, contig and mate contig; then the spine as in ``queries.WITH``.
RAW_WITH = _duck(f"""with raw as ({views.RAW}), named as (select *, case when chrom = 'GL1' then null else 'chr' || replace(chrom, 'chr', '') end c, 'chr' || replace(mate_chrom, 'chr', '') m,
 substr(md5(qname), 1, 12) h, greatest({DEFAULTS.min_split_aligned}, cast(floor((lc + aligned + 3 + rc) * cast(0.3 as double)) as bigint)) least_ from raw),
good as (select * from named where (flag & 4) = 0 and c is not null),
entries as (select *, 'chr' || name1 s_chrom, sa_pos s_pos, sa_mapq s_mapq, l_suppkey % 2 = 0 s_rev, sa_aligned + 5 far, 0 entry from good where line <= 4
 union all select *, name2, sa_pos + 7, 60, false, 40, 1 from good where line <= 2),
kinds as (select h, c, pos, mapq, flag, 'discordant' kind, m mate, mate_pos, cast(null as int) mate_mapq, (flag & 32) <> 0 mate_rev, abs(tlen) size, cast(null as STR) side, cast(null as int) len, cast(null as STR) seq, cast(null as STR) reason, 0 entry
   from good where (flag & 3840) = 0 and mapq >= 20 and (flag & 8) = 0 and m <> c and m <> 'chrUn'
 union all select h, c, pos, mapq, flag, 'split', s_chrom, s_pos, s_mapq, s_rev, null, null, null, null, case when s_chrom = 'chrGL2' then 'non_primary_chrom' when s_mapq < 20 then 'sa_mapq_low(' || s_mapq || ')'
   when aligned + 3 < least_ or far < least_ then 'aligned_too_short(pri=' || (aligned + 3) || ',sa=' || far || ',min=' || least_ || ')' end, entry
   from entries where mapq >= 20 and (flag & 3328) = 0 and s_chrom <> c
 union all select h, c, pos, mapq, flag, 'clip', null, null, null, null, null, case when lc >= rc then 'left' else 'right' end, greatest(lc, rc),
   case when lc >= rc then seq[1:lc] else seq[length(seq) - rc + 1:] end, null, 0 from good where greatest(lc, rc) >= 20),
judged as (select * exclude (reason, entry), coalesce(reason, case when kind <> 'clip' and row_number() over (partition by h, c, mate, kind order by reason is not null, pos, entry, mate_pos, mapq, flag, mate_mapq) > 1 then 'dedup' end) reason from kinds),
canon as (select h, mapq, kind, flag, least(c, mate) ca, greatest(c, mate) cb, case when c <= mate then pos else mate_pos end pos_a, case when c <= mate then mate_pos else pos end pos_b,
  case when c <= mate then case when (flag & 16) <> 0 then '-' else '+' end || case when mate_rev then '-' else '+' end else case when mate_rev then '-' else '+' end || case when (flag & 16) <> 0 then '-' else '+' end end orient
  from judged where reason is null and kind <> 'clip')""")


def _raw_sql(body: str) -> str:
    return f"{RAW_WITH} {body}"


@_query("evidence_log")
def _q(spark, d):
    """What became of every row of evidence: counts by kind and reason."""
    return reads.judged(views.raw(spark, d), parts=own._parts(spark, d)).groupBy("evidence_type", F.coalesce("reason", F.lit("accepted")).alias("reason")).agg(F.count("*").alias("n"))


ORACLES["evidence_log"] = _raw_sql("select kind evidence_type, coalesce(reason, 'accepted') reason, count(*) n from judged group by 1, 2")


@_query("evidence_rows")
def _q(spark, d):
    rows = reads.evidence_rows(views.raw(spark, d), parts=own._parts(spark, d)).drop("is_reverse")
    return rows.fillna({"mate_pos": -1, "mate_mapq": -1, "insert_size": -1, "clip_len": 0, "mate_is_reverse": False})


ORACLES["evidence_rows"] = _raw_sql("""select h read_name_hash, c chrom, pos, mapq, flag, kind evidence_type, mate mate_chrom, coalesce(mate_pos, -1) mate_pos, coalesce(mate_mapq, -1) mate_mapq, coalesce(mate_rev, false) mate_is_reverse, cast(coalesce(size, -1) as bigint) insert_size,
 side clip_side, cast(coalesce(len, 0) as int) clip_len, seq clip_seq from judged where reason is null""")


@_query("clip_info")
def _q(spark, d):
    """The longer terminal clip of every record that has one."""
    return views.raw(spark, d).withColumn("clip", scalar.clip_side_length(F.col("cigar"))).where("clip is not null").select("qname", "line", "clip.side", "clip.len")


ORACLES["clip_info"] = _raw_sql("select qname, line, case when lc >= rc then 'left' else 'right' end side, cast(greatest(lc, rc) as int) len from raw where lc > 0 or rc > 0")


def raw_clusters(spark, d):
    """Clusters of the evidence that raw records give."""
    parts = own._parts(spark, d)
    rows = reads.evidence_rows(views.raw(spark, d), kinds=("discordant", "split"), parts=parts)
    return evidence.clusters(evidence.clustered(evidence.cascade(evidence.canonical(rows), parts=parts), parts=parts), parts=parts)


@_query("raw_clusters")
def _q(spark, d):
    c = raw_clusters(spark, d)
    return c.select("ca", "cb", "orient", "support", "sr", "pr", "median_a", "median_b", "starts_a", "starts_b", "median_mapq", F.round("dup_fraction", 9).alias("dup_fraction"))


_SCALES = "".join(f", s{i} as (select * from (select {'*' if i == 1 else '* exclude (k)'}, count(*) over (partition by ca, cb, floor(pos_a/{w}), floor(pos_b/{w})) k from {'canon' if i == 1 else f's{i - 1}'}) where k >= 2)" for i, w in enumerate(DEFAULTS.scales, 1))
ORACLES["raw_clusters"] = _raw_sql(f"""{_SCALES},
ia as (select *, max(pos_a) over (partition by ca, cb, orient order by pos_a range between unbounded preceding and 1 preceding) b from s4),
fa as (select *, max(case when b is null or pos_a - b > 500 then pos_a end) over (partition by ca, cb, orient order by pos_a range between unbounded preceding and current row) isl_a from ia),
ib as (select * exclude (b), max(pos_b) over (partition by ca, cb, orient, isl_a order by pos_b range between unbounded preceding and 1 preceding) b from fa),
fb as (select *, max(case when b is null or pos_b - b > 500 then pos_b end) over (partition by ca, cb, orient, isl_a order by pos_b range between unbounded preceding and current row) isl_b from ib)
select ca, cb, orient, count(*) support, count(*) filter (kind = 'split') sr, count(*) filter (kind = 'discordant') pr, cast(trunc(median(pos_a)) as bigint) median_a, cast(trunc(median(pos_b)) as bigint) median_b,
 count(distinct pos_a) starts_a, count(distinct pos_b) starts_b, median(mapq) median_mapq, round(avg(case when (flag & 1024) <> 0 then 1.0 else 0 end), 9) dup_fraction from fb group by ca, cb, orient, isl_a, isl_b having count(*) >= 3""")


@_query("v1_poisson_p", """, cov as (select chrom, floor(least(greatest(pos,0),19999999)/100000) bin, count(*) n from ends group by 1, 2), pb as (select ca, cb, floor(pos_a/100000) ba, floor(pos_b/100000) bb, count(*) n from canon group by all),
 nf as (select max(m) + 3 * greatest(median(abs(n - m)), 1) floor_ from (select n, median(n) over () m from pb)), rt as (select (select count(*) from disc) / cast(b * b as double) rate from (select count(*) b from (select distinct chrom, floor(pos/100000) from ends))),
 e as (select c.event_id, support k, coalesce(a.n, 0) * coalesce(b.n, 0) * round(rate, 9) / (select count(*) from cov) expected, coalesce(p.n, 0) noise, floor_ from clusters c cross join nf cross join rt left join cov a on a.chrom = ca and a.bin = floor(median_a/100000)
  left join cov b on b.chrom = cb and b.bin = floor(median_b/100000) left join pb p on p.ca = c.ca and p.cb = c.cb and p.ba = floor(median_a/100000) and p.bb = floor(median_b/100000)),
 t as (select event_id, sum(exp(i * ln(expected) - expected - lgamma(i + 1))) tail from (select *, k + j i from e, (select unnest(range(3000)) j) where expected > 0) group by 1),
 ps as (select event_id, expected, noise > 0 and noise >= floor_ and k <= 2 * noise suppressed, case when noise > 0 and noise >= floor_ and k <= 2 * noise then 1.0 when expected <= 0 then case when k > 0 then 0.0 else 1.0 end else least(tail, 1) end p from e left join t using (event_id))
 select event_id, round(expected, 9) expected, suppressed, round(p, 9) p, round(least(min(p * n / r) over (order by p desc range unbounded preceding), 1), 9) background_p from (select *, count(*) over () n, count(*) over (order by p range unbounded preceding) r from ps)""")
def _q(spark, d):
    disc = own._disc(spark, d)
    coverage, pairs = stored(legacy.coverage_bins(disc)), stored(legacy.pair_bins(evidence.canonical(disc)))
    rate, noise = legacy.rate(views.reads(spark, d), disc).first().rate, legacy.noise_floor(pairs).first().noise_floor
    out = legacy.significance(own._clusters(spark, d), coverage, pairs, rate, noise or 0.0)
    return out.select("event_id", F.round("expected", 9).alias("expected"), "suppressed", F.round("p", 9).alias("p"), F.round("background_p", 9).alias("background_p"))


#: Pileups of ``cl`` (chrom, clip_side, pos): each island of near positions is walked from its first.
PILES = """cnt as (select chrom, clip_side, pos, count(*) n from cl group by all),
isl as (select *, sum(case when g is null or g > 10 then 1 else 0 end) over (partition by chrom, clip_side order by pos) island from (select *, pos - lag(pos) over (partition by chrom, clip_side order by pos) g from cnt)),
ord as (select *, row_number() over (partition by chrom, clip_side, island order by pos) k from isl),
walk as (select chrom, clip_side, island, k, pos, n, pos opened from ord where k = 1 union all select o.chrom, o.clip_side, o.island, o.k, o.pos, o.n, case when o.pos - w.opened <= 10 then w.opened else o.pos end
 from walk w join ord o on o.chrom = w.chrom and o.clip_side = w.clip_side and o.island = w.island and o.k = w.k + 1),
summed as (select *, sum(n) over (partition by chrom, clip_side, opened order by pos) upto, sum(n) over (partition by chrom, clip_side, opened) depth from walk),
pile as (select chrom, clip_side, min(pos) filter (upto > floor(depth / 2)) pos, cast(max(depth) as bigint) depth from summed group by chrom, clip_side, opened having max(depth) >= 4)"""
#: Where the sequences of a pileup map to, as if they had been realigned: two records a pileup.
MAPPED = "concat('chr', cast((pos + j) % 6 + 1 as STR)) as to_chrom, pos + 1000000 + j as to_pos, cast(pos % 40 as int) as to_mapq, case when pos % 11 = 0 then 4 else 16 end as to_flag, pos * 10 + j as line"
_RESOLVED = f""", cl as (select c chrom, side clip_side, pos, seq from judged where kind = 'clip'), {PILES},
mapped as (select chrom from_chrom, pos from_pos, {MAPPED} from pile, (select unnest([0, 1]) j)),
found as (select from_chrom chrom, from_pos pos, arg_max(to_chrom, line) partner_chrom, arg_max(to_pos, line) partner_pos from mapped where to_flag & 4 = 0 and to_mapq >= 10 and to_chrom <> from_chrom group by 1, 2),
resolved as (select p.*, partner_chrom, partner_pos from pile p left join found using (chrom, pos))"""


def _recursive(body: str) -> str:
    return _duck(_raw_sql(body).replace("with raw as", "with recursive raw as", 1))


def _resolved(spark, d):
    found = stored(clips.pileups(_clip_rows(spark, d)))
    rows = found.withColumn("j", F.explode(F.array(F.lit(0), F.lit(1)))).selectExpr("chrom as from_chrom", "pos as from_pos", "j", *[x.strip() for x in _split(MAPPED.replace("STR", "string"))])
    aligned = rows.select("line", F.concat_ws("_", "from_chrom", "from_pos", F.lit("0"), "j").alias("qname"), F.col("to_flag").alias("flag"), F.col("to_chrom").alias("chrom"), F.col("to_pos").alias("pos"), F.col("to_mapq").alias("mapq"))
    return clips.resolved(found, aligned)


def _split(columns: str) -> list[str]:
    """The columns of a select list; commas within parentheses don't part them."""
    out, depth = [""], 0
    for c in columns:
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return out


def _clip_rows(spark, d):
    return reads.evidence_rows(views.raw(spark, d), kinds=("clip",)).select("chrom", "clip_side", "pos", "clip_seq")


ORACLES["clip_pileups"] = _duck(f"with recursive cl as ({secondary.CLIPS}), {PILES} select * from pile")


@_query("clip_sequences")
def _q(spark, d):
    rows = stored(_clip_rows(spark, d))
    return clips.sequences(rows, clips.pileups(rows)).select("chrom", "clip_side", "pos", F.size("seqs").cast("long").alias("n"), F.array_join("seqs", ",").alias("seqs"))


ORACLES["clip_sequences"] = _recursive(f""", cl as (select c chrom, side clip_side, pos, seq from judged where kind = 'clip'), {PILES},
near as (select *, row_number() over (partition by chrom, clip_side, pos order by abs(pos - pile), pile) k from (select p.chrom, p.clip_side, p.pos pile, unnest(range(p.pos - 10, p.pos + 11)) pos from pile p)),
own as (select c.*, pile, row_number() over (partition by c.chrom, c.clip_side, pile order by c.pos, c.seq) r from cl c join near n on n.k = 1 and n.chrom = c.chrom and n.clip_side = c.clip_side and n.pos = c.pos where c.seq is not null)
select chrom, clip_side, pile pos, count(*) n, string_agg(seq, ',' order by r) seqs from own where r <= 10 group by 1, 2, 3""")


@_query("clip_clusters")
def _q(spark, d):
    return clips.clip_clusters(_resolved(spark, d))


ORACLES["clip_clusters"] = _recursive(f"""{_RESOLVED}, cc as (select least(chrom, partner_chrom) ca, greatest(chrom, partner_chrom) cb, pos, chrom, clip_side, depth, case when chrom <= partner_chrom then pos else partner_pos end pos_a, case when chrom <= partner_chrom then partner_pos else pos end pos_b from resolved where partner_chrom is not null),
 r as (select *, max(pos_a) over (partition by ca, cb order by pos, chrom, clip_side, pos_a, pos_b rows between unbounded preceding and 1 preceding) reached from cc),
 g as (select *, sum(case when reached is null or pos_a - reached > 2 then 1 else 0 end) over (partition by ca, cb order by pos, chrom, clip_side, pos_a, pos_b rows unbounded preceding) gr from r)
 select ca, cb, '++' orient, count(*) pileups, cast(sum(depth) as bigint) clips, cast(trunc(median(pos_a)) as bigint) median_a, cast(trunc(median(pos_b)) as bigint) median_b from g group by ca, cb, gr""")


@_query("clip_band_join")
def _q(spark, d):
    """Clusters of raw evidence with the clips near both sides, and the intervals that these leave."""
    out = clips.with_clips(stored(raw_clusters(spark, d)), _resolved(spark, d))
    return out.select("ca", "cb", "orient", "median_a", "median_b", "clips", "ci_lo_a", "ci_hi_a", "ci_lo_b", "ci_hi_b")


_RAW_CLUSTERS = ORACLES["raw_clusters"].removeprefix(RAW_WITH)
_cut = _RAW_CLUSTERS.index("select ca, cb, orient, count(*) support")
ORACLES["clip_band_join"] = _recursive(f"""{_RAW_CLUSTERS[:_cut].strip()}, rc as (select *, row_number() over () id from (select ca, cb, orient, cast(trunc(median(pos_a)) as bigint) median_a, cast(trunc(median(pos_b)) as bigint) median_b, min(pos_a) lo_a, max(pos_a) hi_a, min(pos_b) lo_b, max(pos_b) hi_b
 from fb group by ca, cb, orient, isl_a, isl_b having count(*) >= 3)){_RESOLVED},
 n as (select id, cast(sum(depth) as bigint) clips from rc join resolved r on r.chrom = ca and r.partner_chrom = cb and abs(r.pos - median_a) < 1000 and abs(r.partner_pos - median_b) < 1000 group by 1)
 select ca, cb, orient, median_a, median_b, coalesce(clips, 0) clips, case when clips > 0 then median_a - 5 else lo_a end ci_lo_a, case when clips > 0 then median_a + 5 else hi_a end ci_hi_a,
  case when clips > 0 then median_b - 5 else lo_b end ci_lo_b, case when clips > 0 then median_b + 5 else hi_b end ci_hi_b from rc left join n using (id)""")


@_query("sa_udtf")
def _q(spark, d):
    """Split entries of raw records by the table function, in SQL."""
    udtf.register(spark)
    return spark.sql("select qname, line, e.* from {t}, lateral sa_entries(sa) e", t=views.raw(spark, d))


ORACLES["sa_udtf"] = _raw_sql("""select qname, line, name1 chrom, sa_pos pos, case when l_suppkey % 2 = 0 then '-' else '+' end strand, sa_aligned || 'M5D' cigar, sa_mapq mapq, 0 nm from raw where line <= 4
 union all select qname, line, name2, sa_pos + 7, '+', '10S40M', 60, 1 from raw where line <= 2""")


@_query("top_share_threshold", "select n threshold from (select n, row_number() over (order by n desc) - 1 k, count(*) over () total from (select count(*) n from canon group by ca, cb, floor(pos_a/100000), floor(pos_b/100000))) where k = least(cast(floor(total * 0.01) as bigint), total - 1)")
def _q(spark, d):
    """The count that one pair of bins in a hundred lies above."""
    pairs = legacy.pair_bins(evidence.canonical(own._disc(spark, d)))
    return spark.createDataFrame([(quantiles.top_share_threshold(pairs, "n"),)], "threshold long")


@_query("insert_quantiles", "select quantile_cont(v, 0.25) q25, quantile_cont(v, 0.5) q50, quantile_cont(v, 0.75) q75, quantile_cont(v, 0.99) q99 from (select cast(abs(mate_pos - pos) as double) v from reads where chrom = mate_chrom)")
def _q(spark, d):
    v = views.reads(spark, d).where("chrom = mate_chrom").select(F.abs(F.col("mate_pos") - F.col("pos")).alias("v"))
    return spark.createDataFrame([tuple(quantiles.quantiles(v, "v", [0.25, 0.5, 0.75, 0.99]))], "q25 double, q50 double, q75 double, q99 double")


@_query("orientation_coherence", """select ca, cb, orient, isl_a, isl_b, orientations, orientations <= 2 coherent from (select ca, cb, orient, isl_a, isl_b, min((any_a, any_b)) plc from wi group by all having count(*) >= 3)
 join (select ca, cb, any_a, any_b, count(distinct orient) orientations from wi group by all) p using (ca, cb) where plc = (p.any_a, p.any_b)""")
def _q(spark, d):
    rows = own._survivors(spark, d)
    return evidence.coherent(rows, own._clusters(spark, d).select(*evidence.CLUSTER), parts=own._parts(spark, d)).select(*evidence.CLUSTER, "orientations", "coherent")


_ANY = """, xa as (select *, max(pos_a) over (partition by ca, cb order by pos_a range between unbounded preceding and 1 preceding) xb from fb),
xfa as (select *, max(case when xb is null or pos_a - xb > 500 then pos_a end) over (partition by ca, cb order by pos_a range between unbounded preceding and current row) any_a from xa),
xc as (select * exclude (xb), max(pos_b) over (partition by ca, cb, any_a order by pos_b range between unbounded preceding and 1 preceding) xb from xfa),
wi as (select *, max(case when xb is null or pos_b - xb > 500 then pos_b end) over (partition by ca, cb, any_a order by pos_b range between unbounded preceding and current row) any_b from xc) """
ORACLES["orientation_coherence"] = ORACLES["orientation_coherence"].replace("select ca, cb, orient, isl_a, isl_b, orientations,", _ANY + "select ca, cb, orient, isl_a, isl_b, orientations,", 1)
