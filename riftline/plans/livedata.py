"""Registered queries over streams with state, and the SQL each is checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import views
from ..streaming import live, stateful
from . import rawdata  # noqa: F401
from .queries import ORACLES, QUERIES, WITH, _duck, _query  # noqa: F401

_KINDS = (
    "scan.progress", "pair.density", "evidence.highlight", "chrom.bin_update", "chrom.progress", "pair.density", "evidence.highlight", "chrom.bin_update", "scan.throughput",
    "pair.density", "provisional.top_bins", "scan.stage_changed", "validation.call_emitted", "scan.started", "error", "validation.completed", "clustering.scale",
)
#: The events table as what clients of four jobs are told.
LIVE = f"""select user_id % 4 as job, event_id as seq, case event_id % {len(_KINDS)} {" ".join(f"when {i} then '{k}'" for i, k in enumerate(_KINDS))} end as kind,
 concat('chr', cast(user_id % 6 + 1 as STR)) as chrom_a, event_id % 1000 as pos_a, concat('chr', cast((user_id + event_id) % 5 + 1 as STR)) as chrom_b, event_id % 777 as pos_b,
 event_id % 7 as count, cast(event_id % 101 as double) as pct, event_id % 5000 as reads, event_id % 90001 as bytes, event_id % 11 as discordant, event_id % 5 as split, event_id % 3 as clip,
 (event_id % 40) * 100000 as bin_start, event_type as evidence_type, concat('t', cast(event_id % 50 as STR)) as text from events"""


def _reads(spark: SparkSession, d: str) -> DataFrame:
    """A stream of the evidence view."""
    table = spark.read.parquet(f"{d}/lineitem.parquet")
    rows = spark.readStream.schema(table.schema).option("pathGlobFilter", "*.parquet").parquet(d if _is_file(spark, d) else f"{d}/lineitem.parquet")
    return spark.sql(views.READS.replace("STR", "string").replace("from lineitem", "from {t}"), t=rows)


def _is_file(spark: SparkSession, d: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{d}/lineitem.parquet")
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path).isFile()


def _events(spark: SparkSession, d: str) -> DataFrame:
    return live.events(spark, d)


def _told(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql(LIVE.replace("STR", "string").replace("from events", "from {t}"), t=_events(spark, d))


@_query("stream_changes", "select event_type, count(*) total, count(*) deltas from events group by 1")
def _q(spark, d):
    """The last total of each type, and the sum of all differences that were sent."""
    sent = live.gathered(stateful.changes(_events(spark, d).select("event_type", F.lit(1).cast("long").alias("n")), "event_type"), "update")
    return sent.groupBy("event_type").agg(F.max("total").alias("total"), F.sum("delta").alias("deltas"))


@_query("stream_throughput", """with w as (select time_bucket(interval '1 hour', ts) s, count(*) n from events group by 1), done as (select s, n from w where s + interval '1 hour' <= (select max(ts) from events) - interval '1 hour')
select strftime(s, '%Y-%m-%d %H:%M:%S') as start, n, round(n / 3600.0, 6) per_second, n - coalesce(lag(n) over (order by s), 0) delta from done""")
def _q(spark, d):
    """Events of each hour that the watermark has passed, a second's share, and the difference to the hour before."""
    from pyspark.sql import Window

    done = live.gathered(_events(spark, d).groupBy(F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("s"), "n"), "append")
    before = F.lag("n").over(Window.orderBy("s"))  # a row an hour
    return done.select(F.date_format("s", "yyyy-MM-dd HH:mm:ss").alias("start"), "n", F.round(F.col("n") / 3600.0, 6).alias("per_second"), (F.col("n") - F.coalesce(before, F.lit(0))).alias("delta"))


@_query("stream_capped", "select * from (select cast(epoch(time_bucket(interval '1 hour', ts)) / 3600 as bigint) as \"window\", cast(row_number() over (partition by time_bucket(interval '1 hour', ts) order by event_id) as int) turn, event_id seq, event_type kind from events) where turn <= 5")
def _q(spark, d):
    rows = _events(spark, d).select("ts", F.col("event_id").alias("seq"), F.col("event_type").alias("kind"))
    return live.gathered(stateful.capped(rows, 5, 3_600_000), "append").drop("batch")


@_query("stream_highlights")
def _q(spark, d):
    """The limited feed of each of sixteen channels, a flush an hour."""
    rows = _events(spark, d).select((F.col("user_id") % 16).alias("channel"), "ts", F.col("event_id").alias("seq"), F.element_at(F.array(*map(F.lit, stateful.PRIORITY)), (F.col("event_id") % 4 + 1).cast("int")).alias("kind"))
    return live.gathered(stateful.highlights(rows, "channel", 3_600_000), "append").drop("batch")


_LAST = "coalesce(arg_max({0}, seq) filter (kind in ({1})), {2})"
ORACLES["stream_client"] = _duck(f"""with told as ({LIVE}),
flat as (select job, coalesce(arg_max(case kind when 'scan.started' then 'streaming' else 'validated' end, seq) filter (kind in ('scan.started', 'validation.completed')), 'idle') mode,
  arg_max(case kind when 'scan.started' then 'extraction' when 'scan.stage_changed' then text when 'validation.completed' then 'completed' else 'failed' end, seq) filter (kind in ('scan.started', 'scan.stage_changed', 'validation.completed', 'error')) stage,
  arg_max(text, seq) filter (kind = 'error') error, arg_max(pct, seq) filter (kind = 'scan.progress') pct, count(*) filter (kind = 'validation.call_emitted') calls, arg_max(text, seq) filter (kind = 'provisional.top_bins') top_bins,
  count(*) filter (kind = 'evidence.highlight') highlights from told group by job),
thr as (select job, sum(reads) reads_shown from (select *, row_number() over (partition by job order by seq desc) k from told where kind = 'scan.throughput') where k <= 60 group by job),
wat as (select job, sum(pos_a) shown from (select *, row_number() over (partition by job order by seq desc) k from told where kind = 'evidence.highlight') where k <= 500 group by job),
born as (select job, chrom_a, chrom_b, min(seq) s from told where kind = 'pair.density' and count >= 2 group by all),
arc as (select b.job, b.chrom_a, b.chrom_b, arg_max(t.count, t.seq) filter (t.kind = 'pair.density') n, coalesce(arg_max(t.pos_a, t.seq) filter (t.kind = 'evidence.highlight'), 0) p from born b join told t on t.job = b.job and t.chrom_a = b.chrom_a and t.chrom_b = b.chrom_b and t.seq >= b.s group by all),
arcs as (select job, count(*) arcs, sum(n) arc_reads, sum(p) arc_places from arc group by job),
pairs as (select job, sum(n) density from (select job, least(chrom_a, chrom_b) a, greatest(chrom_a, chrom_b) b, arg_max(count, seq) n from told where kind = 'pair.density' group by all) group by job),
prog as (select job, chrom_a, min(seq) s, arg_max(pct, seq) pct, arg_max(reads, seq) reads from told where kind = 'chrom.progress' group by all),
bins as (select p.job, count(distinct (t.chrom_a, t.bin_start)) bins from prog p join told t on t.job = p.job and t.chrom_a = p.chrom_a and t.seq > p.s and t.kind = 'chrom.bin_update' group by 1),
chr as (select job, count(*) chroms, count(*) filter (pct >= 100) complete, sum(reads) chrom_reads from prog group by job)
select f.*, cast(reads_shown as bigint) reads_shown, cast(shown as bigint) shown, arcs, cast(arc_reads as bigint) arc_reads, cast(arc_places as bigint) arc_places, cast(density as bigint) density, bins, chroms, complete, cast(chrom_reads as bigint) chrom_reads
from flat f left join thr using (job) left join wat using (job) left join arcs using (job) left join pairs using (job) left join bins using (job) left join chr using (job)""")


@_query("stream_client")
def _q(spark, d):
    """The last view of each job, its lists as counts and sums."""
    view = live.gathered(stateful.client_view(_told(spark, d)), "update")
    last = view.groupBy("job").agg(F.max_by(F.struct(*[c for c in view.columns if c not in ("job", "batch")]), "batch").alias("v")).select("job", "v.*")
    total = lambda c: F.aggregate(F.transform(F.col(c), lambda x: x.cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
    return last.select(
        "job", "mode", "stage", "error", "pct", "calls", "top_bins", "highlights", total("throughput.reads").alias("reads_shown"), total("waterfall.pos_a").alias("shown"), F.size("arcs").cast("long").alias("arcs"),
        total("arcs.count").alias("arc_reads"), total("arcs.pos_a").alias("arc_places"), total("density.count").alias("density"), total("chroms.bins").alias("bins"), F.size("chroms").cast("long").alias("chroms"),
        F.size(F.filter("chroms", lambda c: c["status"] == "complete")).cast("long").alias("complete"), total("chroms.reads").alias("chrom_reads"),
    )


@_query("stream_pair_density", "select least(chrom, mate_chrom) || '-' || greatest(chrom, mate_chrom) pair, count(*) total, count(*) deltas from disc group by 1")
def _q(spark, d):
    """Reads of each pair of contigs, as a change feed of a stream of reads."""
    disc = _reads(spark, d).where("mapq >= 20 and chrom <> mate_chrom")
    pairs = disc.select(F.concat_ws("-", F.least("chrom", "mate_chrom"), F.greatest("chrom", "mate_chrom")).alias("pair"), F.lit(1).cast("long").alias("n"))
    return live.gathered(stateful.changes(pairs, "pair"), "update").groupBy("pair").agg(F.max("total").alias("total"), F.sum("delta").alias("deltas"))


@_query("stream_bins", "select chrom || ':' || cast(floor(pos / 1000000) as bigint) bin, count(*) total, count(*) deltas from disc group by 1")
def _q(spark, d):
    """Reads of each dirty bin of a megabase, as a change feed."""
    disc = _reads(spark, d).where("mapq >= 20 and chrom <> mate_chrom")
    bins = disc.select(F.concat_ws(":", "chrom", F.floor(F.col("pos") / 1_000_000).cast("string")).alias("bin"), F.lit(1).cast("long").alias("n"))
    return live.gathered(stateful.changes(bins, "bin"), "update").groupBy("bin").agg(F.max("total").alias("total"), F.sum("delta").alias("deltas"))
