"""Evidence, masks and external calls as views over the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

READS = """
select substr(md5(concat(cast(l_orderkey as STR),'_',cast(l_linenumber as STR))),1,12) as read_name_hash,
 concat('chr',cast(l_suppkey % 6 + 1 as STR)) as chrom, concat('chr',cast(l_partkey % 6 + 1 as STR)) as mate_chrom,
 case when l_orderkey % 3 = 0 then 1000000 + least(l_orderkey % 12, l_orderkey % 7) * 1500000 + l_orderkey % 211
      else (l_partkey * 7919 + l_orderkey * 104729) % 20000000 end as pos,
 case when l_orderkey % 3 = 0 then 2000000 + least(l_orderkey % 12, l_orderkey % 7) * 1500000 + l_partkey % 197
      else (l_suppkey * 15485863 + l_orderkey * 7919) % 20000000 end as mate_pos,
 cast(l_quantity as int) + 10 as mapq, case when l_linenumber >= 6 then 'split' else 'discordant' end as evidence_type,
 l_linestatus = 'O' as is_reverse, l_returnflag = 'R' as mate_is_reverse,
 case when l_discount >= 0.09 then 1024 else 0 end as flag from lineitem"""
#: Raw records: names with and without chr, several CIGAR operations, up to two SA entries, reads that repeat; and the numbers they are made of.
RAW = """
select *, concat(case when lc > 0 then concat(cast(lc as STR), 'S') else '' end, cast(aligned - 8 as STR), 'M3I8M2D', case when rc > 0 then concat(cast(rc as STR), 'S') else '' end) as cigar,
 case when line <= 2 then concat(name1, ',', cast(sa_pos as STR), ',', case when l_suppkey % 2 = 0 then '-' else '+' end, ',', cast(sa_aligned as STR), 'M5D,', cast(sa_mapq as STR), ',0;', name2, ',', cast(sa_pos + 7 as STR), ',+,10S40M,60,1;bad,x,y;')
      when line <= 4 then concat(name1, ',', cast(sa_pos as STR), ',', case when l_suppkey % 2 = 0 then '-' else '+' end, ',', cast(sa_aligned as STR), 'M5D,', cast(sa_mapq as STR), ',0;') end as sa,
 substr(repeat('ACGTTGCA', 40), 1, cast(lc + aligned + 3 + rc as int)) as seq from (
select l_suppkey, l_linenumber as line, concat('r', cast(l_orderkey as STR), '_', cast(l_linenumber % 3 as STR)) as qname,
 cast((case when l_linestatus = 'O' then 16 else 0 end) + (case when l_returnflag = 'R' then 32 else 0 end) + (case when l_discount >= 0.09 then 1024 else 0 end)
  + (case when l_partkey % 13 = 0 then 8 else 0 end) + (case when l_partkey % 17 = 0 then 4 else 0 end) + (case when l_suppkey % 19 = 0 then 2048 else 0 end) as int) as flag,
 case when l_suppkey % 31 = 30 then 'GL1' when l_linenumber % 2 = 0 then cast(l_suppkey % 6 + 1 as STR) else concat('chr', cast(l_suppkey % 6 + 1 as STR)) end as chrom,
 case when l_partkey % 29 = 28 then 'chrUn' when l_partkey % 37 = 36 then null when l_linenumber % 3 = 0 then cast(l_partkey % 6 + 1 as STR) else concat('chr', cast(l_partkey % 6 + 1 as STR)) end as mate_chrom,
 case when l_orderkey % 3 = 0 then 1000000 + least(l_orderkey % 12, l_orderkey % 7) * 1500000 + l_orderkey % 211 else (l_partkey * 7919 + l_orderkey * 104729) % 20000000 end as pos,
 case when l_orderkey % 3 = 0 then 2000000 + least(l_orderkey % 12, l_orderkey % 7) * 1500000 + l_partkey % 197 else (l_suppkey * 15485863 + l_orderkey * 7919) % 20000000 end as mate_pos,
 cast(l_quantity as int) + 10 as mapq, cast(l_partkey % 900 as bigint) - 200 as tlen, cast(l_quantity as int) + 30 as aligned,
 case when l_linenumber % 2 = 1 then cast(l_suppkey % 60 as int) else 0 end as lc, cast(l_partkey % 45 as int) as rc,
 case when l_partkey % 23 = 22 then 'GL2' else cast(l_partkey % 6 + 1 as STR) end as name1, concat('chr', cast(l_suppkey % 5 + 1 as STR)) as name2,
 case when l_orderkey % 3 = 0 then 2000000 + least(l_orderkey % 12, l_orderkey % 7) * 1500000 + l_partkey % 193 else (l_suppkey * 15485863 + l_orderkey * 7901) % 20000000 end as sa_pos,
 cast(l_partkey % 60 as int) as sa_mapq, cast(l_suppkey % 45 as int) + 10 as sa_aligned from lineitem) raw"""
MASKS = """
select case p_partkey % 4 when 0 then 'centromere' when 1 then 'encode_blacklist' when 2 then 'segdup' else 'simple_repeat' end as track,
 concat('chr',cast(p_partkey % 6 + 1 as STR)) as chrom, (p_partkey * 7919) % 12000000 as start_pos,
 (p_partkey * 7919) % 12000000 + 200 + p_size * 100 as end_pos, cast(90.0 + p_size % 10 as double) as pct_identity from part"""
BNDS = """
select 'caller1' as caller, concat('chr',cast(s_suppkey % 6 + 1 as STR)) as chrom_a,
 concat('chr',cast(cast(floor(s_suppkey / 6) as bigint) % 6 + 1 as STR)) as chrom_b,
 1000000 + (s_suppkey % 7) * 1500000 + s_nationkey as pos_a, 2000000 + (s_suppkey % 7) * 1500000 + s_nationkey as pos_b from supplier"""


def view(spark: SparkSession, sf_dir: str, name: str, sql: str) -> DataFrame:
    """``sql`` over one Parquet table; columns it doesn't name aren't read."""
    return spark.sql(sql.replace("STR", "string").replace(f"from {name}", "from {t}"), t=spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "lineitem", READS)


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "lineitem", RAW)


def masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "part", MASKS)


def bnds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "supplier", BNDS)
