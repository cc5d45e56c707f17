"""One set of defaults for all operators."""

from dataclasses import dataclass


@dataclass(frozen=True)
class ScanSettings:
    min_mapq: int = 20
    min_clip_length: int = 20
    min_split_aligned: int = 30
    min_pileup_depth: int = 4
    pileup_window: int = 5
    merge_distance: int = 500
    bg_bin_size: int = 1000
    bg_window_size: int = 10_000
    top_n_candidates: int = 100
    breakpoint_merge_window: int = 5000
    promiscuous_threshold: int = 5
    min_cluster_support: int = 3
    band: int = 1000
    telemetry_bin: int = 100_000
    annotation_bin: int = 10_000
    scales: tuple[int, ...] = (1_000_000, 100_000, 10_000, 1_000)
    contig_length: int = 20_000_000


DEFAULTS = ScanSettings()
