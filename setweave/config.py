"""Options of a nearest-neighbour run and their validation."""

from __future__ import annotations

from dataclasses import dataclass

ALGORITHMS = ("baseline", "baselinepp", "topkbaseline", "slim", "full", "eager", "grouping", "partition", "palloc", "transformation", "les3", "puffinn")
GROUPINGS = ("identity", "wsqrt", "usqrt", "aio", "fixed")
MODES = ("sample", "join")
SUFFIX_DEPTHS = (0, 2, 4, 6, 8, 10)


@dataclass(frozen=True)
class KnnConfig:
    """A run over a collection: the k nearest sets of each query by Jaccard similarity, the query's own included.

    Threads, batches and memory are Spark's settings. timeout is in seconds, 0 is none. In sample mode sample_size
    queries are drawn with the seed; in join mode every set is a query."""

    k: int
    algorithm: str = "slim"
    grouping: str = "identity"
    mode: str = "sample"
    sample_size: int = 10_000
    seed: int = 0x42424242
    timeout: float = 0.0
    suffix_depth: int = 0
    fingerprint: bool = False
    deletion: bool = False
    preprocess: bool = False
    groups: str | None = None
    recall: float = 0.95
    label: str = ""

    def __post_init__(self) -> None:
        def need(ok: bool, what: str) -> None:
            if not ok:
                raise ValueError(what)

        need(self.k > 0, "k must be positive")
        need(self.algorithm in ALGORITHMS, f"unknown algorithm {self.algorithm!r}")
        need(self.grouping in GROUPINGS, f"unknown length grouping {self.grouping!r}")
        need(self.mode in MODES, f"unknown mode {self.mode!r}")
        need(self.sample_size > 0, "the sample size must be positive")
        need(self.timeout >= 0, "the timeout must not be negative")
        need(self.suffix_depth in SUFFIX_DEPTHS, f"the suffix depth must be one of {SUFFIX_DEPTHS}")
        need(0 < self.recall <= 1, "the recall must be above 0 and at most 1")
        need(self.algorithm != "les3" or self.groups is not None, "les3 needs groups")
        need(not (self.groups is not None and self.preprocess), "groups name record ids, which preprocessing changes")
