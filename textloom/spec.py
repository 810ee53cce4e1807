"""What a clustering run is asked to do, checked before anything is read."""

from __future__ import annotations

from dataclasses import dataclass, field
from pathlib import PurePosixPath

ALGORITHMS = ("kmeans", "dbscan", "agglomerative")
PROJECTIONS = ("pca", "tsne")


@dataclass(frozen=True)
class ClusterSpec:
    """Parameters with their defaults; an error names the parameter."""

    column: str = "text"
    id_column: str | None = None
    algorithm: str = "kmeans"
    n_clusters: int = 5
    eps: float = 0.5
    min_samples: int = 5
    max_features: int | None = 2000
    top_n: int = 10
    name_top_n: int = 3
    name_joiner: str = ", "
    name_noise: bool = False
    visualize: str | None = None
    perplexity: float = 30.0
    seed: int = 42
    restarts: int = 3
    approximate: bool = False
    stop_words: tuple[str, ...] | None = field(default=None)

    def __post_init__(self) -> None:
        if self.algorithm not in ALGORITHMS:
            raise ValueError(f"no algorithm is called {self.algorithm!r}: there are {', '.join(ALGORITHMS)}")
        if self.visualize is not None and self.visualize not in PROJECTIONS:
            raise ValueError(f"no projection is called {self.visualize!r}: there are {', '.join(PROJECTIONS)}")
        for name, least in (("n_clusters", 1), ("min_samples", 1), ("max_features", 1), ("top_n", 0), ("name_top_n", 0), ("restarts", 1)):
            if getattr(self, name) is not None and getattr(self, name) < least:
                raise ValueError(f"{name} must be at least {least}")
        if not self.eps > 0:
            raise ValueError("eps must be above 0")
        if not self.perplexity > 0:
            raise ValueError("perplexity must be above 0")


def derived_path(base: str, suffix: str) -> str:
    """``base`` without its extension, with ``suffix``: data.xlsx and _clustered.xlsx give data_clustered.xlsx."""
    p = PurePosixPath(base)
    stem = base[: len(base) - len(p.suffix)] if p.suffix else base
    return stem + suffix
