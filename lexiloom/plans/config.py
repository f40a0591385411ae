"""Configurations and their presets."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from ..operators.coherence import CoherenceConfig


class ConfigurationError(ValueError):
    pass


@dataclass(frozen=True)
class ReductionConfig:
    method: str = "pca"  # or "umap", "none"
    dimension: int = 15
    whiten: bool = False
    variance_ratio: float | None = None
    neighbours: int = 15
    min_dist: float = 0.1
    metric: str = "euclidean"
    epochs: int | None = None
    seed: int | None = None


@dataclass(frozen=True)
class ClusteringConfig:
    min_cluster_size: int = 5
    min_samples: int | None = None
    epsilon: float = 0.0
    method: str = "eom"
    allow_single: bool = False
    metric: str = "euclidean"


@dataclass(frozen=True)
class RepresentationConfig:
    keywords: int = 10
    min_df: int = 1
    max_df: float = 0.70
    min_length: int = 2
    bigrams: bool = False
    diversify: bool = False
    diversity_weight: float = 0.3


@dataclass(frozen=True)
class TopicModelConfig:
    reduction: ReductionConfig = field(default_factory=ReductionConfig)
    clustering: ClusteringConfig = field(default_factory=ClusteringConfig)
    representation: RepresentationConfig = field(default_factory=RepresentationConfig)
    coherence: CoherenceConfig | None = field(default_factory=CoherenceConfig)
    seed: int | None = None

    @classmethod
    def preset(cls, name: str) -> TopicModelConfig:
        r, c, w, h = ReductionConfig, ClusteringConfig, RepresentationConfig, CoherenceConfig
        return {
            "default": cls(),
            "fast": cls(r(dimension=10), c(3, 2), w(5), None),
            "quality": cls(r(dimension=25), c(10, 5), w(15, diversify=True), h(window=20, top_keywords=15)),
            "small_corpus": cls(r(dimension=10), c(3, 2, allow_single=True), w(8), h(top_keywords=8)),
            "large_corpus": cls(r(dimension=30), c(20, 10), w(15, min_df=3), h(window=15)),
        }[name]

    def validate(self) -> TopicModelConfig:
        problems = [
            (self.reduction.dimension < 1, "the dimension must be positive"),
            (self.reduction.method not in ("pca", "umap", "none"), "unknown reduction"),
            (self.clustering.min_cluster_size < 2, "clusters have two members or more"),
            (self.representation.keywords < 1, "topics have a keyword or more"),
            (self.coherence is not None and self.coherence.top_keywords > self.representation.keywords, "coherence asks for more keywords than topics have"),
        ]
        for bad, why in problems:
            if bad:
                raise ConfigurationError(why)
        return self


class TopicModelConfigBuilder:
    def __init__(self, config: TopicModelConfig | None = None) -> None:
        self._config = config or TopicModelConfig()

    def reduction(self, **changes: object) -> TopicModelConfigBuilder:
        return TopicModelConfigBuilder(replace(self._config, reduction=replace(self._config.reduction, **changes)))

    def clustering(self, **changes: object) -> TopicModelConfigBuilder:
        return TopicModelConfigBuilder(replace(self._config, clustering=replace(self._config.clustering, **changes)))

    def representation(self, **changes: object) -> TopicModelConfigBuilder:
        return TopicModelConfigBuilder(replace(self._config, representation=replace(self._config.representation, **changes)))

    def coherence(self, config: CoherenceConfig | None) -> TopicModelConfigBuilder:
        return TopicModelConfigBuilder(replace(self._config, coherence=config))

    def seed(self, seed: int) -> TopicModelConfigBuilder:
        return TopicModelConfigBuilder(replace(self._config, seed=seed))

    def build(self) -> TopicModelConfig:
        return self._config.validate()


@dataclass(frozen=True)
class UpdateConfig:
    """Of the incremental path."""

    cold_start: int = 30
    retrain: int = 30
    max_buffer: int = 100
    growth: float = 1.5
    max_age_days: float = 180.0
    outlier_rate: float = 0.20
    drift: float = 1.5
    match: float = 0.7
    assign: float = 0.3
    window: int = 100
    model: TopicModelConfig = field(default_factory=lambda: TopicModelConfig.preset("small_corpus"))

    @classmethod
    def preset(cls, name: str) -> UpdateConfig:
        return {
            "default": cls(),
            "aggressive": cls(cold_start=20, retrain=20, max_buffer=50, growth=1.3, max_age_days=90, outlier_rate=0.15, drift=1.3),
            "conservative": cls(cold_start=50, retrain=50, max_buffer=150, growth=2.0, max_age_days=365, outlier_rate=0.25, drift=2.0),
            "testing": cls(cold_start=5, retrain=3, max_buffer=10, growth=1.2, max_age_days=1 / 1440, outlier_rate=0.10, drift=1.2),
        }[name]

    def validate(self) -> UpdateConfig:
        if self.cold_start < 5 or self.retrain < 3 or self.max_buffer < self.retrain or self.growth <= 1 or not 0 < self.assign < 1 or not 0 < self.match <= 1 or self.window < 1:
            raise ConfigurationError("thresholds out of range")
        return self
