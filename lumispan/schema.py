"""The span schema and the settings of a data set and a model."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

MINUTE_US = 60_000_000
DAY_US = 86_400_000_000

SPAN = T.StructType(
    [
        T.StructField("trace_id", T.StringType()),
        T.StructField("span_id", T.StringType()),
        T.StructField("parent_span_id", T.StringType()),
        T.StructField("service", T.StringType()),
        T.StructField("operation", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("start_us", T.LongType()),
        T.StructField("dur_us", T.LongType()),
        T.StructField("attrs", T.MapType(T.StringType(), T.StringType())),
    ]
)

#: Columns that make up a span's identity, in the order of their names.
PRIMARY = ("kind", "operation", "service", "status")


@dataclass(frozen=True)
class ModelConfig:
    """What a model of a bucket of traces keeps."""

    bucket_us: int = MINUTE_US
    max_depth: int = 100
    max_children: int = 5000
    max_gmm_components: int = 3
    min_samples_for_gmm: int = 2
    use_duration_bounds: bool = True
    offset_value: str = "ratio"
    offset_model: str = "regression"
    topology_mode: str = "edge"
    seed: int = 42
    primary: tuple[str, ...] = PRIMARY
    dependent: tuple[str, ...] = field(default=())

    def __post_init__(self) -> None:
        for name, allowed in (
            ("offset_value", ("ratio", "absolute")),
            ("offset_model", ("regression", "percentile")),
            ("topology_mode", ("edge", "template")),
        ):
            if getattr(self, name) not in allowed:
                raise ValueError(f"{name} must be one of {allowed}")
        if self.bucket_us <= 0 or self.max_gmm_components < 1:
            raise ValueError("bucket_us and max_gmm_components must be positive")
        object.__setattr__(self, "dependent", tuple(d for d in self.dependent if d not in self.primary))

    @staticmethod
    def from_yaml(path: str, **overrides) -> "ModelConfig":
        """Settings from a YAML file of primary_attributes and dependent_attributes; overrides win."""
        import yaml

        with open(path) as f:
            raw = yaml.safe_load(f) or {}
        named = {"primary": raw.get("primary_attributes"), "dependent": raw.get("dependent_attributes")}
        known = {k: v for k, v in raw.items() if k in ModelConfig.__dataclass_fields__}
        values = known | {k: tuple(v) for k, v in named.items() if v} | overrides
        return ModelConfig(**values)
