"""Options with their defaults, and the catalogue of label-model presets."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class AlignmentConfig:
    language: str = "eng"
    sample_rate: int = 16000
    segment_size: float = 15.0
    overlap: float = 2.0
    least_segment: float = 0.2
    extra_samples: int = 128
    batch_size: int = 32
    frame_duration: float = 0.02
    skip_penalty: float = -0.5
    return_penalty: float = -18.0
    blank_penalty: float = 0.0
    neighborhood_size: int = 5
    neighbor_threshold: float = 0.4
    outlier_scan: int = 100
    outlier_jump: int = 60
    frame_score_threshold: float = 0.5
    skip_threshold: float = 0.2
    return_threshold: int = 3
    drop_exits: bool = False


@dataclass(frozen=True)
class StitchingConfig:
    method: str = "lis"
    neighborhood_size: int = 5
    neighbor_threshold: float = 0.4
    outlier_scan: int = 3
    outlier_jump: int = 50
    insertion_cost: float = 1.0
    deletion_cost: float = 1.0
    substitution_cost: float = 1.0
    frame_duration: float = 0.02


@dataclass(frozen=True)
class Vocabulary:
    labels: tuple[str, ...]
    blank: str = "-"
    unknown: str | None = "*"
    ids: dict = field(init=False, compare=False)

    def __post_init__(self):
        object.__setattr__(self, "ids", {c: i for i, c in reversed(list(enumerate(self.labels)))})

    def __len__(self) -> int:
        return len(self.labels)

    def __contains__(self, label: str) -> bool:
        return label in self.ids

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(i, c, c == self.blank, c == self.unknown) for i, c in enumerate(self.labels)]
        return spark.createDataFrame(rows, "id int, label string, is_blank boolean, is_unk boolean")


#: Name, kind of model, languages, frame duration in seconds, whether a star label is added.
PRESETS = [
    ("mms-fa", "pipeline", "multilingual", 0.02, True),
    ("wav2vec2-base", "pipeline", "eng", 0.02, True),
    ("wav2vec2-large", "pipeline", "eng", 0.02, True),
    ("mms-1b-all", "transformer", "multilingual", 0.02, True),
    ("conformer-ctc", "conformer", "eng", 0.04, True),
    ("fastconformer-hybrid", "conformer", "eng", 0.08, True),
]


def presets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PRESETS, "name string, family string, language string, frame_duration double, with_star boolean")


def presets_by_family(spark: SparkSession) -> DataFrame:
    return presets(spark).groupBy("family").agg(F.sort_array(F.collect_list("name")).alias("names"), F.count("*").alias("n"))


def preset(name: str) -> dict:
    """The preset of a name; unknown names are taken as a transformer model's, with its defaults."""
    for row in PRESETS:
        if row[0] == name:
            return dict(zip(("name", "family", "language", "frame_duration", "with_star"), row, strict=True))
    family = "conformer" if "conformer" in name else "transformer"
    return {"name": name, "family": family, "language": None, "frame_duration": 0.04 if family == "conformer" else 0.02, "with_star": True}
