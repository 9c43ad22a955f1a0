"""Configurations of runs: one file for each run of a fixed grid, named by the run.

Text is YAML where a reader for it is installed, else lines of ``key: JSON``, which YAML contains; writing always gives the latter.
A configuration outside the grid, with unknown or missing keys, or in a file of another name is an error.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields, replace

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .stores import load_config

# The variants (kind, filler, factor, without noise directions), and the grid of runs.
VARIANTS = {
    "c_0_10": ("crop", "0", 1.0, False),
    "c_0_15": ("crop", "0", 1.5, False),
    "c_mean_10": ("crop", "mean", 1.0, False),
    "c_mean_15": ("crop", "mean", 1.5, False),
    "c_blur_10": ("crop", "blur", 1.0, False),
    "c_blur_15": ("crop", "blur", 1.5, False),
    "p": ("pool", None, None, False),
    "p_perp": ("pool", None, None, True),
}
RUNS = {("dinov2", "hr_insdet"): 7, ("dinov3", "hr_insdet"): 8, ("dinov2", "pcb"): 7}  # how many of the variants, in order


def grid() -> list[tuple[str, str, str]]:
    """(encoder, variant, dataset) of all runs, in order."""
    return [(encoder, variant, dataset) for (encoder, dataset), n in RUNS.items() for variant in [*VARIANTS][:n]]


@dataclass(frozen=True)
class RunConfig:
    """One run; the defaults are fixed values."""

    dataset: str
    encoder: str
    variant: str
    seg_long_side: int = 2048
    crop_n_layers: int = 1
    points_per_batch: int = 16
    crop_size: int = 448
    blur_sigma_frac: float = 0.05
    blur_work_side: int = 4 * 448
    pool_long_side: int = 2048
    debias_r: int = 500
    debias_noise_seed: int = 20260918
    encoder_batch: int = 16
    batch_rule: str = "masks of one image in the order of their numbers; a batch never spans images"
    gallery_protocols: tuple[str, ...] = ("full", "one_per_class")
    hnsw: dict = field(default_factory=lambda: {"M": 32, "efConstruction": 200, "efSearch_min": 64})
    eps: tuple[float, ...] = (0.05, 0.01)
    delta: float = 0.1
    max_dets: int = 1000
    bootstrap: int = 1000
    seed: int = 20260918

    def __post_init__(self):
        if (self.encoder, self.variant, self.dataset) not in grid():
            raise ValueError(f"no run of {self.encoder}, {self.variant}, {self.dataset}")

    @property
    def run_id(self) -> str:
        return f"{self.encoder}_{self.variant}_{self.dataset}"

    def to_dict(self) -> dict:
        return json.loads(json.dumps({f.name: getattr(self, f.name) for f in fields(self)}))


def default(encoder: str, variant: str, dataset: str) -> RunConfig:
    """The run of the grid; boards have no replicates."""
    c = RunConfig(dataset, encoder, variant)
    return replace(c, bootstrap=0) if dataset == "pcb" else c


def dump(config: RunConfig) -> str:
    return "".join(f"{k}: {json.dumps(v, ensure_ascii=False)}\n" for k, v in config.to_dict().items())


def parse(text: str, name: str | None = None) -> RunConfig:
    """A configuration from the text of a file; ``name`` is the file's name, which must be the run's."""
    try:
        import yaml

        held = yaml.safe_load(text)
    except ImportError:
        held = load_config(text)
    known = {f.name for f in fields(RunConfig)}
    if set(held) != known:
        raise ValueError(f"unknown or missing keys: {', '.join(sorted(set(held) ^ known))}")
    config = RunConfig(**{k: tuple(v) if isinstance(v, list) else v for k, v in held.items()})
    if name is not None and name != f"{config.run_id}.yaml":
        raise ValueError(f"{name} holds the run {config.run_id}")
    return config


def write_all(spark: SparkSession, folder: str) -> None:
    """A file for each run of the grid."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for run in grid():
        config = default(*run)
        out = fs.create(path(f"{folder.rstrip('/')}/{config.run_id}.yaml"), True)
        out.write(bytearray(dump(config).encode()))
        out.close()


def read_all(spark: SparkSession, folder: str) -> dict[str, RunConfig]:
    """The configurations of a folder by run; an error if they are not the grid."""
    files = spark.read.text(f"{folder.rstrip('/')}/*.yaml", wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("name"), "value").collect()  # a short text for each run
    got = {c.run_id: c for c in (parse(r["value"], r["name"]) for r in files)}
    if sorted(got) != sorted("_".join(run) for run in grid()):
        raise ValueError(f"{folder} does not hold the runs of the grid")
    return got
