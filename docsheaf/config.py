"""Engine settings: validated defaults, per-engine overrides and the table joins read."""

from __future__ import annotations

import os
from dataclasses import asdict, dataclass, fields, replace

from pyspark.sql import DataFrame, SparkSession


def _check(ok: bool, what: str) -> None:
    if not ok:
        raise ValueError(what)


@dataclass(frozen=True)
class Splitting:
    enabled: bool = True
    max_megapixels: float = 2.0
    max_dimension: int = 2048
    overlap_percent: float = 0.4
    min_gap_pixels: int = 10
    gap_threshold: float = 0.95
    min_chunk_size: int = 256
    target_chunk_size: int = 1024
    prefer_horizontal_splits: bool = False

    def __post_init__(self):
        _check(self.max_megapixels > 0 and self.max_dimension > 0, "limits must be positive")
        _check(0 <= self.overlap_percent <= 1 and 0 <= self.gap_threshold <= 1, "shares lie in 0..1")
        _check(self.min_gap_pixels >= 1 and self.min_chunk_size > 0 and self.target_chunk_size > 0, "sizes must be positive")


@dataclass(frozen=True)
class Preprocessing:
    enabled: bool = True
    target_dpi: int = 300
    max_scale_factor: float = 3.0
    denoise_strength: int = 10
    binarization_method: str = "adaptive"
    auto_deskew: bool = True
    auto_invert: bool = True
    preserve_color: bool = False
    blur_threshold: float = 100.0
    noise_threshold: float = 0.1
    skew_threshold: float = 1.0
    contrast_threshold: float = 0.3

    def __post_init__(self):
        _check(72 <= self.target_dpi <= 1200, "target_dpi lies in 72..1200")
        _check(1 <= self.max_scale_factor <= 5, "max_scale_factor lies in 1..5")
        _check(0 <= self.denoise_strength <= 20, "denoise_strength lies in 0..20")
        _check(self.binarization_method in ("otsu", "adaptive", "none"), "unknown binarization method")
        _check(0 <= self.noise_threshold <= 1 and 0 <= self.skew_threshold <= 45 and 0 <= self.contrast_threshold <= 1 and self.blur_threshold > 0, "threshold out of range")


# Per-engine overrides, names, times and limits (the defaults above are fixed too).
GLOBAL_SPLITTING, GLOBAL_PREPROCESSING = Splitting(), Preprocessing()
ENGINE_SPLITTING = {"qari": replace(GLOBAL_SPLITTING, max_megapixels=2.5, max_dimension=2560, overlap_percent=0.5, min_gap_pixels=20, gap_threshold=0.98, min_chunk_size=512, target_chunk_size=1536, prefer_horizontal_splits=True)}
ENGINE_PREPROCESSING = {"qari": replace(GLOBAL_PREPROCESSING, max_scale_factor=1.0, denoise_strength=0, binarization_method="none", auto_invert=False, preserve_color=True), "got": GLOBAL_PREPROCESSING, "deepseek": GLOBAL_PREPROCESSING}
ENGINES = ("qari", "got", "deepseek")
DEFAULT_ENGINE = "deepseek"
JOB_TIMEOUT_S, JOB_TTL_S, STALE_JOB_S = 1200, 3600, 300
STATUS_TTL_S, LOCK_TTL_S = 600, 900
TRANSIENT = ("downloading", "loading")
WEBHOOK_TIMEOUT_S, WEBHOOK_ATTEMPTS = 30, 3
MAX_IMAGE_MB, MAX_PDF_MB = 50, 100
MODEL_MIN_BYTES = 104_857_600
SWITCH_WAIT_S = 30


def loaded(kind: type, prefix: str, spark: SparkSession | None = None, env: dict | None = None, base=None):
    """Settings of a ``kind`` (Splitting or Preprocessing) with values of the environment
    (``PREFIX_FIELD``) over those of ``base``, and those of the session (``spark.docsheaf.prefix.field``)
    over both. A value that does not read as the field's type, or is out of range, is an error."""
    base, env = base or kind(), os.environ if env is None else env
    found = {}
    for f in fields(kind):
        text = env.get(f"{prefix}_{f.name}".upper())
        if spark is not None:
            text = spark.conf.get(f"spark.docsheaf.{prefix.lower()}.{f.name}", text)
        if text is not None:
            was = getattr(base, f.name)
            try:
                found[f.name] = _BOOLEANS[text.strip().lower()] if isinstance(was, bool) else type(was)(text)
            except (KeyError, ValueError):
                raise ValueError(f"{prefix}_{f.name}: {text!r} is no {type(was).__name__}") from None
    return replace(base, **found)


def dotenv(text: str) -> dict:
    """NAME=value lines of a settings file; comments, blank lines, quotes and ``export`` are allowed."""
    out = {}
    for line in text.splitlines():
        name, sep, value = line.strip().removeprefix("export ").partition("=")
        if sep and not name.startswith("#"):
            value = value.strip()
            out[name.strip()] = value[1:-1] if len(value) > 1 and value[0] == value[-1] and value[0] in "\"'" else value
    return out


_BOOLEANS = {"1": True, "true": True, "yes": True, "on": True, "0": False, "false": False, "no": False, "off": False}


def engine_config(spark: SparkSession) -> DataFrame:
    """One row per engine that overrides splitting; other engines fall back to the global values."""
    return spark.createDataFrame([{"engine": name} | asdict(c) for name, c in ENGINE_SPLITTING.items()], "engine string, enabled boolean, max_megapixels double, max_dimension long, overlap_percent double, min_gap_pixels long, gap_threshold double, min_chunk_size long, target_chunk_size long, prefer_horizontal_splits boolean")
