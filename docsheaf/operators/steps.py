"""Which preprocessing steps apply: predicates in fixed order, applied and skipped lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docsheaf.config import Preprocessing

# Step names in pipeline order.
ORDER = ("grayscale", "invert", "noise_removal", "deskew", "normalization", "binarization", "scaling")


def flags(c: Preprocessing, noise: Column, skew: Column, contrast: Column) -> dict[str, Column]:
    return {"needs_denoising": noise > c.noise_threshold, "needs_deskewing": F.abs(skew) > c.skew_threshold, "needs_contrast": contrast < c.contrast_threshold}


def predicates(c: Preprocessing, channels: Column, is_inverted: Column, noise: Column, skew: Column, contrast: Column, value_range: Column, is_binary: Column, dpi: Column, deskew: bool = True) -> dict[str, Column]:
    """Step -> whether it applies. Analysis values are those of the input; value range and
    two-valuedness are those of the image the step sees. Denoising ignores its strength. Inside a
    document pipeline deskew is off, since the page was rotated before it was split."""
    need = flags(c, noise, skew, contrast)
    gray = channels == 1
    flat = gray if c.preserve_color else F.lit(True)
    return {
        "grayscale": channels == 4 if c.preserve_color else ~gray,
        "invert": F.lit(c.auto_invert) & is_inverted,
        "noise_removal": need["needs_denoising"],
        "deskew": F.lit(c.auto_deskew and deskew) & need["needs_deskewing"],
        "normalization": need["needs_contrast"] | (flat & (value_range < 0.8)),
        "binarization": F.lit(c.binarization_method != "none") & ~(flat & is_binary),
        "scaling": F.lit(c.max_scale_factor > 1.0) & (dpi < c.target_dpi) & (F.lit(float(c.target_dpi)) / dpi >= 1.1),
    }


def rotates_page(c: Preprocessing, skew: Column) -> Column:
    """Rotation before splitting: at the threshold itself it applies here, not in the step."""
    return F.lit(c.auto_deskew) & ~(F.abs(skew) < c.skew_threshold)


def plan(applies: dict[str, Column], enabled: bool = True) -> tuple[Column, Column]:
    """(applied, skipped) step names in pipeline order."""
    chosen = [s for s in ORDER if s in applies]
    on = lambda s: F.coalesce(applies[s], F.lit(False)) & F.lit(enabled)
    names = lambda test: F.filter(F.array(*[F.when(test(s), F.lit(s)) for s in chosen]), lambda x: x.isNotNull())
    return names(on), names(lambda s: ~on(s))


class StepPlan:
    """An editable list of steps; the order of the built-in ones is fixed, others go where put."""

    def __init__(self, applies: dict[str, Column]):
        self.steps = [(s, applies[s]) for s in ORDER if s in applies]

    def add(self, name: str, predicate: Column, position: int | None = None) -> None:
        self.steps.insert(len(self.steps) if position is None else position, (name, predicate))

    def remove(self, name: str) -> bool:
        kept = [s for s in self.steps if s[0] != name]
        found, self.steps = len(kept) < len(self.steps), kept
        return found

    def applied(self) -> Column:
        return F.filter(F.array(*[F.when(p, F.lit(n)) for n, p in self.steps]), lambda x: x.isNotNull())
