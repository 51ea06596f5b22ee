"""Calculation settings: how stress, normalised power and thresholds are computed, read from TOML and written back."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadentia.functions import formula
from cadentia.functions.formula import quoted
from cadentia.operators import power

#: Stress formulas, smoothings and threshold methods by name; anything else is a formula of the user's (no smoothing is).
STRESS = {"Classic": "classic", "BikeScore": "bikescore"}
SMOOTHINGS = ("RollingAverage", "ExponentialMovingAverage", "WeightedMovingAverage")
THRESHOLDS = {"TwentyMinute": 0.95, "EightMinute": 0.98, "CriticalPower": None}
#: The share of the newest sample in an exponential mean.
ALPHA = 0.3


class SettingsError(ValueError):
    """Settings that can't be used."""


@dataclass(frozen=True)
class Settings:
    """Validated as they are made; formulas: name to (expression, description or None)."""

    stress: str = "Classic"
    threshold: str = "TwentyMinute"
    window: int = 30
    smoothing: str = "RollingAverage"
    formulas: dict[str, tuple[str, str | None]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.smoothing not in SMOOTHINGS:
            raise SettingsError(f"unknown smoothing {self.smoothing}: {', '.join(SMOOTHINGS)} are known")
        if isinstance(self.window, bool) or not isinstance(self.window, int) or not 1 <= self.window <= power.LONGEST_WINDOW:
            raise SettingsError(f"a window has 1 to {power.LONGEST_WINDOW} seconds")
        try:
            for text in (*([] if self.stress in STRESS else [self.stress]), *([] if self.threshold in THRESHOLDS else [self.threshold]), *(e for e, _ in self.formulas.values())):
                formula.validate(text)
        except formula.FormulaError as e:
            raise SettingsError(f"{e}: {text}") from e

    def stress_of(self, values: dict[str, Column]) -> Column:
        """Training stress by the chosen formula over columns (duration, IF, ...)."""
        return formula.column(formula.BUILT_IN[STRESS[self.stress]] if self.stress in STRESS else self.stress, values)

    def normalised(self, points: DataFrame) -> DataFrame:
        """(workout_id, np) by the chosen smoothing and window."""
        return power.smoothed_np(points, self.smoothing, self.window, ALPHA)

    def threshold_of(self, best: Column, values: dict[str, Column] | None = None) -> Column:
        """The threshold from the best power of the test, rounded half to even; a critical power counts as it is."""
        if self.threshold in THRESHOLDS:
            return F.bround(best * (THRESHOLDS[self.threshold] or 1.0), 0).cast("int")
        return F.bround(formula.column(self.threshold, {"power": best, **(values or {})}), 0).cast("int")


#: Settings to start from.
TEMPLATES = {
    "cycling": Settings(),
    "running": Settings(threshold="EightMinute"),
    "triathlon": Settings(formulas={"weekly_load": ("cycling_tss + (running_tss * 1.1) + (swimming_tss * 1.2)", "Total weekly training load with sport weighting")}),
}


def load(toml: str, base: Settings | None = None) -> Settings:
    """Settings from TOML; what it doesn't say is as in ``base``. Unknown names, doubled formulas and bad TOML are an error."""
    try:
        said = tomllib.loads(toml)
    except tomllib.TOMLDecodeError as e:
        raise SettingsError(f"invalid TOML: {e}") from e
    known = {"tss_formula": "stress", "ftp_method": "threshold", "np_window_seconds": "window", "smoothing_algorithm": "smoothing"}
    calculation, formulas = said.pop("calculation", {}), said.pop("custom_formulas", None)
    if said or calculation.keys() - known.keys():
        raise SettingsError(f"unknown settings: {', '.join(sorted({*said, *(calculation.keys() - known.keys())}))}")
    changes: dict = {known[k]: v.strip() if isinstance(v, str) else v for k, v in calculation.items()}
    if formulas is not None:
        names = [f.get("name") for f in formulas]
        if len(set(names)) < len(names) or not all(isinstance(f.get("name"), str) and isinstance(f.get("expression"), str) for f in formulas):
            raise SettingsError("each custom formula has a name of its own and an expression")
        changes["formulas"] = {f["name"]: (f["expression"], f.get("description")) for f in formulas}
    return replace(base or Settings(), **changes)


def dump(settings: Settings) -> str:
    lines = ["[calculation]", f"tss_formula = {quoted(settings.stress)}", f"np_window_seconds = {settings.window}", f"smoothing_algorithm = {quoted(settings.smoothing)}", f"ftp_method = {quoted(settings.threshold)}"]
    for name, (expression, description) in sorted(settings.formulas.items()):
        lines += ["", "[[custom_formulas]]", f"name = {quoted(name)}", f"expression = {quoted(expression)}", *([f"description = {quoted(description)}"] if description is not None else [])]
    return "\n".join(lines) + "\n"
