"""Row rules as column expressions: first reasons, layers, mapped policies, windows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from gaugeworks.functions.expr import whole


def first_reason(checks: Sequence[tuple[Column, str]]) -> Column:
    """The reason of the first check that holds, else null."""
    out = F.lit(None).cast("string")
    for holds, reason in reversed(checks):
        out = F.when(holds, reason).otherwise(out)
    return out


def number_reason(x: Column, low: float, high: float) -> Column:
    """Why a number is unfit, else null."""
    return first_reason([(x.isNull() | F.isnan(x), "not a number"), ((x < low) | (x > high), "out of range")])


def model_route(width: Column, height: Column, fps: Column, high_fidelity: Column, fast: float = 50) -> Column:
    """``4k`` by both sides in a high-fidelity context, ``hfr`` by rate, else ``standard``."""
    large = (F.least(width, height) >= 2160) & (F.greatest(width, height) >= 3840)
    return F.when(large & high_fidelity, "4k").when(fps >= fast, "hfr").otherwise("standard")


def actions(choices: Sequence[tuple[Column, str]]) -> Column:
    """The names whose condition holds, in order."""
    return F.array_compact(F.array(*(F.when(holds, name) for holds, name in choices)))


def retry_kbps(selected: Column, allowed: Column, actual: Column, cap: Column) -> Column:
    """P20: the rate that makes up for a miss, in thousands, at 98 percent, at least 1 and
    under a cap if there is one (above 0).  Null where a size or the rate is not positive."""
    rate = F.greatest(F.lit(1000).cast("long"), F.floor(selected * allowed / actual * 0.98).cast("long"))
    kbps = F.greatest(F.lit(1).cast("long"), F.floor(rate / 1000).cast("long"))
    capped = F.when(cap > 0, F.least(cap.cast("long"), kbps)).otherwise(kbps)
    return F.when((actual > 0) & (selected > 0) & allowed.isNotNull(), capped)


def mapped(x: Column, to: Mapping[str, str], otherwise) -> Column:
    """Looked up in a small table."""
    out = otherwise if isinstance(otherwise, Column) else F.lit(otherwise)
    for key, value in to.items():
        out = F.when(x == key, value).otherwise(out)
    return out


def lenient_choice(text: Column, choices: Sequence[str], default: str) -> Column:
    """A known name in any case, else the default."""
    low = F.lower(F.trim(text))
    return F.when(low.isin(list(choices)), low).otherwise(default)


def layered(*layers: Column) -> Column:
    """The first layer that is neither null nor blank."""
    return F.coalesce(*(F.when(F.trim(x) != "", x) for x in layers))


def inner_window(total: Column, size: Column, at: Column) -> tuple[Column, Column]:
    """(start, size) of a window inside ``total``: at a chosen place, or in the middle
    where ``at`` is null."""
    start = F.greatest(F.lit(0.0), F.least(F.coalesce(at, total / 2 - size / 2), total - size))
    return start, F.least(size, total)


def filled(template: Column, values: Mapping[str, Column]) -> Column:
    """F16: names in braces replaced by their values, doubled braces by single ones.  All or
    nothing: a template with a name that has no value, a format after a name, a numbered
    place or a brace without its other one is returned as it is."""
    field = r"\{[A-Za-z_][A-Za-z0-9_]*\}"
    parts = F.regexp_extract_all(template, F.lit(r"\{\{|\}\}|" + field + r"|[^{}]+|[{}]"), 0)
    known = [F.lit("{" + name + "}") for name in values]

    def good(part: Column) -> Column:
        return part.isin("{{", "}}") | (part.isin(*known) if known else F.lit(False)) | ~part.rlike("[{}]")

    def told(part: Column) -> Column:
        out = F.when(part == "{{", "{").when(part == "}}", "}")
        for name, value in values.items():
            out = out.when(part == "{" + name + "}", F.coalesce(value, F.lit("None")))
        return out.otherwise(part)

    return F.when(F.forall(parts, good), F.array_join(F.transform(parts, told), "")).otherwise(template)


def adaptive_windows(seconds: Column, uncertainty: Column, heterogeneity: Column, least: int, most: int) -> Column:
    """Windows for a length (on a log scale) and what its content leaves unsure."""
    length = F.least(F.lit(1.0), F.log1p(seconds / 600.0) / F.log1p(F.lit(18.0)))
    return F.least(F.lit(most), least + whole((most - least) * (0.30 * length + 0.45 * uncertainty + 0.25 * heterogeneity)).cast("int"))


def last_score(text: Column, pattern: str) -> Column:
    """The last number a pattern finds."""
    return F.try_element_at(F.regexp_extract_all(text, F.lit(pattern), 1), F.lit(-1)).try_cast("double")


# Presets of encoders that list none when asked, in their order.
FIXED_PRESETS = {
    "libx265": ["ultrafast", "superfast", "veryfast", "faster", "fast", "medium", "slow", "slower", "veryslow", "placebo"],
    "hevc_nvenc": ["p1", "p2", "p3", "p4", "p5", "p6", "p7"],
    "av1_nvenc": ["p1", "p2", "p3", "p4", "p5", "p6", "p7"],
    "hevc_qsv": ["veryfast", "faster", "fast", "medium", "slow", "slower", "veryslow"],
    "av1_qsv": ["veryfast", "faster", "fast", "medium", "slow", "slower", "veryslow"],
}
# The preset an encoder takes when none is asked for.
DEFAULT_PRESETS = {"libx265": "slow", "libsvtav1": "5", "hevc_nvenc": "p6", "av1_nvenc": "p6", "hevc_qsv": "slow", "av1_qsv": "slow"}


def preset_choices(encoder: Column, listed: Column) -> Column:
    """The presets an encoder listed when asked, blanks passed over, else its fixed
    ones, else none.  Encoders of the ``_videotoolbox`` kind have none."""
    held = F.filter(F.coalesce(listed, F.array().cast("array<string>")), lambda x: F.coalesce(x, F.lit("")) != "")
    fixed = F.array().cast("array<string>")
    for name, values in FIXED_PRESETS.items():
        fixed = F.when(encoder == name, F.array(*(F.lit(v) for v in values))).otherwise(fixed)
    none = F.array().cast("array<string>")
    return F.when(F.coalesce(encoder.endswith("_videotoolbox"), F.lit(False)), none).when(F.size(held) > 0, held).otherwise(fixed)


def chosen_preset(encoder: Column, asked: Column, choices: Column) -> Column:
    """The preset asked for, else the encoder's default if it has no choices or is one
    of them; the default of the ``_amf`` kind is its first choice named after quality."""
    best = F.try_element_at(F.filter(choices, lambda x: F.lower(x).contains("quality")), F.lit(1))
    default = F.when(encoder.isin("hevc_amf", "av1_amf"), best).otherwise(mapped(encoder, DEFAULT_PRESETS, F.lit(None).cast("string")))
    return F.coalesce(asked, F.when((F.size(choices) == 0) | F.array_contains(choices, default), default))


def needs_analysis(skip_reason: Column, mode: Column, smart: str = "smart") -> Column:
    """No reason to skip, and the mode is the smart one."""
    return skip_reason.isNull() & F.coalesce(mode == smart, F.lit(False))


def encoder_mismatch(bound: Column, bound_backend: Column, measured: Column, measured_backend: Column) -> Column:
    """Why a measurement does not belong to a row's encoder, else null."""
    other = ~measured.eqNullSafe(bound) | ~measured_backend.eqNullSafe(bound_backend)
    text = lambda x: F.coalesce(x.cast("string"), F.lit("none"))
    names = F.concat(F.lit("measured by "), text(measured), F.lit("/"), text(measured_backend), F.lit(", expected "), text(bound), F.lit("/"), text(bound_backend))
    return F.when(bound.isNull(), "no bound encoder").when(other, names)
