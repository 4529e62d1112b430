"""Column expressions: clamps, unit parsers, names, budgets and labels.

All are built-in functions, so they stay inside code generation.  Rounding is to
even (``bround``), arithmetic on doubles is explicit, and malformed text is null.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

DOUBLE = "double"
BYTE_UNITS = ("B", "KiB", "MiB", "GiB", "TiB")


def clamp(x: Column, low, high) -> Column:
    """``x`` within ``low``..``high``."""
    return F.least(F.lit(high), F.greatest(F.lit(low), x))


def floor_step(x: Column, step: int = 1000) -> Column:
    """The multiple of ``step`` at or below ``x``, at least one step."""
    return F.greatest(F.lit(step).cast("long"), (F.floor(x / step) * step).cast("long"))


def ceil_step(x: Column, step: int = 1000) -> Column:
    """The multiple of ``step`` at or above ``x``, at least one step."""
    return F.greatest(F.lit(step).cast("long"), (F.ceil(x / step) * step).cast("long"))


def whole(x: Column) -> Column:
    """Rounded to an integer, halves to even."""
    return F.bround(x.cast(DOUBLE), 0).cast("long")


def parse_rate(text: Column, units: str = "km") -> Column:
    """``128k``, ``1.5m`` (and ``2g`` if ``g`` is among ``units``) as a number of bits;
    null without a match or if not positive."""
    low = F.lower(F.trim(text))
    number = F.regexp_extract(low, rf"^([0-9]+(?:\.[0-9]+)?)([{units}]?)$", 1)
    unit = F.regexp_extract(low, rf"^([0-9]+(?:\.[0-9]+)?)([{units}]?)$", 2)
    factor = F.when(unit == "k", 1e3).when(unit == "m", 1e6).when(unit == "g", 1e9).otherwise(1.0)
    value = number.try_cast(DOUBLE) * factor
    return F.when(value > 0, whole(value))


def parse_rate_down(text: Column) -> Column:
    """the same with ``k``, ``m`` and ``g``, decimals cut off; 0 stays 0, and null
    means no match only."""
    low = F.lower(F.trim(text))
    pattern = r"^([0-9]+(?:\.[0-9]+)?)([kmg]?)$"
    unit = F.regexp_extract(low, pattern, 2)
    factor = F.when(unit == "k", 1e3).when(unit == "m", 1e6).when(unit == "g", 1e9).otherwise(1.0)
    return F.when(low.rlike(pattern), F.floor(F.regexp_extract(low, pattern, 1).try_cast(DOUBLE) * factor).cast("long"))


def parse_speed(text: Column) -> Column:
    """``1.5x`` as 1.5; null without the ``x`` or if not positive."""
    value = F.regexp_extract(F.trim(text), r"^([0-9]+(?:\.[0-9]+)?)x$", 1).try_cast(DOUBLE)
    return F.when(value > 0, value)


def parse_clock(text: Column) -> Column:
    """``H:M:S.ss`` in seconds; null in another shape."""
    part = F.split(text, ":")
    seconds = part[0].try_cast(DOUBLE) * 3600 + part[1].try_cast(DOUBLE) * 60 + part[2].try_cast(DOUBLE)
    return F.when(F.size(part) == 3, seconds)


def parse_fraction(text: Column) -> Column:
    """``30000/1001`` as a ratio; null for ``0/0``, ``N/A`` and ratios that are not positive."""
    part = F.split(text, "/")
    below = F.when(F.size(part) > 1, F.try_element_at(part, F.lit(2)).try_cast(DOUBLE)).otherwise(1.0)
    value = F.try_divide(part[0].try_cast(DOUBLE), below)
    return F.when(value > 0, value)


def lenient_long(text: Column) -> Column:
    """An integer by way of a double, 0 if there is none."""
    value = text.try_cast(DOUBLE)
    return F.coalesce(F.when(~F.isnan(value), value).try_cast("long"), F.lit(0).cast("long"))


def safe_name(text: Column, default: str = "item") -> Column:
    """Runs outside ``[A-Za-z0-9._-]`` become ``_``; ``.`` and ``_`` go at both ends."""
    cleaned = F.regexp_replace(F.regexp_replace(text, r"[^A-Za-z0-9._-]+", "_"), r"^[._]+|[._]+$", "")
    return F.when(cleaned == "", default).otherwise(cleaned)


def file_name(path: Column) -> Column:
    """The part after the last slash; slashes at the end don't count."""
    return F.regexp_extract(path, r"([^/]*)/*$", 1)


def stem(path: Column) -> Column:
    """The file name without its last suffix; a leading dot begins no suffix."""
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]+$", "")


def suffix(path: Column) -> Column:
    """The last suffix with its dot, or an empty text."""
    return F.regexp_extract(file_name(path), r".(\.[^.]+)$", 1)


def parent(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*/*$", "")


def source_token(path: Column) -> Column:
    """the safe name of a path's stem and the first ten hex digits of the SHA-1 of
    the whole path."""
    return F.concat(safe_name(stem(path)), F.lit("_"), F.substring(F.sha1(path.cast("binary")), 1, 10))


def work_paths(work: Column, path: Column, codec: str, container: str, stage: str) -> dict[str, Column]:
    """where a source's samples, log and pass log are kept."""
    token, name = source_token(path), stem(path)
    join = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    return {
        "source_sample": join(work, "/preview/", token, "/", name, "_source_sample", suffix(path)),
        "encoded_sample": join(work, "/preview/", token, "/", name, f"_{codec}_preview.{container}"),
        "log": join(work, "/logs/", token, f"_{stage}.log"),
        "passlog": join(work, "/temp/", token, f"_{stage}.ffpass"),
    }


def shorten(text: Column, limit: int) -> Column:
    """white space runs become blanks; longer texts end in ``...`` at ``limit``; null
    becomes an empty text."""
    flat = F.coalesce(F.trim(F.regexp_replace(text, r"\s+", " ")), F.lit(""))
    return F.when(F.length(flat) <= limit, flat).otherwise(F.concat(F.rtrim(F.substring(flat, 1, limit - 3)), F.lit("...")))


NOT_KNOWN = "n/a"


def human_size(n: Column) -> Column:
    """bytes with two decimals in binary units, with their sign; null as ``n/a``."""
    size = F.abs(n.cast(DOUBLE))
    top = len(BYTE_UNITS) - 1
    out = F.format_string("%.2f " + BYTE_UNITS[top], F.bround(size / float(1024**top), 2))
    for k in range(top - 1, -1, -1):
        out = F.when(size < float(1024 ** (k + 1)), F.format_string("%.2f " + BYTE_UNITS[k], F.bround(size / float(1024**k), 2))).otherwise(out)
    return F.when(n.isNull(), NOT_KNOWN).otherwise(F.concat(F.when(n < 0, "-").otherwise(""), out))


def human_duration(seconds: Column) -> Column:
    """``H:MM:SS``, or ``M:SS`` below an hour, of rounded seconds; null and 0 as
    ``n/a``."""
    s = whole(seconds)
    short = F.format_string("%d:%02d", F.floor(s / 60).cast("long"), s % 60)
    long = F.format_string("%d:%02d:%02d", F.floor(s / 3600).cast("long"), F.floor(s / 60).cast("long") % 60, s % 60)
    return F.when(F.coalesce(seconds, F.lit(0)) == 0, NOT_KNOWN).when(s < 3600, short).otherwise(long)


def human_kbps(rate: Column) -> Column:
    """thousands of bits, rounded."""
    return F.concat(whole(rate / 1000).cast("string"), F.lit(" kbps"))


def target_rate(source: Column, ratio: float, least_kbps: int, most_kbps: int) -> Column:
    """``source * ratio`` within a floor, a cap if there is one, and 50,000."""
    value = F.greatest(whole(source * ratio), F.lit(least_kbps * 1000).cast("long"))
    if most_kbps > 0:
        value = F.least(value, F.lit(most_kbps * 1000).cast("long"))
    return F.greatest(value, F.lit(50_000).cast("long"))


def rate_budget(size: Column, duration: Column, audio: Column, ratio: float) -> Column:
    """Rate that keeps ``ratio`` of ``size`` at 98 percent use, less the audio."""
    most = F.greatest(F.lit(1).cast("long"), F.floor(size * ratio).cast("long"))
    return F.floor(most * 8 * 0.98 / duration).cast("long") - audio


def predicted_size(video: Column, audio: Column, duration: Column) -> Column:
    """Bytes of a file of these rates, rounded up at 98 percent use."""
    return F.ceil((video + audio) * duration / 8 / 0.98).cast("long")


def search_tolerance(ceiling: Column, least: int, ratio: float) -> Column:
    return F.greatest(F.lit(least).cast("long"), whole(ceiling * ratio))


def by_limits(x: Column, limits: list[tuple[float, object]], last, closed: int = 0) -> Column:
    """The value of the first limit above ``x``, else ``last``.  The last ``closed``
    limits count themselves in."""
    out = F.lit(last)
    for k, (limit, value) in reversed(list(enumerate(limits))):
        out = F.when(x <= limit if k >= len(limits) - closed else x < limit, F.lit(value)).otherwise(out)
    return out


def odd_below(x: Column) -> Column:
    """``x``, or one less if even."""
    return x - (1 - x % 2)


# Pixel formats of a known depth, and the depths a trailing number may name.
EIGHT_BIT = ["yuv420p", "yuv422p", "yuv444p", "yuvj420p", "yuvj422p", "yuvj444p", "nv12", "nv21", "rgb24", "bgr24"]
TEN_BIT = ["p010", "p010le", "p010be", "p210", "p210le", "p210be"]
DEPTHS = [9, 10, 12, 14, 16]


def bit_depth(pixel_format: Column) -> Column:
    """bits of a pixel format: a known name, else a trailing number of one or two
    digits that is a depth."""
    low = F.lower(F.trim(pixel_format))
    digits = F.regexp_extract(low, r"(\d{1,2})(?:le|be)?$", 1).try_cast("int")
    return F.when(low.isin(EIGHT_BIT), 8).when(low.isin(TEN_BIT), 10).when(digits.isin(DEPTHS), digits)


def classify_line(text: Column) -> Column:
    """``command``, ``error`` or ``process``."""
    return F.when(text.startswith("$ "), "command").when(F.lower(text).rlike("error|failed|traceback|cancelled"), "error").otherwise("process")


def output_root(path: Column, is_file: Column, chosen: Column, codec: str) -> Column:
    """the chosen folder, else that of a single file, else one beside the folder."""
    beside = F.concat(F.regexp_replace(path, "/+$", ""), F.lit(f"_compressed_{codec}"))
    return F.coalesce(F.regexp_replace(chosen, "/+$", ""), F.when(is_file, parent(path)).otherwise(beside))


def output_path(source: Column, inputs: Column, root: Column, codec: str, container: str) -> Column:
    """the source's stem with codec and container under ``root``, in the same folder
    as below ``inputs``; directly in ``root`` where the source lies elsewhere or
    ``inputs`` is null (a single file)."""
    within = F.concat(F.regexp_replace(inputs, "/+$", ""), F.lit("/"))
    folder = F.when(source.startswith(within), F.substr(parent(source), F.length(within) + 1))
    middle = F.when(F.coalesce(folder, F.lit("")) == "", "/").otherwise(F.concat(F.lit("/"), folder, F.lit("/")))
    return F.concat(F.regexp_replace(root, "/+$", ""), middle, stem(source), F.lit(f"_{codec}.{container}"))


def geometry_label(width: Column, height: Column) -> Column:
    """``W x H``, or ``-`` where one is missing."""
    return F.when(width.isNotNull() & height.isNotNull(), F.format_string("%dx%d", width, height)).otherwise("-")


def percent_label(share: Column) -> Column:
    """a share as a percentage with one decimal."""
    return F.format_string("%.1f%%", share * 100)


def has_option(help_text: Column, option: str) -> Column:
    """whether a line of a help text begins with the option, as a whole word."""
    word = "".join(c if c.isalnum() or c in "_-" else "\\" + c for c in option)
    return F.coalesce(help_text.rlike(rf"(?m)^\s*{word}(?![\w-])"), F.lit(False))


def first_line(text: Column) -> Column:
    """The first line that is not blank, trimmed; null if there is none."""
    return F.try_element_at(F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != ""), F.lit(1))


def merged_context(*layers: Column) -> Column:
    """Maps laid over each other; later keys win."""

    def over(below: Column, above: Column) -> Column:
        return F.map_concat(F.map_filter(below, lambda k, _: ~F.map_contains_key(above, k)), above)

    return reduce(over, layers)
