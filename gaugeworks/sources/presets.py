"""Named presets and application settings: a few small JSON files, kept by the driver."""

from __future__ import annotations

import fcntl
import json
import os
import re
import tempfile
from collections.abc import Callable, Mapping
from pathlib import Path
from typing import Any

# Fixed value: what the name of a preset may be.
NAME = re.compile(r"[A-Za-z0-9._-]+")


def _place(folder: str, name: str) -> Path:
    if not NAME.fullmatch(name):
        raise ValueError(f"not a preset name: {name!r}")
    return Path(folder) / f"{name}.json"


def _replace(path: Path, data: Mapping[str, Any]) -> None:
    path.parent.mkdir(parents=True, exist_ok=True)
    handle, part = tempfile.mkstemp(dir=path.parent, suffix=".tmp")
    with os.fdopen(handle, "w", encoding="utf-8") as f:
        json.dump(data, f, sort_keys=True, indent=2, allow_nan=False)
    os.replace(part, path)


def list_presets(folder: str) -> list[str]:
    return sorted(p.stem for p in Path(folder).glob("*.json"))


def save_preset(folder: str, name: str, options: Mapping[str, Any]) -> Path:
    path = _place(folder, name)
    _replace(path, options)
    return path


# The names that options may have.
CHOICES = {
    "codec": ("hevc", "av1"),
    "compression_mode": ("smart", "fixed_bitrate"),
    "size_blocked_policy": ("relax_size", "relax_quality", "ask"),
    "quality_unreachable_policy": ("skip", "ask"),
    "skipped_output_policy": ("copy", "ask", "ignore"),
    "analysis_profile": ("fast", "balance", "precise"),
    "backend": ("auto", "cpu", "nvenc", "qsv", "amf", "videotoolbox"),
    "parallel_backends": ("auto", "cpu", "nvenc", "qsv", "amf", "videotoolbox"),
    "decode_acceleration": ("software", "videotoolbox"),
    "audio_mode": ("copy", "aac"),
    "container": ("mkv", "mp4"),
    "viewing_context": ("high_fidelity", "standard_display"),
}


def check_options(options: Mapping[str, Any], choices: Mapping[str, tuple[str, ...]] = CHOICES) -> None:
    """P25: names must be known ones, ``ratio`` positive, ``min_vmaf`` above 0 and up to
    100, ``max_output_ratio`` above 0 and up to 1; what is null or absent is not checked."""
    for key, known in choices.items():
        value = options.get(key)
        for one in value if isinstance(value, list) else [value]:
            if one is not None and one not in known:
                raise ValueError(f"{key}: {one!r} is none of {known}")
    for key, high in (("ratio", float("inf")), ("min_vmaf", 100.0), ("max_output_ratio", 1.0)):
        value = options.get(key)
        if value is not None and not 0 < float(value) <= high:
            raise ValueError(f"{key} is out of range: {value!r}")


def load_preset(folder: str, name: str, defaults: Mapping[str, Any], choices: Mapping[str, tuple[str, ...]] = CHOICES) -> dict[str, Any]:
    """A preset with missing keys from ``defaults``; blank text counts as null.  Unknown
    keys and options that don't pass :func:`check_options` are errors."""
    held = json.loads(_place(folder, name).read_text(encoding="utf-8"))
    unknown = set(held) - set(defaults)
    if unknown:
        raise ValueError(f"unknown keys: {sorted(unknown)}")
    options = {k: None if isinstance(v, str) and not v.strip() else v for k, v in {**defaults, **held}.items()}
    check_options(options, choices)
    return options


def delete_preset(folder: str, name: str) -> bool:
    path = _place(folder, name)
    found = path.exists()
    path.unlink(missing_ok=True)
    return found


def update_settings(path: str, defaults: Mapping[str, Any], change: Callable[[dict[str, Any]], dict[str, Any] | None]) -> dict[str, Any]:
    """Read, change and write settings in one replace; missing keys get defaults.
    ``change`` returns new settings or changes those it is given.  A lock on a file beside
    them keeps others out from the read to the write, so no change is lost."""
    place = Path(path)
    place.parent.mkdir(parents=True, exist_ok=True)
    with open(place.with_name(place.name + ".lock"), "w") as lock:
        fcntl.flock(lock, fcntl.LOCK_EX)
        held = json.loads(place.read_text(encoding="utf-8")) if place.exists() else {}
        own = {**defaults, **held}
        new = change(own)
        new = own if new is None else new
        _replace(place, new)
    return new
