"""Settings of a run: defaults, JSON in snake or camel case, and checks."""

from __future__ import annotations

import json
import logging
import re
from dataclasses import dataclass, field, fields

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class Settings:
    random_seed: int = 0
    kmeans_clusters: int = 16
    kmeans_min_delta: float = 1.0
    color_space: str = "rgb"
    color_restrictions: tuple[tuple[int, int, int], ...] = ()
    color_aliases: dict[str, tuple[int, int, int]] = field(default_factory=dict)
    narrow_pixel_strip_cleanup_runs: int = 3
    remove_facets_smaller_than: int = 20
    remove_facets_from_large_to_small: bool = True
    maximum_number_of_facets: int = 4294967295
    border_smoothing_passes: int = 2
    show_labels: bool = False
    show_borders: bool = False
    fill_facets: bool = True
    resize_enabled: bool = False
    resize_max_width: int = 1024
    resize_max_height: int = 1024


def snake(name: str) -> str:
    return re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", name).lower()


def camel(name: str) -> str:
    return re.sub(r"_([a-z0-9])", lambda m: m[1].upper(), name)


def load(text: str, **override) -> Settings:
    """Settings from JSON in either case; what is missing keeps its default, unknown keys are ignored, `override` wins."""
    raw = {snake(k): v for k, v in json.loads(text).items()}
    for k, v in (raw.pop("resize", None) or {}).items():
        raw[f"resize_{snake(k)}"] = v
    raw |= override
    if "color_restrictions" in raw:
        raw["color_restrictions"] = tuple(map(tuple, raw["color_restrictions"]))
    known = {f.name for f in fields(Settings)}
    return Settings(**{k: v for k, v in raw.items() if k in known})


#: Short names of URL parameters.
SHORT = {
    "clusters": "kmeans_clusters",
    "precision": "kmeans_min_delta",
    "seed": "random_seed",
    "cleanup_runs": "narrow_pixel_strip_cleanup_runs",
    "remove_facets": "remove_facets_smaller_than",
    "max_facets": "maximum_number_of_facets",
    "smoothing": "border_smoothing_passes",
    "resize_width": "resize_max_width",
    "resize_height": "resize_max_height",
}
MAY_BE_ZERO = {"random_seed", "narrow_pixel_strip_cleanup_runs", "border_smoothing_passes"}


def number(text: str, default: float, zero: bool = False) -> float:
    """The number that a text begins with, whole if the default is; the default where there is none, or it is below zero, or zero where that may not be."""
    found = re.match(r"\s*[+-]?\d+" if isinstance(default, int) else r"\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", text)
    value = type(default)(found[0]) if found else default
    return value if 0 < value < float("inf") or zero and value == 0 else default


def form(values: dict[str, str]) -> Settings:
    """Settings from the texts of a form or of URL parameters, by short or full names in either case. What does not parse, or is out of range, keeps its default."""
    out = {}
    defaults = {f.name: getattr(Settings(), f.name) for f in fields(Settings)}
    for k, text in values.items():
        k = SHORT.get(snake(k), snake(k))
        default = defaults.get(k)
        if k == "color_restrictions":
            out[k] = tuple(c for line in text.splitlines() for c in _colours(line))
        elif k == "removal_order":
            out["remove_facets_from_large_to_small"] = text != "small_to_large"
        elif k == "color_space":
            out[k] = text or default
        elif isinstance(default, bool):
            out[k] = text in ("1", "true")
        elif isinstance(default, int | float):
            out[k] = number(text, default, k in MAY_BE_ZERO)
    return Settings(**out)


def _colours(line: str) -> tuple[tuple[int, int, int], ...]:
    try:
        return restrictions(line)
    except ValueError as e:
        log.warning("%s, skipped", e)
        return ()


def restrictions(text: str) -> tuple[tuple[int, int, int], ...]:
    """Colours from lines r,g,b; blank lines and those that start with // are skipped, others must be three numbers from 0 to 255."""
    out = []
    for line in map(str.strip, text.splitlines()):
        if line and not line.startswith("//"):
            c = [x.strip() for x in line.split(",")]
            if len(c) != 3 or not all(x.isdigit() and int(x) <= 255 for x in c):
                raise ValueError(f"not a colour: {line}")
            out.append(tuple(map(int, c)))
    return tuple(out)
