"""Parameters of the operators with their defaults, and a JSON file laid over them; names that are not known are ignored."""

from __future__ import annotations

import json
import os
from dataclasses import asdict, dataclass, field, fields


@dataclass
class Image:
    crop_long_side: int = 1280
    crop_overlap: float = 0.2
    minimum_text_height_after: int = 12
    detail_long_side: int = 1100
    crop_strategy: str = "grid"
    grid_rows: int = 2
    grid_cols: int = 2


@dataclass
class Analysis:
    confidence_threshold: float = 0.8
    max_element_labels: int = 12
    element_label_runs: int = 10
    element_label_threshold: float = 0.7
    element_label_pad_frac: float = 0.15


@dataclass
class Cache:
    enabled: bool = True
    dir: str = ""


@dataclass
class Reconciler:
    iou_threshold: float = 0.65
    confidence_merge: float = 0.5


@dataclass
class Settings:
    image: Image = field(default_factory=Image)
    analysis: Analysis = field(default_factory=Analysis)
    cache: Cache = field(default_factory=Cache)
    reconciler: Reconciler = field(default_factory=Reconciler)


def load(path: str = "") -> Settings:
    """Defaults, with what the file sets; a missing file sets nothing. The cache folder is also known as `database`."""
    found = Settings()
    if not path or not os.path.exists(path):
        return found
    with open(path, encoding="utf-8") as file:
        given = json.load(file)
    cache = given.get("cache", {})
    if cache.get("database") and not cache.get("dir"):
        given["cache"] = cache | {"dir": cache["database"]}
    for section in fields(found):
        part = getattr(found, section.name)
        for name in asdict(part).keys() & given.get(section.name, {}).keys():
            setattr(part, name, given[section.name][name])
    return found


def chosen(*values: object) -> object:
    """The first value that is set: of the command line, of the file, by default."""
    return next((v for v in values if v not in (None, "", 0)), None)
