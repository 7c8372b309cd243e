"""Recipes: which sources to read, how to join them, and where the result goes."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field
from pathlib import Path

try:
    import yaml
except ImportError:  # YAML is optional; JSON works without it
    yaml = None


@dataclass
class InputSource:
    dataset_type: str
    columns: list[str]
    interval: str | None = None
    resample: bool = False
    resample_freq: str | None = None


@dataclass
class Recipe:
    name: str
    symbols: list[str]
    time_range: dict[str, str]
    inputs: list[InputSource]
    description: str | None = None
    join_policy: dict = field(default_factory=lambda: {"key": "open_time", "missing": "drop"})
    output_format: str = "long"
    output_store: dict = field(default_factory=lambda: {"format": "parquet", "partition_by": ["symbol", "date"]})

    def __post_init__(self):
        self.inputs = [i if isinstance(i, InputSource) else InputSource(**i) for i in self.inputs]
        if not {"start", "end"} <= set(self.time_range):
            raise ValueError("time_range needs start and end")
        if self.output_format not in ("long", "wide"):
            raise ValueError(f"unknown output_format {self.output_format!r}")

    def to_dict(self) -> dict:
        return asdict(self)


def _kind(path: str) -> str:
    kind = {".yaml": "yaml", ".yml": "yaml", ".json": "json"}.get(Path(path).suffix.lower())
    if kind is None:
        raise ValueError(f"unknown recipe format {Path(path).suffix!r}")
    if kind == "yaml" and yaml is None:
        raise ValueError("YAML recipes need the yaml package")
    return kind


def load_recipe(path: str) -> Recipe:
    text = Path(path).read_text(encoding="utf-8")
    return Recipe(**(yaml.safe_load(text) if _kind(path) == "yaml" else json.loads(text)))


def save_recipe(recipe: Recipe, path: str) -> None:
    data = recipe.to_dict()
    text = yaml.safe_dump(data, sort_keys=False, allow_unicode=True) if _kind(path) == "yaml" else json.dumps(data, indent=2, ensure_ascii=False)
    Path(path).write_text(text, encoding="utf-8")
