"""What a run asks and how: guidance, labels, model, threshold."""

from __future__ import annotations

import importlib.util
import json
import sys
from dataclasses import dataclass, field, replace
from pathlib import Path

from ..functions.canonical import check_json

DEFAULT_CRITERIA = {
    "NORMAL": "The field's value fits its entry and the guidance.",
    "ANOMALY": "The field's value is wrong, implausible, or at odds with its entry or the guidance.",
}


class ConfigError(ValueError):
    """A configuration that can't be used."""


@dataclass(frozen=True)
class Config:
    guidance: str = ""
    exemplars: tuple = ()
    labels: tuple[str, ...] = ("NORMAL", "ANOMALY")
    criteria: dict[str, str | None] = field(default_factory=dict)
    anomaly_label: str = "ANOMALY"
    model: str = "rules-1"
    threshold: float = 0.5
    parser: object = None

    def __post_init__(self) -> None:
        if not 2 <= len(self.labels) <= 255 or len({*self.labels}) < len(self.labels) or not all(isinstance(x, str) and x for x in self.labels):
            raise ConfigError("there must be 2 to 255 distinct labels")
        if self.anomaly_label not in self.labels:
            raise ConfigError("the anomaly label must be one of the labels")
        if self.criteria and {*self.criteria} != {*self.labels}:
            raise ConfigError("criteria must be given for each label, and for no other")
        if not isinstance(self.threshold, int | float) or isinstance(self.threshold, bool) or not 0 <= self.threshold <= 1:
            raise ConfigError("the threshold must lie in 0..1")
        if not isinstance(self.guidance, str) or not isinstance(self.model, str) or not self.model:
            raise ConfigError("guidance and model must be texts")
        check_json(list(self.exemplars))

    @property
    def all_criteria(self) -> dict[str, str | None]:
        return {x: self.criteria[x] if self.criteria else DEFAULT_CRITERIA.get(x) for x in self.labels}


def load_config(path: str | Path) -> Config:
    """`config` of a trusted Python file, run anew each time; files beside it can be imported while it runs."""
    where = Path(path).resolve()
    spec = importlib.util.spec_from_file_location("_siftwell_config", where)
    if spec is None or not where.exists():
        raise ConfigError(f"{path} can't be loaded")
    module, before = importlib.util.module_from_spec(spec), list(sys.path)
    try:
        sys.path.insert(0, str(where.parent))
        exec(compile(where.read_text("utf-8"), str(where), "exec"), module.__dict__)
    finally:
        sys.path[:] = before
    found = getattr(module, "config", None)
    if not isinstance(found, Config):
        raise ConfigError(f"{path} has no Config named config")
    return found


def with_inputs(config: Config, guidance: str | None = None, guidance_file: str | None = None, exemplars: str | None = None, model: str | None = None, threshold: float | None = None) -> Config:
    """config with what the command line gives: a guidance file's text and then inline text replace guidance."""
    parts = [Path(guidance_file).read_text("utf-8")] if guidance_file else []
    parts += [guidance] if guidance else []
    changes: dict = {"guidance": "\n\n".join(parts)} if parts else {}
    if exemplars:
        found = json.loads(Path(exemplars).read_text("utf-8"))
        if not isinstance(found, list):
            raise ConfigError("exemplars must be a JSON list")
        changes["exemplars"] = tuple(found)
    if model:
        changes["model"] = model
    if threshold is not None:
        changes["threshold"] = threshold
    return replace(config, **changes)
