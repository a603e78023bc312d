"""Run settings: validated when made, read from and written to JSON."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, fields
from datetime import datetime
from pathlib import Path

from timberline.errors import SpecError, need
from timberline.functions.timestamps import DEFAULT, TimeFormat, bound, checked_range, strptime_format
from timberline.sources.sinks import output_format


def _load(path: str):
    try:
        return json.loads(Path(path).read_text(encoding="utf-8"))
    except OSError as e:
        raise SpecError(f"cannot read {path}: {e}") from e
    except ValueError as e:
        raise SpecError(f"{path} is not JSON: {e}") from e


class Settings:
    @classmethod
    def from_dict(cls, values: dict):
        need(isinstance(values, dict), "an object is needed")
        known = {f.name for f in fields(cls)}
        need(set(values) <= known, f"unknown keys: {sorted(set(values) - known)}")
        try:
            return cls(**values)
        except TypeError as e:
            raise SpecError(str(e)) from e

    @classmethod
    def from_json_file(cls, path: str):
        return cls.from_dict(_load(path))

    def to_dict(self) -> dict:
        return {k: v.isoformat() if isinstance(v, datetime) else list(v) if isinstance(v, tuple) else v for k, v in asdict(self).items()}

    def save(self, path: str) -> None:
        Path(path).write_text(json.dumps(self.to_dict()), encoding="utf-8")

    @property
    def formats(self) -> tuple[TimeFormat, ...]:
        return tuple(strptime_format(f) for f in self.timestamp_formats or ()) or DEFAULT


@dataclass(frozen=True)
class SliceConfig(Settings):
    input_path: str | None = None
    start: datetime | str | None = None
    end: datetime | str | None = None
    timestamp_formats: tuple[str, ...] | None = None
    output_format: str = "plain"
    output_path: str | None = None

    def __post_init__(self):
        start, end = checked_range(self.start, self.end)
        object.__setattr__(self, "start", start)
        object.__setattr__(self, "end", end)
        object.__setattr__(self, "output_format", output_format(self.output_format))
        object.__setattr__(self, "timestamp_formats", tuple(self.timestamp_formats) if self.timestamp_formats else None)
        self.formats


@dataclass(frozen=True)
class FilterProfile(Settings):
    name: str
    start: datetime | str
    end: datetime | str
    timestamp_formats: tuple[str, ...] | None = None
    output_format: str = "plain"
    tags: tuple[str, ...] = ()

    def __post_init__(self):
        need(bool(self.name), "a profile needs a name")
        start, end = checked_range(self.start, self.end)
        need(start is not None and end is not None, "a profile needs both bounds")
        object.__setattr__(self, "start", start)
        object.__setattr__(self, "end", end)
        object.__setattr__(self, "output_format", output_format(self.output_format))
        object.__setattr__(self, "tags", tuple(self.tags))

    def config(self, input_path: str, output_path: str | None = None) -> SliceConfig:
        return SliceConfig(input_path, self.start, self.end, self.timestamp_formats, self.output_format, output_path)


def profiles_from_json(path: str) -> list[FilterProfile]:
    values = _load(path)
    need(isinstance(values, list) and len(values) > 0, "a non-empty array of profiles is needed")
    return [FilterProfile.from_dict(v) for v in values]
