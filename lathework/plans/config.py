"""Settings from YAML and the command line, and chained operators (O-U2, O-U9, O-U10)."""

from __future__ import annotations

import dataclasses
import json
from collections.abc import Callable
from dataclasses import dataclass, field
from types import UnionType
from typing import Any, Union, get_args, get_origin, get_type_hints

from pyspark.sql import DataFrame

from lathework.operators import mix


def parse_yaml(text: str) -> dict[str, Any]:
    """Settings in the part of YAML that configs use: scalars, lists of scalars or of flat mappings."""
    try:
        import yaml

        return yaml.safe_load(text) or {}
    except ModuleNotFoundError:
        pass
    out: dict[str, Any] = {}
    key = item = None
    for line in text.splitlines():
        bare = line.split(" #")[0].rstrip()
        if not bare.strip() or bare.strip().startswith("#"):
            continue
        body = bare.strip()
        if body.startswith("- "):
            out[key] = out[key] or []
            body, item = body[2:].strip(), None
            if ": " in body or body.endswith(":"):
                item = {}
                out[key].append(item)
            else:
                out[key].append(_scalar(body))
                continue
        name, _, value = body.partition(":")
        if bare[0] != " " and not bare.lstrip().startswith("- "):
            key, item = name.strip(), None
            out[key] = _scalar(value.strip()) if value.strip() else None
        elif item is not None:
            item[name.strip()] = _scalar(value.strip())
        else:
            raise ValueError(f"can't read the line {line!r}")
    return out


def _scalar(text: str) -> Any:
    if len(text) > 1 and text[0] == text[-1] and text[0] in "\"'":
        return text[1:-1].encode().decode("unicode_escape") if text[0] == '"' else text[1:-1]
    if text.lower() in ("true", "false"):
        return text.lower() == "true"
    if text.lower() in ("null", "~", ""):
        return None
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            continue
    return text


def merge(*kinds: type) -> type:
    """One dataclass with the fields of all; the first to name a field wins."""
    seen: dict[str, tuple] = {}
    for kind in kinds:
        hints = get_type_hints(kind)
        for f in dataclasses.fields(kind):
            seen.setdefault(f.name, (f.name, hints[f.name], field(default=f.default, default_factory=f.default_factory) if f.default is dataclasses.MISSING and f.default_factory is not dataclasses.MISSING else field(default=f.default)))
    ordered = sorted(seen.values(), key=lambda x: x[2].default is not dataclasses.MISSING or x[2].default_factory is not dataclasses.MISSING)
    return dataclasses.make_dataclass("Settings", ordered)


def read_arguments(arguments: list[str]) -> dict[str, Any]:
    """--name=value, --name value, or a bare --name for true; one given twice errs."""
    out: dict[str, Any] = {}
    i = 0
    while i < len(arguments):
        if not arguments[i].startswith("--"):
            raise ValueError(f"{arguments[i]!r} belongs to no argument")
        name, equals, value = arguments[i].lstrip("-").partition("=")
        i += 1
        if not equals:
            value = True
            if i < len(arguments) and not arguments[i].startswith("--"):
                value, i = arguments[i], i + 1
        if name in out:
            raise ValueError(f"--{name} is given twice")
        out[name] = value
    return out


def load_settings(kind: type, text: str, arguments: list[str] | None = None) -> Any:
    """A dataclass from YAML text, overridden by command-line arguments cast to the fields' types."""
    values = parse_yaml(text) | read_arguments(arguments or [])
    hints = get_type_hints(kind)
    known = {f.name for f in dataclasses.fields(kind)}
    if unknown := sorted(set(values) - known):
        raise ValueError(f"no such setting: {', '.join(unknown)}")
    return kind(**{k: _cast(v, hints[k]) for k, v in values.items()})


#: Texts that say true and false.
TRUE, FALSE = ("true", "1", "yes"), ("false", "0", "no")


def _cast(value: Any, hint: Any) -> Any:
    origin, own = get_origin(hint), get_args(hint)
    if origin in (Union, UnionType):  # an optional value
        return value if value is None else _cast(value, next(x for x in own if x is not type(None)))
    if hint is bool:
        if isinstance(value, bool):
            return value
        if str(value).lower() not in TRUE + FALSE:
            raise ValueError(f"{value!r} is neither true nor false")
        return str(value).lower() in TRUE
    if hint in (int, float) and not isinstance(value, bool):
        return hint(value)
    if isinstance(value, str) and (origin or hint) in (list, dict):
        if own == (str,) and not value.lstrip().startswith("["):
            return value.split(",")
        return json.loads(value)
    return value


@dataclass(frozen=True)
class Processor:
    """A step that needs some columns and promises others."""

    name: str
    run: Callable[[DataFrame], DataFrame]
    needs: tuple[str, ...] = ()
    gives: tuple[str, ...] = ()

    def __call__(self, df: DataFrame) -> DataFrame:
        out = self.run(mix.require(df, list(self.needs)))
        missing = [c for c in self.gives if c not in out.columns]
        if missing:
            raise ValueError(f"{self.name} gave no {', '.join(missing)}")
        return out


@dataclass(frozen=True)
class Pipeline:
    steps: tuple[Processor, ...]

    def __call__(self, df: DataFrame) -> DataFrame:
        for step in self.steps:
            df = df.transform(step)
        return df
