"""Configuration: the TOML file, its checks, and which setting wins."""

from __future__ import annotations

import math
import tomllib
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from .functions.score import METRICS, POLICIES, PRESETS, is_valid_threshold
from .operators.view import SORTS, ViewSpec

TOP = {"threshold", "preset", "metric", "missing_coverage_policy", "src", "exclude", "overrides", "views", "language", "output", "delta"}
VIEW = {"top", "min_coverage", "max_coverage", "sort", "only_failing", "no_fail", "group_by", "minimal_view"}
LANGUAGE = {"threshold", "preset", "metric", "exclude"}
OUTPUT = {"annotation_limit", "title", "subtitle"}


class ConfigError(ValueError):
    """A configuration that can't be used."""


@dataclass(frozen=True)
class FileConfig:
    threshold: float | None = None
    preset: str | None = None
    metric: str | None = None
    policy: str | None = None
    src: tuple[str, ...] | None = None
    exclude: tuple[str, ...] = ()
    overrides: tuple[tuple[str, float], ...] = ()
    views: Mapping[str, Mapping[str, Any]] = field(default_factory=dict)
    languages: Mapping[str, Mapping[str, Any]] = field(default_factory=dict)
    annotation_limit: int | None = None
    title: str | None = None
    subtitle: str | None = None
    epsilon: float | None = None


def _known(section: Mapping[str, Any], names: set[str], where: str) -> None:
    if odd := sorted(set(section) - names):
        raise ConfigError(f"unknown field `{odd[0]}` in {where}")


def _threshold(section: Mapping[str, Any], where: str) -> None:
    if "threshold" in section and "preset" in section:
        raise ConfigError(f"`threshold` and `preset` exclude each other in {where}")
    if "threshold" in section and not is_valid_threshold(float(section["threshold"])):
        raise ConfigError(f"threshold must be a positive number in {where}, not {section['threshold']}")
    _one_of(section, "preset", tuple(PRESETS), where)
    _one_of(section, "metric", METRICS, where)


def _one_of(section: Mapping[str, Any], name: str, values: Sequence[str], where: str) -> None:
    if name in section and section[name] not in values:
        raise ConfigError(f"unknown {name} {section[name]!r} in {where}: expected one of {', '.join(values)}")


def parse_config(text: str) -> FileConfig:
    try:
        raw = tomllib.loads(text)
    except tomllib.TOMLDecodeError as error:
        raise ConfigError(f"no valid TOML: {error}") from error
    _known(raw, TOP, "the configuration")
    _threshold(raw, "the configuration")
    _one_of(raw, "missing_coverage_policy", POLICIES, "the configuration")
    overrides = []
    for o in raw.get("overrides", []):
        _known(o, {"pattern", "threshold"}, "[[overrides]]")
        if not is_valid_threshold(float(o["threshold"])):
            raise ConfigError(f"threshold of override {o['pattern']!r} must be a positive number, not {o['threshold']}")
        overrides.append((o["pattern"], float(o["threshold"])))
    for name, v in raw.get("views", {}).items():
        where = f"[views.{name}]"
        _known(v, VIEW, where)
        _one_of(v, "sort", SORTS, where)
        _one_of(v, "group_by", ("file",), where)
        try:
            ViewSpec(min_coverage=v.get("min_coverage"), max_coverage=v.get("max_coverage"))
        except ValueError as error:
            raise ConfigError(f"{error} in {where}") from error
    for name, v in raw.get("language", {}).items():
        _known(v, LANGUAGE, f"[language.{name}]")
        _threshold(v, f"[language.{name}]")
    output, delta = raw.get("output", {}), raw.get("delta", {})
    _known(output, OUTPUT, "[output]")
    _known(delta, {"epsilon"}, "[delta]")
    limit, epsilon = output.get("annotation_limit"), delta.get("epsilon")
    if limit is not None and not 1 <= limit <= 100:
        raise ConfigError(f"annotation_limit must lie in 1 to 100, not {limit}")
    if epsilon is not None and not is_valid_epsilon(float(epsilon)):
        raise ConfigError(f"epsilon must be a finite number of 0 or more, not {epsilon}")
    src = raw.get("src")
    return FileConfig(
        raw.get("threshold"), raw.get("preset"), raw.get("metric"), raw.get("missing_coverage_policy"),
        None if src is None else (src,) if isinstance(src, str) else tuple(src),
        tuple(raw.get("exclude", ())), tuple(overrides), raw.get("views", {}), raw.get("language", {}),
        limit, output.get("title"), output.get("subtitle"), None if epsilon is None else float(epsilon),
    )


def is_valid_epsilon(x: float) -> bool:
    return math.isfinite(x) and x >= 0


def discover_config(start: str | Path, name: str = "crap.toml") -> Path | None:
    """The file in `start` or the nearest folder above it."""
    here = Path(start).resolve()
    return next((p / name for p in (here, *here.parents) if (p / name).is_file()), None)


def load_config(path: str | Path) -> FileConfig:
    return parse_config(Path(path).read_text(encoding="utf-8"))


@dataclass(frozen=True)
class Flags:
    """What the command line says; None or False: nothing."""

    threshold: float | None = None
    strict: bool = False
    lenient: bool = False
    metric: str | None = None
    policy: str | None = None
    src: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    annotation_limit: int | None = None
    epsilon: float | None = None


@dataclass(frozen=True)
class Effective:
    threshold: float
    overrides: tuple[tuple[str, float], ...]
    metric: str
    policy: str
    src: tuple[str, ...]
    exclude: tuple[str, ...]
    annotation_limit: int
    epsilon: float


def effective(flags: Flags, config: FileConfig | None, language: str, default_metric: str = "cognitive", forced_exclude: Sequence[str] = ()) -> Effective:
    """Each setting from the first that has it: flags, the language's section, the shared settings, the default. Excludes add up."""
    if (flags.threshold is not None) + flags.strict + flags.lenient > 1:
        raise ConfigError("--threshold, --strict and --lenient exclude each other")
    if flags.threshold is not None and not is_valid_threshold(flags.threshold):
        raise ConfigError(f"--threshold must be a positive number, not {flags.threshold}")
    if flags.epsilon is not None and not is_valid_epsilon(flags.epsilon):
        raise ConfigError(f"--threshold-epsilon must be a finite number of 0 or more, not {flags.epsilon}")
    shared = config or FileConfig()
    own = shared.languages.get(language, {})
    first = lambda *xs: next((x for x in xs if x is not None), None)
    preset = lambda p: None if p is None else PRESETS[p]
    threshold = first(flags.threshold, preset("strict" if flags.strict else None), preset("lenient" if flags.lenient else None), own.get("threshold"), preset(own.get("preset")), shared.threshold, preset(shared.preset), PRESETS["default"])
    return Effective(
        float(threshold),
        shared.overrides,
        first(flags.metric, own.get("metric"), shared.metric, default_metric),
        first(flags.policy, shared.policy, "pessimistic"),
        flags.src or shared.src or ("src",),
        tuple(dict.fromkeys([*forced_exclude, *flags.exclude, *own.get("exclude", ()), *shared.exclude])),
        first(flags.annotation_limit, shared.annotation_limit, 10),
        first(flags.epsilon, shared.epsilon, 0.0),
    )


def view_preset(config: FileConfig | None, name: str, path: str = "crap.toml") -> Mapping[str, Any]:
    views = config.views if config else None
    if views and name in views:
        return views[name]
    hint = f"available presets: {', '.join(sorted(views))}" if views else f"hint: {path} defines no [views.<name>] blocks" if config else f"hint: --view requires a {path} with a [views.{name}] block"
    raise ConfigError(f"unknown view preset `{name}`\n  {hint}")
