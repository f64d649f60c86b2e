"""Configuration: frozen dataclasses, read strictly from YAML."""

from __future__ import annotations

import dataclasses
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any, get_type_hints

MODES = ("strict", "smart")
STAGES = ("s1_normalize", "s2_segment", "s3_spelling", "s4_grammar", "s5_punct", "s6_guardrails", "s7_assemble")
BACKENDS = ("none", "symspell", "rapidfuzz")


class ConfigError(ValueError):
    """The configuration is not valid. Messages name keys, never values."""


def _bounds(least: float | None = None, most: float | None = None, default: Any = None, factory: Any = None) -> Any:
    meta = {"least": least, "most": most}
    return field(default_factory=factory, metadata=meta) if factory else field(default=default, metadata=meta)


@dataclass(frozen=True)
class Limits:
    max_body_bytes: int = _bounds(1, default=1_048_576)
    max_text_chars: int = _bounds(1, default=20_000)


@dataclass(frozen=True)
class PolicyOverrides:
    enabled_stages: tuple[str, ...] | None = None
    max_changed_char_ratio: float | None = _bounds(0.0, 1.0)
    pz_buffer_chars: int | None = _bounds(0)


@dataclass(frozen=True)
class Policies:
    strict: PolicyOverrides = field(default_factory=PolicyOverrides)
    smart: PolicyOverrides = field(default_factory=PolicyOverrides)


@dataclass(frozen=True)
class Lexicon:
    """A list that is given replaces the default, even if it is empty."""

    allowlist: tuple[str, ...] | None = None
    denylist: tuple[str, ...] | None = None

    def untouched(self) -> frozenset[str]:
        allow = ("Python", "FastAPI", "Docker") if self.allowlist is None else self.allowlist
        deny = ("TODO", "FIXME") if self.denylist is None else self.denylist
        return frozenset(allow) | frozenset(deny)


@dataclass(frozen=True)
class Punctuation:
    fix_space_before: bool = True
    fix_space_after: bool = True


@dataclass(frozen=True)
class SafeNormalize:
    collapse_spaces: bool = True
    trim_line_edges: bool = True
    collapse_blank_lines: bool = True


@dataclass(frozen=True)
class Rulepack:
    typo_map_strict: dict[str, str] = field(default_factory=dict)
    typo_map_smart: dict[str, str] = field(default_factory=dict)
    typo_map_strict_ru: dict[str, str] = field(default_factory=dict)
    typo_map_smart_ru: dict[str, str] = field(default_factory=dict)
    no_touch_strict_ru: tuple[str, ...] = ()
    no_touch_smart_ru: tuple[str, ...] = ()
    no_touch_prefixes_ru: tuple[str, ...] = ()
    typo_min_token_len: int = _bounds(1, default=4)
    enable_morph_safety_ru: bool = False
    enable_candidate_generation_ru: bool = False
    candidate_shadow_mode_ru: bool = False
    candidate_backend: str = "none"
    max_candidates_ru: int = _bounds(1, 10, default=3)
    max_edit_distance_ru: int = _bounds(1, 2, default=1)
    dictionary_source_ru: str = ""
    v2_selector_scaffold_enabled: bool = False
    v2_selector_min_confidence: float = 0.0
    v2_selector_min_margin: float = 0.0
    safe_normalize: SafeNormalize = field(default_factory=SafeNormalize)
    punctuation: Punctuation = field(default_factory=Punctuation)
    punctuation_spacing_ru: Punctuation = field(default_factory=Punctuation)

    def typo_map(self, mode: str) -> dict[str, str]:
        """The Russian map of the mode if it has entries, else the general one."""
        ru, general = (self.typo_map_smart_ru, self.typo_map_smart) if mode == "smart" else (self.typo_map_strict_ru, self.typo_map_strict)
        return ru or general

    def no_touch(self, mode: str) -> frozenset[str]:
        chosen = (self.no_touch_smart_ru if mode == "smart" else ()) or self.no_touch_strict_ru
        return frozenset(t for t in chosen if t)

    def no_touch_prefixes(self) -> tuple[str, ...]:
        return tuple(p for p in self.no_touch_prefixes_ru if p)

    def spacing(self) -> Punctuation:
        """The Russian flags if either was switched off, else the general ones."""
        return self.punctuation if self.punctuation_spacing_ru == Punctuation() else self.punctuation_spacing_ru


@dataclass(frozen=True)
class Config:
    limits: Limits = field(default_factory=Limits)
    policies: Policies = field(default_factory=Policies)
    lexicon: Lexicon = field(default_factory=Lexicon)
    rulepack: Rulepack = field(default_factory=Rulepack)


@dataclass(frozen=True)
class Policy:
    mode: str
    stages: tuple[str, ...]
    max_edits: int
    max_changed_ratio: float
    zone_buffer: int


#: Stages, edit budget, ratio limit and zone buffer of each mode; fixed values.
_DEFAULTS = {
    "strict": Policy("strict", ("s1_normalize", "s2_segment", "s6_guardrails", "s7_assemble"), 5, 0.02, 2),
    "smart": Policy("smart", STAGES, 10, 0.1, 1),
}


def policy(mode: str, config: Config = Config()) -> Policy:
    """The policy of a mode; any mode but ``smart`` is strict. Three values can be overridden."""
    base = _DEFAULTS["smart" if mode == "smart" else "strict"]
    own = config.policies.smart if mode == "smart" else config.policies.strict
    stages = tuple(own.enabled_stages or base.stages)
    if unknown := [s for s in stages if s not in STAGES]:
        raise ConfigError(f"unknown stage: {unknown[0]}")
    return dataclasses.replace(
        base,
        stages=stages,
        max_changed_ratio=base.max_changed_ratio if own.max_changed_char_ratio is None else own.max_changed_char_ratio,
        zone_buffer=base.zone_buffer if own.pz_buffer_chars is None else own.pz_buffer_chars,
    )


def _build(kind: type, raw: Any, where: str) -> Any:
    if not isinstance(raw, dict):
        raise ConfigError(f"{where} must be a mapping")
    hints, known = get_type_hints(kind), {f.name: f for f in dataclasses.fields(kind)}
    if unknown := sorted(set(raw) - set(known)):
        raise ConfigError(f"unknown key in {where}: {unknown[0]}")
    out = {}
    for name, value in raw.items():
        hint, meta, place = hints[name], known[name].metadata, f"{where}.{name}"
        if dataclasses.is_dataclass(hint):
            out[name] = _build(hint, {} if value is None else value, place)
            continue
        shown = str(hint)
        if value is None and "None" in shown:
            out[name] = None
        elif "tuple" in shown:
            if not isinstance(value, list) or not all(isinstance(x, str) for x in value):
                raise ConfigError(f"{place} must be a list of strings")
            out[name] = tuple(value)
        elif "dict" in shown:
            if not isinstance(value, dict) or not all(isinstance(x, str) for pair in value.items() for x in pair):
                raise ConfigError(f"{place} must map strings to strings")
            out[name] = dict(value)
        else:
            want = bool if "bool" in shown else str if "str" in shown else (int, float) if "float" in shown else int
            if not isinstance(value, want) or (isinstance(value, bool) and want is not bool):
                raise ConfigError(f"{place} has the wrong type")
            if (meta.get("least") is not None and value < meta["least"]) or (meta.get("most") is not None and value > meta["most"]):
                raise ConfigError(f"{place} is out of bounds")
            out[name] = value
    return kind(**out)


def from_mapping(raw: dict | None) -> Config:
    config = _build(Config, raw or {}, "config")
    for mode in MODES:
        policy(mode, config)
    preflight(config)
    return config


def load(path: str | Path | None) -> Config:
    """The configuration in a YAML file; without a path the defaults. Whatever is wrong with the file is an error."""
    if path is None:
        return Config()
    import yaml

    try:
        raw = yaml.safe_load(Path(path).read_text(encoding="utf-8"))
    except (OSError, yaml.YAMLError) as e:
        raise ConfigError("the configuration file can't be read") from e
    return from_mapping(raw)


def preflight(config: Config) -> None:
    """Candidates need a known backend; the dictionary is a DataFrame and is checked where it is passed."""
    rules = config.rulepack
    if rules.candidate_backend not in BACKENDS:
        raise ConfigError("config.rulepack.candidate_backend is unknown")
    if rules.enable_candidate_generation_ru and rules.candidate_backend == "none":
        raise ConfigError("candidate generation needs a backend")
