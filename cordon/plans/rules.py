"""Rules, configuration and the policy table that findings are joined with."""

from __future__ import annotations

import re
import tomllib
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.plain import Allow
from ..functions.values import ACTIONS, AUDIENCES, CATEGORIES
from ..functions.windows import Sizes

BUILTIN = Path(__file__).resolve().parent.parent / "rules" / "categories.toml"
#: Looked for in the working folder where no path is given.
DEFAULT_CONFIG = "cordon.toml"
POLICY_SCHEMA = "category string, ord int, action string, rank int, citations array<string>"


def checked(kind: str, value: str, known: list[str]) -> str:
    if value not in known:
        raise ValueError(f"unknown {kind} `{value}` (expected {', '.join(known)})")
    return value


def category(value: str) -> str:
    return checked("category", value, CATEGORIES)


def audience(value: str) -> str:
    return checked("audience", value, AUDIENCES)


def action(value: str) -> str:
    return checked("action", value, ACTIONS)


def _only(table: dict, known: set[str], where: str) -> None:
    if unknown := set(table) - known:
        raise ValueError(f"unknown field `{sorted(unknown)[0]}` in {where}")


@dataclass(frozen=True)
class Rule:
    citations: tuple[str, ...]
    actions: dict[str, str]
    question: str | None = None


@dataclass(frozen=True)
class Rules:
    categories: dict[str, Rule]

    @classmethod
    def parse(cls, source: str) -> Rules:
        raw = tomllib.loads(source)
        _only(raw, {"version", "categories"}, "rules")
        if raw.get("version") != 1:
            raise ValueError(f"unsupported rules version {raw.get('version')}")
        out = {}
        for name, r in raw.get("categories", {}).items():
            _only(r, {"question", "citations", *AUDIENCES}, f"categories.{name}")
            if missing := [a for a in AUDIENCES if a not in r]:
                raise ValueError(f"categories.{name} has no {missing[0]}")
            out[category(name)] = Rule(tuple(r.get("citations", [])), {a: action(r[a]) for a in AUDIENCES}, r.get("question"))
        if missing := [c for c in CATEGORIES if c not in out]:
            raise ValueError(f"rules lack category `{missing[0]}`")
        return cls(out)

    @classmethod
    def builtin(cls) -> Rules:
        return cls.parse(BUILTIN.read_text(encoding="utf-8"))

    def table(self, spark: SparkSession) -> DataFrame:
        """category, ord, question, citations and an action for each audience."""
        rows = [(c, i, self.categories[c].question, list(self.categories[c].citations), *(self.categories[c].actions[a] for a in AUDIENCES)) for i, c in enumerate(CATEGORIES)]
        return spark.createDataFrame(rows, "category string, ord int, question string, citations array<string>, " + ", ".join(f"{a} string" for a in AUDIENCES))

    def matrix(self, spark: SparkSession) -> DataFrame:
        """category, audience, action: the table unpivoted."""
        return self.table(spark).unpivot(["category", "ord"], list(AUDIENCES), "audience", "action")


@dataclass(frozen=True)
class Policy:
    rules: Rules
    audience: str = "site"
    overrides: dict[str, str] = field(default_factory=dict)

    def action(self, c: str) -> str:
        return self.overrides.get(c) or self.rules.categories[c].actions[self.audience]

    def citations(self, c: str) -> list[str]:
        return list(self.rules.categories[c].citations)

    def table(self, spark: SparkSession) -> DataFrame:
        """One row for each category, to be broadcast: ten rows whatever the data."""
        rows = [(c, i, self.action(c), ACTIONS.index(self.action(c)), self.citations(c)) for i, c in enumerate(CATEGORIES)]
        return spark.createDataFrame(rows, POLICY_SCHEMA)


def effective(matrix: DataFrame, overrides: DataFrame) -> DataFrame:
    """matrix with the actions of `overrides` (category, action), which hold for any audience, in their place."""
    own = F.broadcast(overrides.select("category", F.col("action").alias("own")))
    return matrix.join(own, "category", "left").withColumn("action", F.coalesce("own", "action")).drop("own")


_LOOKAROUND = re.compile(r"\(\?(?:=|!|<=|<!|>)|\\[1-9]|\\k|\(\?P=")


def checked_pattern(name: str, pattern: str) -> str:
    """A pattern for an engine without lookaround and back references; it must compile and not match nothing."""
    if _LOOKAROUND.search(pattern):
        raise ValueError(f"identifiers.{name}: lookaround and back references are not supported")
    try:
        compiled = re.compile(pattern)
    except re.error as e:
        raise ValueError(f"identifiers.{name}: {e}") from e
    if compiled.search("") is not None:
        raise ValueError(f"identifiers.{name}: the pattern matches the empty string")
    return pattern


@dataclass(frozen=True)
class Config:
    audience: str | None = None
    identifiers: dict[str, str] = field(default_factory=dict)
    allow: Allow = field(default_factory=Allow)
    overrides: dict[str, str] = field(default_factory=dict)
    sizes: Sizes = field(default_factory=Sizes)
    #: Read for later use, without effect: no model is called.
    model: dict[str, str] = field(default_factory=dict)

    @classmethod
    def parse(cls, source: str) -> Config:
        raw = tomllib.loads(source)
        _only(raw, {"audience", "model", "identifiers", "allow", "override", "segment"}, "configuration")
        model = raw.get("model", {})
        _only(model, {"api_key_env", "on_error"}, "model")
        checked("on_error", model.get("on_error", "block"), ["block", "local-only", "warn"])
        allow, segment = raw.get("allow", {}), raw.get("segment", {})
        _only(allow, {"emails", "domains", "phones"}, "allow")
        _only(segment, {"first_min", "min", "max", "overlap"}, "segment")
        return cls(
            audience(raw["audience"]) if "audience" in raw else None,
            {k: checked_pattern(k, v) for k, v in raw.get("identifiers", {}).items()},
            Allow(*(tuple(allow.get(k, ())) for k in ("emails", "domains", "phones"))),
            {category(k): action(v) for k, v in raw.get("override", {}).items()},
            Sizes(**segment),
            {"on_error": "block", **model},
        )

    @classmethod
    def load(cls, path: str | None = None) -> Config:
        """path, or the default file if there is one, or the defaults."""
        if path is None:
            if not Path(DEFAULT_CONFIG).exists():
                return cls()
            path = DEFAULT_CONFIG
        try:
            return cls.parse(Path(path).read_text(encoding="utf-8"))
        except (OSError, ValueError) as e:
            raise ValueError(f"{path}: {e}") from e

    def policy(self, chosen: str | None = None, rules: Rules | None = None) -> Policy:
        """The argument goes before the configuration, and that before `site`."""
        return Policy(rules or Rules.builtin(), audience(chosen or self.audience or "site"), self.overrides)
