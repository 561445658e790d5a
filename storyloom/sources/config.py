"""Settings from the environment. A service is on when all its settings are there; half of them is an error."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass


class InvalidConfig(ValueError):
    """Settings that contradict one another."""


@dataclass(frozen=True)
class Service:
    url: str
    key: str
    model: str = ""


@dataclass(frozen=True)
class Pricing:
    input_per_million: float
    output_per_million: float

    def cost(self, input_tokens: int, output_tokens: int) -> float:
        return (input_tokens * self.input_per_million + output_tokens * self.output_per_million) / 1e6


@dataclass(frozen=True)
class Config:
    chat: Service | None = None
    judge: Service | None = None
    embedding: Service | None = None
    knowledge: Service | None = None
    pricing: Pricing | None = None
    parallel: int = 1
    stale_seconds: float = 60.0


def _service(env: Mapping[str, str], prefix: str, with_model: bool = True) -> Service | None:
    names = [f"{prefix}_URL", f"{prefix}_KEY", *([f"{prefix}_MODEL"] if with_model else [])]
    told = [env.get(n, "").strip() for n in names]
    if not any(told):
        return None
    if not all(told):
        raise InvalidConfig(f"missing: {', '.join(n for n, v in zip(names, told, strict=True) if not v)}")
    return Service(*told)


def _number(env: Mapping[str, str], name: str, default: float | None) -> float | None:
    told = env.get(name, "").strip()
    if not told:
        return default
    try:
        value = float(told)
    except ValueError:
        value = -1.0
    if not 0 <= value < float("inf"):
        raise InvalidConfig(f"{name} is no number of 0 or more: {told!r}")
    return value


def load(env: Mapping[str, str]) -> Config:
    low, high = _number(env, "PRICE_INPUT", None), _number(env, "PRICE_OUTPUT", None)
    if (low is None) != (high is None):
        raise InvalidConfig("PRICE_INPUT and PRICE_OUTPUT belong together")
    parallel = _number(env, "PARALLEL", 1)
    if parallel != int(parallel) or parallel < 1:
        raise InvalidConfig("PARALLEL is no whole number of 1 or more")
    return Config(
        _service(env, "CHAT"),
        _service(env, "JUDGE"),
        _service(env, "EMBEDDING"),
        _service(env, "KNOWLEDGE", False),
        None if low is None else Pricing(low, high),
        int(parallel),
        _number(env, "STALE_SECONDS", 60.0),
    )
