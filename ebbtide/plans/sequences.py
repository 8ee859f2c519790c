"""Target window lengths, newest first. Sequences are immutable: every iteration starts afresh."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import asdict, dataclass

MAX_LENGTH = 2**32 - 1


@dataclass(frozen=True)
class Exponential:
    """ceil(base ** k) for k = 0, 1, 2, ..."""

    base: float = 2.0

    def __post_init__(self) -> None:
        if not self.base > 1:
            raise ValueError("base must exceed 1")

    def lengths(self) -> Iterator[int]:
        x = 1.0
        while True:
            yield math.ceil(x)
            x *= self.base


@dataclass(frozen=True)
class Power:
    """R * k ** (p - 1) windows of length S * k ** q for k = 1, 2, ..."""

    p: int
    q: int
    R: int
    S: int

    def __post_init__(self) -> None:
        if min(self.p, self.R, self.S) < 1 or self.q < 0:
            raise ValueError("p, R and S must be at least 1, q at least 0")

    def lengths(self) -> Iterator[int]:
        k = 1
        while True:
            for _ in range(self.R * k ** (self.p - 1)):
                yield self.S * k**self.q
            k += 1


Sequence = Exponential | Power


def to_json(seq: Sequence) -> str:
    return json.dumps({"kind": type(seq).__name__.lower(), **asdict(seq)}, sort_keys=True)


def from_json(text: str) -> Sequence:
    d = json.loads(text)
    kind = d.pop("kind", None)
    if kind not in ("exponential", "power"):
        raise ValueError(f"unknown length sequence: {kind!r}")
    return Exponential(**d) if kind == "exponential" else Power(**d)
