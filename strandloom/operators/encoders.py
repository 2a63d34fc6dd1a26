"""The place where models plug in: encoders of frames, by name, run over Arrow batches; a hash stands in for tests."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


class Encoder(Protocol):
    """Loaded once in a task; encode() takes a batch's keys and gives one vector for each."""

    width: int

    def encode(self, keys: pd.Series) -> list[list[float]]: ...


class HashEncoder:
    """Unit vectors from a hash of the key: the same for the same key everywhere."""

    def __init__(self, width: int = 64, seed: int = 0):
        self.width, self.seed = width, seed

    def encode(self, keys: pd.Series) -> list[list[float]]:
        out = []
        for k in keys:
            rng = np.random.default_rng(int.from_bytes(hashlib.sha256(f"{self.seed}:{k}".encode()).digest()[:8], "big"))
            x = rng.normal(size=self.width)
            out.append((x / np.linalg.norm(x)).tolist())
        return out


_MAKERS: dict[str, Callable[[], Encoder]] = {"hash": HashEncoder}


def register(name: str, make: Callable[[], Encoder]) -> None:
    _MAKERS[name] = make


def encoded(rows: DataFrame, key: str, name: str = "hash", column: str = "vec") -> DataFrame:
    """rows' key with the encoder's vector; filter first, as filters don't move below a Python stage."""
    make = _MAKERS[name]
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = make()
        for pdf in batches:
            yield pdf.assign(**{column: encoder.encode(pdf[key])})

    return rows.select(key).mapInPandas(run, f"`{key}` {kind}, `{column}` array<double>")
