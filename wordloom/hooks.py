"""Where models come in: label scores, romanisers, denoisers. Executors load them once a worker."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame


class LabelModel(Protocol):
    """Scores frames: rows in with ``samples``, rows out with ``frame`` and ``logp`` (and the input's keys)."""

    labels: list[str]

    def load(self) -> None: ...

    def predict(self, batch: pd.DataFrame) -> pd.DataFrame: ...


class Aligner(Protocol):
    """Words of recordings, given their transcripts."""

    def align(self, recordings: DataFrame, transcripts: DataFrame) -> DataFrame: ...


class Stitcher(Protocol):
    """Tokens of overlapping segments as one timeline, with its holes."""

    def stitch(self, tokens: DataFrame, **options) -> tuple[DataFrame, DataFrame | None]: ...


@dataclass
class Registry:
    """Named factories with aliases. A lazy entry is a function that returns the factory when it is first asked for."""

    kind: str
    entries: dict[str, Callable] = field(default_factory=dict)
    lazy: dict[str, Callable] = field(default_factory=dict)
    aliases: dict[str, str] = field(default_factory=dict)

    def register(self, name: str, factory: Callable, aliases: tuple[str, ...] = ()) -> None:
        self.entries[name] = factory
        self.aliases |= {a: name for a in aliases}

    def register_lazy(self, name: str, load: Callable[[], Callable], aliases: tuple[str, ...] = ()) -> None:
        self.lazy[name] = load
        self.aliases |= {a: name for a in aliases}

    def named(self, name: str, aliases: tuple[str, ...] = ()):
        """Decorator form of :meth:`register`."""

        def put(factory):
            self.register(name, factory, aliases)
            return factory

        return put

    def get(self, name: str, **options):
        """A new instance; an unknown name raises ValueError, a lazy one that can't be imported ImportError."""
        name = self.aliases.get(name, name)
        if name not in self.entries and name in self.lazy:
            self.entries[name] = self.lazy[name]()
        if name not in self.entries:
            raise ValueError(f"no {self.kind} {name!r}; there are {self.names()}")
        return self.entries[name](**options)

    def available(self, name: str) -> bool:
        name = self.aliases.get(name, name)
        if name in self.entries:
            return True
        try:
            self.entries[name] = self.lazy[name]()
        except (KeyError, ImportError):
            return False
        return True

    def names(self) -> list[str]:
        return sorted({*self.entries, *self.lazy})

    def __contains__(self, name: str) -> bool:
        return self.aliases.get(name, name) in {*self.entries, *self.lazy}

    def __iter__(self):
        return iter(self.names())


label_models = Registry("label model")
romanizers = Registry("romaniser")
aligners = Registry("aligner")
enhancers = Registry("enhancer")


def score_frames(segments: DataFrame, model: Callable[[], LabelModel], schema: str) -> DataFrame:
    """Label scores of segments. ``model`` builds the model; each worker builds and loads it once for all its batches."""

    def run(batches):
        held = model()
        held.load()
        for pdf in batches:
            yield held.predict(pdf)

    return segments.mapInPandas(run, schema)
