"""Adapters: what turns records of a dialect into spans, and the choice among them."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from typing import Any, Protocol

from ..schema import AdapterSelectionError, UnknownAdapterError

SAMPLE = 50
LEAST_CONFIDENCE = 0.5


class Adapter(Protocol):
    id: str
    version: str

    def detect(self, sample: Sequence[Any]) -> float:
        """How sure it is, 0 to 1, that the records are of its dialect. Must not raise."""

    def parse(self, records: Iterable[Any]) -> Iterable[dict]:
        """A dict of span columns for each record, in order."""


class Registry:
    def __init__(self) -> None:
        self._adapters: dict[str, Adapter] = {}

    def register(self, adapter: Adapter) -> Adapter:
        known = self._adapters.setdefault(adapter.id, adapter)
        if known is not adapter:
            raise AdapterSelectionError(f"another adapter has the id {adapter.id!r}", "duplicate_adapter_id")
        return adapter

    def registered(self) -> tuple[Adapter, ...]:
        return tuple(self._adapters[k] for k in sorted(self._adapters))

    def get(self, adapter_id: str) -> Adapter:
        if adapter_id not in self._adapters:
            raise UnknownAdapterError(f"no adapter {adapter_id!r}; there are: {', '.join(sorted(self._adapters)) or 'none'}", "unknown_adapter")
        return self._adapters[adapter_id]

    def confidences(self, sample: Sequence[Any]) -> dict[str, float]:
        out = {}
        for adapter in self.registered():
            try:
                out[adapter.id] = float(adapter.detect(sample))
            except Exception as error:
                raise AdapterSelectionError(f"adapter {adapter.id!r} failed to look at the records: {error}", "adapter_detect_failed") from error
        return out

    def detect(self, records: Sequence[Any]) -> tuple[Adapter, float]:
        """The one adapter that is surest of the first SAMPLE records, or a refusal."""
        if not self._adapters:
            raise AdapterSelectionError("there is no adapter to choose from", "no_adapters_registered")
        found = self.confidences(records[:SAMPLE])
        top = max(found.values())
        if top < LEAST_CONFIDENCE:
            raise AdapterSelectionError(f"no adapter is sure of these records: {found}", "adapter_unconfident")
        best = [k for k, v in found.items() if v == top]
        if len(best) > 1:
            raise AdapterSelectionError(f"adapters {best} are equally sure", "adapter_ambiguous")
        return self._adapters[best[0]], top


default = Registry()
