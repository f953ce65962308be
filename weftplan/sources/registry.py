"""Readers and writers by URI scheme."""

from __future__ import annotations

from collections.abc import Callable

from ..errors import ExtensionError, ResourceError
from .files import read_file, write_file


class Registry:
    def __init__(self, **known: Callable):
        self._known, self._frozen = dict(known), False

    def register(self, scheme: str, handler: Callable) -> None:
        if self._frozen:
            raise ExtensionError("the registry is frozen")
        if scheme in self._known:
            raise ExtensionError(f"{scheme!r} is registered")
        self._known[scheme] = handler

    def get(self, scheme: str) -> Callable:
        if scheme not in self._known:
            raise ResourceError(f"nothing is registered for {scheme!r}")
        return self._known[scheme]

    def freeze(self) -> Registry:
        self._frozen = True
        return self

    @property
    def schemes(self) -> tuple[str, ...]:
        return tuple(sorted(self._known))


READERS, WRITERS = Registry(file=read_file), Registry(file=write_file)
