"""Extensions: named expression macros, plan rules, readers, writers and sinks, found by entry points, active on request."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from importlib.metadata import EntryPoint, entry_points
from typing import Any

from .errors import ExtensionError
from .functions.expr import Expr

API_VERSION = (1, 0)
KINDS = ("function", "rule", "reader", "writer", "resolver", "sink")


@dataclass(frozen=True)
class FunctionExtension:
    """A macro: it builds a portable expression, so plans that use it need no extension to run."""

    name: str
    build: Callable[..., Expr]

    def __call__(self, *args: Any) -> Expr:
        out = self.build(*args)
        if not isinstance(out, Expr):
            raise ExtensionError(f"{self.name} built {type(out).__name__}, not an expression")
        return out


@dataclass(frozen=True)
class Plugin:
    id: str
    version: str
    #: Versions of this interface that it works with: from, up to but without.
    api: tuple[tuple[int, int], tuple[int, int]]
    register: Callable[[Extensions], None]


class Extensions:
    """What is registered; frozen before use where that must not change."""

    def __init__(self) -> None:
        self._items: dict[str, dict[str, Any]] = {k: {} for k in KINDS}
        self._frozen = False

    def add(self, kind: str, name: str, item: Any) -> None:
        if self._frozen:
            raise ExtensionError("the registry is frozen")
        if kind not in KINDS:
            raise ExtensionError(f"no kind {kind!r}")
        if not name.strip() or name in self._items[kind]:
            raise ExtensionError(f"{kind} {name!r} is taken or blank")
        self._items[kind][name] = item

    def function(self, name: str) -> FunctionExtension:
        return self.get("function", name)

    def get(self, kind: str, name: str) -> Any:
        if name not in self._items.get(kind, {}):
            raise ExtensionError(f"no {kind} {name!r}")
        return self._items[kind][name]

    def all(self, kind: str) -> tuple[Any, ...]:
        return tuple(self._items[kind].values())

    def freeze(self) -> Extensions:
        self._frozen = True
        return self


class Plugins:
    """Discovery reads metadata only; a plugin's code is imported when it is activated."""

    GROUP = "weftplan.plugins"

    def __init__(self, extensions: Extensions | None = None, found: Iterable[EntryPoint] | None = None):
        self.extensions = extensions or Extensions()
        self._found = {e.name: e for e in (entry_points(group=self.GROUP) if found is None else found)}
        self._active: dict[str, Plugin] = {}

    @property
    def available(self) -> tuple[str, ...]:
        return tuple(sorted(self._found))

    @property
    def active(self) -> tuple[str, ...]:
        return tuple(sorted(self._active))

    def activate(self, id: str) -> Plugin:
        if id in self._active:
            raise ExtensionError(f"{id!r} is active")
        if id not in self._found:
            raise ExtensionError(f"no plugin {id!r}")
        try:
            plugin = self._found[id].load()
        except Exception as e:
            raise ExtensionError(f"{id!r} cannot be imported: {e}") from e
        if not isinstance(plugin, Plugin) or plugin.id != id:
            raise ExtensionError(f"{id!r} is no plugin of that name")
        low, high = plugin.api
        if not low <= API_VERSION < high:
            raise ExtensionError(f"{id!r} works with {low} to {high}, not {API_VERSION}")
        plugin.register(self.extensions)
        self._active[id] = plugin
        return plugin
