"""Configurable components: what they are and how they are set, as hashes; changed copies instead of changes in place."""

from __future__ import annotations

import copy
import hashlib
import inspect
from dataclasses import fields, is_dataclass
from typing import Any


def _tree(x: Any) -> Any:
    """A value as text that only depends on its content: components and data by class and settings, functions by name."""
    if isinstance(x, dict):
        return sorted((str(k), _tree(v)) for k, v in x.items())
    if isinstance(x, (list, tuple, set)):
        return [_tree(v) for v in (sorted(x, key=str) if isinstance(x, set) else x)]
    if is_dataclass(x) and not isinstance(x, type):
        return [type(x).__qualname__, *((f.name, _tree(getattr(x, f.name))) for f in fields(x))]
    if inspect.isclass(x) or inspect.isroutine(x):
        return f"{x.__module__}.{x.__qualname__}"
    if hasattr(x, "__dict__"):
        return [type(x).__qualname__, _tree(settings(x))]
    return repr(x)


def settings(component: Any) -> dict[str, Any]:
    """The arguments a component was made with, as far as it keeps them under their names."""
    names = [n for n in inspect.signature(type(component).__init__).parameters if n != "self"]
    return {n: getattr(component, n) for n in names if hasattr(component, n)}


def identity_hash(component: Any) -> str:
    """Equal for components of one class, however they are set."""
    return hashlib.sha256(repr([type(component).__module__, type(component).__qualname__]).encode()).hexdigest()


def settings_hash(component: Any) -> str:
    """Equal for components of one class with equal settings."""
    return hashlib.sha256(repr([type(component).__module__, _tree(component) if is_dataclass(component) else [type(component).__qualname__, _tree(settings(component))]]).encode()).hexdigest()


def configured(component: Any, **changes: Any) -> Any:
    """A copy with other settings; all or none are taken."""
    known = inspect.signature(type(component).__init__).parameters
    lost = [n for n in changes if n not in known]
    if lost:
        raise TypeError(f"{type(component).__name__} has no {', '.join(lost)}")
    return type(component)(**{n: copy.deepcopy(v) for n, v in settings(component).items()} | changes)
