"""Fingerprints of functions: what they do, what they enclose, and a check of what else they read."""

from __future__ import annotations

import dis
import hashlib
import inspect
import re
import sys
import types
from collections.abc import Callable, Iterable
from typing import Any

from pyspark.sql import SparkSession


class UndeclaredNonLocals(ValueError):
    """A function reads outside variables that nothing tracks."""


def unwrapped(function: Callable) -> Callable:
    """The function that an adapter calls, where the adapter names it; of a Spark UDF the Python function in it."""
    seen = getattr(function, "__tracked_function__", function)
    inner = getattr(seen, "func", None)
    return unwrapped(inner) if callable(inner) and hasattr(seen, "returnType") else seen


def tracks(inner: Callable) -> Callable[[Callable], Callable]:
    """Decorator for adapters: fingerprint ``inner`` in their place."""

    def mark(outer: Callable) -> Callable:
        outer.__tracked_function__ = unwrapped(inner)
        return outer

    return mark


def shown(value: Any, above: tuple[int, ...] = ()) -> str:
    """Text of an enclosed value, the same in each process: sets and mappings sorted, no addresses.

    A function, also one in a UDF or bound to an object, stands with its byte code and what it encloses in turn.
    """
    if id(value) in above:
        return "itself"
    inside = (*above, id(value))
    if isinstance(value, dict):
        return "{" + ", ".join(sorted(f"{shown(k, inside)}: {shown(v, inside)}" for k, v in value.items())) + "}"
    if isinstance(value, (set, frozenset)):
        return "{" + ", ".join(sorted(shown(v, inside) for v in value)) + "}"
    if isinstance(value, (list, tuple)):
        return "[" + ", ".join(shown(v, inside) for v in value) + "]"
    if isinstance(value, types.ModuleType):
        return value.__name__
    inner = unwrapped(value) if callable(value) else value
    inner = getattr(inner, "__func__", inner)
    if isinstance(inner, types.FunctionType):
        more = getattr(value, "returnType", "")
        return f"{instructions(inner.__code__)} {more} {sorted(enclosed(inner, inside).items())}"
    return re.sub(r" at 0x[0-9a-fA-F]+", "", repr(value))


def instructions(code: types.CodeType) -> str:
    """A function's byte code as text without lines, offsets and addresses; inner functions stand in full."""
    out = []
    for i in dis.get_instructions(code):
        arg = instructions(i.argval) if isinstance(i.argval, types.CodeType) else i.argrepr
        out.append(f"{i.opname} {re.sub(r' at 0x[0-9a-fA-F]+', '', arg)}".rstrip())
    return "\n".join(out)


def enclosed(function: Callable, above: tuple[int, ...] = ()) -> dict[str, str]:
    """Variables that a function encloses, but for ``self``; its default values count as well."""
    inner = inspect.unwrap(unwrapped(function))
    inner = getattr(inner, "__func__", inner)
    cells = zip(inner.__code__.co_freevars, inner.__closure__ or (), strict=False)
    found = {}
    for name, cell in cells:
        if name != "self":
            try:
                found[name] = shown(cell.cell_contents, above)
            except ValueError:  # not bound yet
                found[name] = "unbound"
    for i, value in enumerate(inner.__defaults__ or ()):
        found[f"default {i}"] = shown(value, above)
    for name, value in sorted((inner.__kwdefaults__ or {}).items()):
        found[f"default {name}"] = shown(value, above)
    return found


def function_digest(function: Callable, allowed: Iterable[str] = ()) -> dict[str, str]:
    """{source, python, code, closure}: hashes of the text, of the byte code under this Python, and of what is enclosed,
    with the values of ``allowed`` outside constants."""
    inner = unwrapped(function)
    if isinstance(inner, (types.BuiltinFunctionType, type)) or not hasattr(inner, "__code__"):
        text = inner.__qualname__ if hasattr(inner, "__qualname__") else type(inner).__qualname__
        return {"source": text, "python": "", "code": "", "closure": ""}
    try:
        source = inspect.cleandoc(inspect.getsource(inner))
    except (OSError, TypeError):
        source = instructions(inner.__code__)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return {"source": sha(source), "python": f"{sys.version_info.major}.{sys.version_info.minor}", "code": sha(instructions(inner.__code__)), "closure": sha(repr(sorted((enclosed(inner) | allowed_values(inner, allowed)).items())))}


def same_function(old: dict[str, str], new: dict[str, str]) -> bool:
    """By byte code and closure if both come from one version of Python, else by source and closure."""
    what = "code" if old["python"] == new["python"] and new["code"] else "source"
    return old[what] == new[what] and old["closure"] == new["closure"]


def globals_read(code: types.CodeType) -> set[str]:
    """Names that code, or any function, comprehension or class nested in it, takes from its module.

    A nested function's enclosed names aren't among them: they are bound in a function around it. A class body reads a name
    of its module where it hasn't bound it before.
    """
    found, bound = set(), {"__name__"}  # a class body starts with its module's name
    for i in dis.get_instructions(code):
        if i.opname == "STORE_NAME":
            bound.add(i.argval)
        elif i.opname in ("LOAD_GLOBAL", "LOAD_FROM_DICT_OR_GLOBALS") or i.opname == "LOAD_NAME" and i.argval not in bound:
            found.add(i.argval)
    for inner in code.co_consts:
        if isinstance(inner, types.CodeType):
            found |= globals_read(inner)
    return found


def outside(function: Callable) -> dict[str, Any]:
    """Variables that a function, or code nested in it, reads from its module or encloses; built-in names aside."""
    inner = inspect.unwrap(unwrapped(function))
    inner = getattr(inner, "__func__", inner)
    if not hasattr(inner, "__code__"):
        return {}
    found = {name: inner.__globals__[name] for name in sorted(globals_read(inner.__code__)) if name in inner.__globals__}
    for name, cell in zip(inner.__code__.co_freevars, inner.__closure__ or (), strict=False):
        try:
            found[name] = cell.cell_contents
        except ValueError:  # not bound yet
            continue
    return found


def constant(value: Any) -> bool:
    """Numbers, texts, bytes, None, and tuples and frozen sets of them."""
    return value is None or isinstance(value, (bool, int, float, complex, str, bytes)) or isinstance(value, (tuple, frozenset)) and all(map(constant, value))


def allowed_values(function: Callable, allowed: Iterable[str]) -> dict[str, str]:
    """Of the outside variables that are allowed, those that are constants, as text: a function's fingerprint holds them."""
    return {name: shown(value) for name, value in outside(function).items() if name in set(allowed) and constant(value)}


def check_non_locals(function: Callable, allowed: Iterable[str] = ()) -> None:
    """Fail if a function, or code nested in it, reads outside variables other than modules, functions, classes, jobs, the
    Spark session, and those in ``allowed``."""
    may = set(allowed)
    odd = [
        name
        for name, value in outside(function).items()
        if name not in may and not (isinstance(value, (types.ModuleType, type, SparkSession)) or callable(value) or hasattr(value, "job_id"))
    ]
    if odd:
        raise UndeclaredNonLocals(f"{getattr(unwrapped(function), '__qualname__', function)} reads {', '.join(odd)}; declare them as parameters or allow them")
