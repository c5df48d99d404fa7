"""YAML manifests as scalars with their places.

Works on parser events, not on composed nodes: aliases stay leaves whose text is the anchor's name, places are those
of the value, and a document counts only once its end has come, so that a broken one yields nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import yaml

from ..functions.patterns import SENSITIVE_KEYS

PRUNED = frozenset(("labels", "selector", "matchLabels", "envFrom"))
MAP, SEQ, TEXT, ALIAS = "map", "seq", "text", "alias"


class Node:
    """A mapping's or sequence's children in ``items`` (keys and values in turn), or a text."""

    __slots__ = ("column", "items", "kind", "line", "value")

    def __init__(self, kind: str, mark, value: str = ""):
        self.kind, self.line, self.column, self.value, self.items = kind, mark.line + 1, mark.column + 1, value, []

    def pairs(self) -> Iterator[tuple[Node, Node]]:
        return zip(self.items[::2], self.items[1::2])


@dataclass
class Found:
    """What a file gave: rows of scalars, and messages."""

    scalars: list[dict] = field(default_factory=list)
    errors: list[str] = field(default_factory=list)


def sensitive(key: str) -> bool:
    low = key.lower()
    return any(part in low for part in SENSITIVE_KEYS)


def documents(content: bytes) -> Iterator[Node | None]:
    """The root of each document (None: empty); ``yaml.YAMLError`` at the first that is broken."""
    loader = getattr(yaml, "CSafeLoader", yaml.SafeLoader)
    root, stack, anchors = None, [], set()
    for event in yaml.parse(content, Loader=loader):
        if isinstance(event, yaml.DocumentStartEvent):
            root, stack, anchors = None, [], set()
        elif isinstance(event, yaml.DocumentEndEvent):
            yield root
        elif isinstance(event, (yaml.MappingEndEvent, yaml.SequenceEndEvent)):
            stack.pop()
        elif isinstance(event, yaml.NodeEvent):
            if isinstance(event, yaml.AliasEvent):
                if event.anchor not in anchors:
                    raise yaml.YAMLError(f"unknown anchor at line {event.start_mark.line + 1}")
                node = Node(ALIAS, event.start_mark, event.anchor)
            else:
                if event.anchor:
                    anchors.add(event.anchor)
                if isinstance(event, yaml.ScalarEvent):
                    node = Node(TEXT, event.start_mark, event.value)
                else:
                    node = Node(MAP if isinstance(event, yaml.MappingStartEvent) else SEQ, event.start_mark)
            if stack:
                stack[-1].items.append(node)
            else:
                root = node
            if node.kind in (MAP, SEQ):
                stack.append(node)


def describe(root: Node) -> tuple[str, str]:
    """Kind and name; their keys in any case, the last one counts."""
    kind = name = ""
    for k, v in root.pairs():
        if k.value.lower() == "kind":
            kind = v.value
        elif k.value.lower() == "metadata" and v.kind == MAP:
            for mk, mv in v.pairs():
                if mk.value.lower() == "name":
                    name = mv.value
    return kind, name


def _row(path: str, key: str, node: Node, mode: str = "full", value: str | None = None) -> dict:
    return {"field_path": path, "key_name": key, "line": node.line, "column": node.column, "scan_mode": mode, "value": node.value if value is None else value}


def _secret(root: Node) -> Iterator[dict]:
    """Only the entries of ``data``, encoded, and ``stringData``."""
    for k, v in root.pairs():
        if k.value in ("data", "stringData") and v.kind == MAP:
            mode = "secret_data" if k.value == "data" else "full"
            for key, value in v.pairs():
                yield _row(f"{k.value}.{key.value}", key.value, value, mode)


def _general(root: Node, kind: str) -> Iterator[dict]:
    """All scalars of interest in document order; an own stack holds what is left to visit."""
    work = [(root, "", "")]
    while work:
        node, path, parent = work.pop()
        if node.kind == TEXT:
            yield _row(path, parent, node, "full" if sensitive(parent) else "jwt_only")
        elif node.kind == SEQ and parent == "env":
            for i, item in enumerate(node.items):
                if item.kind == MAP:
                    named = {k.value: v for k, v in item.pairs() if k.value in ("name", "value")}
                    if "name" in named and "value" in named and named["name"].value and named["value"].value:
                        yield _row(f"{path}[{i}].value", named["name"].value, named["value"])
        elif node.kind == SEQ:
            work += [(item, f"{path}[{i}]", parent) for i, item in reversed(list(enumerate(node.items)))]
        elif node.kind == MAP:
            later: list = []
            for k, v in node.pairs():
                if k.value in PRUNED:
                    continue
                if v.kind == MAP and (k.value == "annotations" or k.value == "data" and kind.lower() == "configmap"):
                    for key, value in v.pairs():
                        if sensitive(key.value):
                            own = f"{path}.annotations[{key.value}]" if k.value == "annotations" else f"data.{key.value}"
                            later.append(_row(own, key.value, value))
                else:
                    later.append((v, f"{path}.{k.value}" if path else k.value, k.value))
            work += reversed(later)
        if work and isinstance(work[-1], dict):
            while work and isinstance(work[-1], dict):
                yield work.pop()


def walk(content: bytes) -> Found:
    """The scalars of all documents of a file up to the first broken one."""
    found, index = Found(), 0
    try:
        for root in documents(content):
            index += 1
            if root is not None and root.kind == MAP:
                kind, name = describe(root)
                rows = _secret(root) if kind.lower() == "secret" else _general(root, kind)
                found.scalars += [r | {"doc_index": index, "kind": kind, "resource": name} for r in rows]
    except yaml.YAMLError as e:
        # the parser's own text could quote the document
        mark = getattr(e, "problem_mark", None) or getattr(e, "context_mark", None)
        found.errors.append(f"invalid YAML syntax in document {index + 1}: {'line ' + str(mark.line + 1) if mark else type(e).__name__}")
    except UnicodeDecodeError:
        found.errors.append(f"invalid YAML syntax in document {index + 1}: not UTF-8")
    return found
