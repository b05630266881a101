"""The node map of a page: which nodes there are, their paths, and how it changes as nodes come and go."""

from __future__ import annotations

from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import dom
from .batches import bound

NODE = "array<struct<id:int,parent:int,tag:string,xpath:string,depth:int>>"


@dataclass
class NodeMap:
    """Paths by node id. A first sibling has no index while it is built, because no other is known yet; removal renumbers nothing."""

    paths: dict[int, str] = field(default_factory=dict)
    tags: dict[int, str] = field(default_factory=dict)
    parents: dict[int, int] = field(default_factory=dict)
    children: dict[int, list[int]] = field(default_factory=dict)

    def insert(self, node: int, tag: str, parent: int | None = None, shadow: bool = False) -> None:
        base = self.paths.get(parent, "") if parent is not None else ""
        same = [c for c in self.children.get(parent, []) if self.tags[c] == tag]
        index = f"[{len(same) + 1}]" if same else ""
        self.paths[node] = f"{base}{'/shadow-root' if shadow else ''}/{tag}{index}"
        self.tags[node] = tag
        if parent is not None:
            self.parents[node] = parent
            self.children.setdefault(parent, []).append(node)

    def remove(self, node: int) -> None:
        for c in self.children.pop(node, []):
            self.remove(c)
        if (p := self.parents.pop(node, None)) is not None and node in self.children.get(p, []):
            self.children[p].remove(node)
        self.paths.pop(node, None)
        self.tags.pop(node, None)

    def path(self, node: int) -> str:
        return self.paths.get(node, f"/unknown[nodeId={node}]")


def nodes_of(html: str) -> list[dict]:
    ids: dict[int, int] = {}
    out = []
    for n in dom.parse(html).elements():
        if n.tag == "#document":
            continue
        ids[id(n)] = len(ids)
        path = dom.path_of(n)
        out.append({"id": ids[id(n)], "parent": ids.get(id(n.parent), -1), "tag": n.tag, "xpath": path, "depth": path.count("/")})
    return out


def nodes_column(html: Column | str) -> Column:
    """array<struct<id, parent, tag, xpath, depth>> of a page's elements in document order."""

    bound()

    @F.pandas_udf(NODE)
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else nodes_of(x))

    return run(html)
