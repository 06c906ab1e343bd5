"""Commands over stores: ``python -m tesseral.cli dump|tree|repack PATH ...``."""

from __future__ import annotations

import argparse
from typing import TextIO

from pyspark.sql import SparkSession

from .operators.table import Table
from .sources.catalog import Group, Link, Store, open_store
from .sources.filters import Filters


def dump(store: Store, where: str = "/", out: TextIO | None = None, data: bool = False, attrs: bool = False, colinfo: bool = False, idxinfo: bool = False, start=None, stop=None, step=None) -> None:
    for node in store.walk_nodes(where):
        print(node, file=out)
        if attrs:
            for n in node.attrs.names("all"):
                print(f"    {n} := {node.attrs[n]!r}", file=out)
        if isinstance(node, (Group, Link)):
            continue
        d = node.data()
        if isinstance(d, Table):
            if colinfo:
                for f in d.schema.fields:
                    print(f"    {f.name}: {f.metadata.get('type', f.dataType.simpleString())}", file=out)
            if idxinfo:
                for p, i in d.indexes.items():
                    print(f"    index of {p}: {i.kind}, level {i.optlevel}", file=out)
            if data:
                for r in d.iterrows(start, stop, step):
                    print(f"    [{r['nrow']}] {tuple(v for k, v in r.asDict().items() if k != 'nrow')}", file=out)
        elif data:
            for k, r in enumerate(d.iterrows()):
                print(f"    [{k}] {r}", file=out)


def tree(store: Store, where: str = "/", out: TextIO | None = None) -> list[tuple[str, str, int, float]]:
    """(path, kind, bytes on disk, per cent of the whole) of every node, printed as a tree."""
    nodes = list(store.walk_nodes(where))
    own = {n.path: store._size(store._entry(n.path)) for n in nodes}
    total = {p: sum(s for q, s in own.items() if q == p or q.startswith(p.rstrip("/") + "/")) for p in own}
    whole = max(total.get(where, 0), 1)
    rows = []
    for n in sorted(nodes, key=lambda n: n.path.split("/")):
        rows.append((n.path, n.kind, total[n.path], 100 * total[n.path] / whole))
        print("  " * n.depth + f"{n.name} ({n.kind}) {total[n.path]} bytes, {rows[-1][3]:.1f} %", file=out)
    return rows


def repack(src: Store, dst: Store, where: str = "/", to: str = "/", start=None, stop=None, step=None, filters: Filters | None = None, sortby: str | None = None, check_csi: bool = False, propindexes: bool = False, overwrite: bool = False) -> int:
    """Copies a subtree, its tables by slice, order and filters; returns the number of nodes."""
    n = 0
    for node in src.walk_nodes(where):
        rel = node.path[len(where.rstrip("/")) :]
        path = (to.rstrip("/") + rel) or "/"
        parent, _, name = path.rstrip("/").rpartition("/")
        parent = parent or "/"
        if not name:
            continue
        if path in dst:
            if not overwrite:
                raise ValueError(f"{path} exists already")
            if not isinstance(node, Group):
                dst.remove_node(path, recursive=True)
        if isinstance(node, Group):
            if path not in dst:
                dst.create_group(parent, name, node.title, createparents=True)
        elif isinstance(node, Link):
            (dst.create_soft_link if node.kind == "soft" else dst.create_external_link)(parent, name, node.target, createparents=True)
        else:
            d = node.data()
            if isinstance(d, Table):
                by = sortby if sortby in d.indexes else None
                dst.create_table(parent, name, obj=d.copy(start, stop, step, by, check_csi, propindexes), title=node.title, filters=filters, createparents=True)
            elif node.kind == "vlarray":
                dst.create_vlarray(parent, name, d, title=node.title, filters=filters, createparents=True)
            else:
                dst._array(parent, name, node.kind, d, node.title, filters, True)
        new = dst.get_node(path)
        for a in node.attrs.names("user"):
            new.attrs[a] = node.attrs[a]
        n += 1
    return n


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="tesseral")
    sub = p.add_subparsers(dest="what", required=True)
    d = sub.add_parser("dump")
    t = sub.add_parser("tree")
    r = sub.add_parser("repack")
    for x in (d, t, r):
        x.add_argument("path")
        x.add_argument("--where", default="/")
    for flag in ("data", "attrs", "colinfo", "idxinfo"):
        d.add_argument(f"--{flag}", action="store_true")
    r.add_argument("to")
    r.add_argument("--sortby")
    r.add_argument("--complevel", type=int, default=0)
    r.add_argument("--complib", default="zlib")
    r.add_argument("--propindexes", action="store_true")
    r.add_argument("--overwrite", action="store_true")
    for x in (d, r):
        for n in ("start", "stop", "step"):
            x.add_argument(f"--{n}", type=int)
    a = p.parse_args(args)
    spark = SparkSession.builder.appName("tesseral").getOrCreate()
    with open_store(spark, a.path) as s:
        if a.what == "dump":
            dump(s, a.where, None, a.data, a.attrs, a.colinfo, a.idxinfo, a.start, a.stop, a.step)
        elif a.what == "tree":
            tree(s, a.where)
        else:
            with open_store(spark, a.to, "a") as to:
                repack(s, to, a.where, "/", a.start, a.stop, a.step, Filters(a.complevel, a.complib), a.sortby, False, a.propindexes, a.overwrite)


if __name__ == "__main__":
    main()
