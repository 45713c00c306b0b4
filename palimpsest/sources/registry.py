"""Formats by name, and stacks of content filters: what a user extends without changing the package."""

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column


@dataclass
class Registry:
    """Entries by name; an entry may be a function that makes it, called once when it is first asked for."""

    what: str
    made: dict[str, Any] = field(default_factory=dict)
    lazy: dict[str, Callable[[], Any]] = field(default_factory=dict)
    default: str | None = None

    def add(self, name: str, entry: Any) -> None:
        if name in self.made or name in self.lazy:
            raise ValueError(f"{self.what} {name} is there")
        self.made[name] = entry

    def add_lazy(self, name: str, make: Callable[[], Any]) -> None:
        if name in self.made or name in self.lazy:
            raise ValueError(f"{self.what} {name} is there")
        self.lazy[name] = make

    def remove(self, name: str) -> None:
        self.made.pop(name, None)
        self.lazy.pop(name, None)

    def names(self) -> list[str]:
        return sorted({*self.made, *self.lazy})

    def get(self, name: str | None = None) -> Any:
        name = self.default if name is None else name
        if name not in self.made:
            if name not in self.lazy:
                raise KeyError(f"no {self.what} {name}; there are {', '.join(self.names())}")
            self.made[name] = self.lazy[name]()
        return self.made[name]


@dataclass(frozen=True)
class Filter:
    """A pair of column functions: what a text becomes when it is read into a tree, and when it is written to the store."""

    name: str
    read: Callable[[Column], Column]
    write: Callable[[Column], Column]


def reading(text: Column, filters: list[Filter]) -> Column:
    """A stored text as the tree shows it: the filters' readers, first to last; all stay one JVM expression."""
    for f in filters:
        text = f.read(text)
    return text


def writing(text: Column, filters: list[Filter]) -> Column:
    """A tree's text as the store keeps it: the filters' writers, last to first."""
    for f in reversed(filters):
        text = f.write(text)
    return text


def line_ends() -> Filter:
    """CR LF in the tree, LF in the store."""
    from pyspark.sql import functions as F

    return Filter("crlf", lambda t: F.regexp_replace(t, r"(?<!\r)\n", "\r\n"), lambda t: F.replace(t, F.lit("\r\n"), F.lit("\n")))


def codecs() -> Registry:
    """(parse, build) of every format of the store, by name."""
    from palimpsest.sources import formats, pages, records, wire

    r = Registry("format")
    for name, pair in {
        "graph-index": (formats.parse_graph_index, formats.graph_index_bytes), "paged-index": (pages.parse_paged_index, pages.paged_index_bytes), "container": (formats.parse_container, formats.container_bytes),
        "stanzas": (formats.parse_stanzas, formats.stanza_bytes), "state": (formats.parse_state, formats.state_bytes), "inventory-delta": (formats.parse_inventory_delta, formats.inventory_delta_bytes), "entry": (formats.parse_entry, formats.entry_text),
        "bencode": (formats.bdecode, formats.bencode), "text-record": (records.parse_text_record, records.text_record), "record-index": (records.parse_record_index, records.record_index_rows), "weave": (records.parse_weave_file, records.weave_file),
        "multi-parent": (records.parse_multi_parent, records.multi_parent_text), "byte-delta": (records.apply_binary_delta, records.binary_delta), "stat-cache": (records.parse_stat_cache, records.stat_cache), "revision-xml": (records.parse_revision_xml, records.revision_xml),
        "inventory-xml": (records.parse_inventory_xml, records.inventory_xml), "patch-lines": (records.parse_patch_lines, records.patch_lines), "wire-record": (wire.parse_record, wire.record), "wire-closure": (wire.parse_closure, wire.closure), "wire-block": (wire.parse_block, wire.block),
    }.items():
        r.add(name, pair)
    return r
