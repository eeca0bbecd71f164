"""The mapping: how rows become triples. Frozen, driver-side, and small."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Literal:
    """Object: a column's value. ``iri`` makes it an IRI term (xsd:anyURI)."""

    column: str
    datatype: str | None = None
    iri: bool = False


@dataclass(frozen=True)
class Template:
    """Object: an IRI built from columns of the row itself."""

    pattern: str


@dataclass(frozen=True)
class Reference:
    """Object: the subject of ``parent``'s rows with equal keys, (child, parent) columns.
    ``total`` says that every child key exists there once, so that no join is needed."""

    parent: str
    on: tuple[tuple[str, str], ...]
    total: bool = False


@dataclass(frozen=True)
class Dispatch:
    """Class by the value of a discriminator column."""

    column: str
    classes: tuple[tuple[object, str], ...]


@dataclass(frozen=True)
class TriplesMap:
    """``table`` is a table's name or a query over the tables; ``where`` filters its rows.
    ``key`` says that no two rows have the same subject (declared or profiled), ``pair`` that none
    have the same subject and object, of a map with one object."""

    name: str
    table: str
    subject: str
    classes: tuple[str, ...] = ()
    objects: tuple[tuple[str, Literal | Template | Reference], ...] = ()
    where: str | None = None
    dispatch: Dispatch | None = None
    key: bool = False
    pair: bool = False


@dataclass(frozen=True)
class Mapping:
    maps: tuple[TriplesMap, ...]
    subclasses: tuple[tuple[str, str], ...] = ()
    inverses: tuple[tuple[str, str], ...] = ()
    #: (class, property, filler): class is equivalent to "has a property link to a filler".
    existentials: tuple[tuple[str, str, str], ...] = ()
    #: (property, class): whatever has the property, or is its value, is of the class.
    domains: tuple[tuple[str, str], ...] = ()
    ranges: tuple[tuple[str, str], ...] = ()

    def map(self, name: str) -> TriplesMap:
        return next(m for m in self.maps if m.name == name)

    def above(self, cls: str) -> set[str]:
        """The class and all its superclasses."""
        return _reached(cls, self.subclasses)

    def forms(self, prop: str) -> set[tuple[str, bool]]:
        """The properties that each link of ``prop`` also is, and whether turned round."""
        found, todo = {(prop, False)}, [(prop, False)]
        while todo:
            q, turned = todo.pop()
            new = {(b, not turned) for x, y in self.inverses for a, b in ((x, y), (y, x)) if a == q} - found
            found |= new
            todo += new
        return found

    def derived(self) -> dict[str, tuple[set[str], set[str]]]:
        """property: classes that its subjects, and its values, are of by rules."""
        out = {}
        for p in {x for pair in self.inverses for x in pair} | {p for p, _ in self.domains + self.ranges}:
            ends = (set(), set())
            for q, turned in self.forms(p):
                for side, rules in ((turned, self.domains), (not turned, self.ranges)):
                    ends[side].update(a for r, c in rules if r == q for a in self.above(c))
            if ends[0] or ends[1]:
                out[p] = ends
        return out


def _reached(start: str, edges) -> set[str]:
    found, todo = {start}, [start]
    while todo:
        c = todo.pop()
        new = {b for a, b in edges if a == c} - found
        found |= new
        todo += new
    return found
