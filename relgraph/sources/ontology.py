"""Ontologies in RDF/XML or OWL/XML: classes, hierarchy, properties, inverses, equivalences.

An ontology is small next to its data: it is parsed on the driver into rows, and looked up as
DataFrames (``operators.ontology``). Names are local names with ``:`` in front.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections import Counter
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

_RDF = "{http://www.w3.org/1999/02/22-rdf-syntax-ns#}"
_RDFS = "{http://www.w3.org/2000/01/rdf-schema#}"
_OWL = "{http://www.w3.org/2002/07/owl#}"
_XML = "{http://www.w3.org/XML/1998/namespace}"


@dataclass
class Ontology:
    base: str = ""
    classes: set[str] = field(default_factory=set)
    subclasses: set[tuple[str, str]] = field(default_factory=set)
    #: property → kind, domains, ranges
    properties: dict[str, tuple[str, set[str], set[str]]] = field(default_factory=dict)
    inverses: set[tuple[str, str]] = field(default_factory=set)
    #: (class, property, filler)
    existentials: set[tuple[str, str, str]] = field(default_factory=set)

    def frames(self, spark: SparkSession) -> dict[str, DataFrame]:
        """``classes``, ``subclasses``, ``properties``, ``inverses`` and ``existentials``; a
        property has a row for each of its domains and ranges."""
        props = [(p, kind, d, r) for p, (kind, ds, rs) in self.properties.items() for d in sorted(ds) or [None] for r in sorted(rs) or [None]]
        return {
            "classes": spark.createDataFrame([(c,) for c in sorted(self.classes)], "class string"),
            "subclasses": spark.createDataFrame(sorted(self.subclasses), "child string, parent string"),
            "properties": spark.createDataFrame(sorted(props, key=str), "property string, kind string, domain string, range string"),
            "inverses": spark.createDataFrame(sorted(self.inverses), "a string, b string"),
            "existentials": spark.createDataFrame(sorted(self.existentials), "class string, property string, filler string"),
        }


def name_of(iri: str) -> str:
    """``:local`` of an entity, ``xsd:local`` of a data type."""
    local = re.split(r"[#/]", iri.rstrip("#/"))[-1].split(":")[-1]
    return f"xsd:{local}" if "XMLSchema" in iri or iri.startswith("xsd:") else f":{local}"


def base_of(root: ET.Element) -> str:
    """The namespace of the ontology's names: that of an empty prefix, else the ontology's IRI,
    else xml:base, else the most frequent one of its entities."""
    for e in root.iter():
        if e.tag == f"{_OWL}Prefix" and e.get("name") == "" and e.get("IRI"):
            return e.get("IRI")
    iri = root.get("ontologyIRI") or next((e.get(f"{_RDF}about") for e in root.iter(f"{_OWL}Ontology") if e.get(f"{_RDF}about")), None) or root.get(f"{_XML}base")
    if iri:
        return iri if iri.endswith(("#", "/")) else iri + "#"
    spaces = Counter(m[1] for e in root.iter() for v in e.attrib.values() if (m := re.match(r"(.*[#/])[^#/]+$", v)) and "www.w3.org" not in m[1])
    return spaces.most_common(1)[0][0] if spaces else ""


def read_ontology(text: str) -> Ontology:
    root = ET.fromstring(text)
    o = Ontology(base_of(root))
    (_rdf_xml if root.tag == f"{_RDF}RDF" else _owl_xml)(root, o)
    o.classes |= {c for pair in o.subclasses for c in pair}
    o.classes.discard(":Thing")
    o.subclasses = {(a, b) for a, b in o.subclasses if ":Thing" not in (a, b)}
    return o


def _property(o: Ontology, iri: str, kind: str) -> tuple[str, set[str], set[str]]:
    return o.properties.setdefault(name_of(iri), (kind, set(), set()))


def _about(e: ET.Element) -> str | None:
    return e.get(f"{_RDF}about") or e.get(f"{_RDF}ID") or e.get(f"{_RDF}resource")


def _named(e: ET.Element) -> list[str]:
    """The classes that an element names: itself, or the members of a union in it."""
    if iri := _about(e):
        return [name_of(iri)]
    return [name_of(iri) for u in e.iter(f"{_OWL}unionOf") for m in u if (iri := _about(m))] or [name_of(iri) for c in e.findall(f"{_OWL}Class") if (iri := _about(c))]


def _rdf_xml(root: ET.Element, o: Ontology) -> None:
    for e in root:
        iri = _about(e)
        if not iri:
            continue
        if e.tag == f"{_OWL}Class":
            c = name_of(iri)
            o.classes.add(c)
            for s in e.findall(f"{_RDFS}subClassOf"):
                o.subclasses |= {(c, d) for d in _named(s) if not s.findall(f"{_OWL}Restriction")}
            for q in e.findall(f"{_OWL}equivalentClass"):
                for r in q.iter(f"{_OWL}Restriction"):
                    on, some = r.find(f"{_OWL}onProperty"), r.find(f"{_OWL}someValuesFrom")
                    if on is not None and some is not None and _named(some):
                        o.existentials.add((c, name_of(_about(on)), _named(some)[0]))
        elif e.tag in (f"{_OWL}DatatypeProperty", f"{_OWL}ObjectProperty", f"{_OWL}FunctionalProperty"):
            kind = "data" if e.tag == f"{_OWL}DatatypeProperty" or any("DatatypeProperty" in (t.get(f"{_RDF}resource") or "") for t in e.findall(f"{_RDF}type")) else "object"
            _, domains, ranges = _property(o, iri, kind)
            for d in e.findall(f"{_RDFS}domain"):
                domains.update(_named(d))
            for r in e.findall(f"{_RDFS}range"):
                ranges.update(_named(r))
            for i in e.findall(f"{_OWL}inverseOf"):
                if target := _about(i) or next((_about(x) for x in i), None):
                    o.inverses.add(tuple(sorted((name_of(iri), name_of(target)))))


def _owl_xml(root: ET.Element, o: Ontology) -> None:
    def iri(e: ET.Element) -> str:
        return e.get("IRI") or e.get("abbreviatedIRI") or ""

    def kind(e: ET.Element) -> str:
        return e.tag.removeprefix(_OWL)

    def members(e: ET.Element) -> list[str]:
        return [name_of(iri(x)) for x in e.iter() if kind(x) in ("Class", "Datatype") and iri(x)]

    for e in root:
        parts = list(e)
        match kind(e):
            case "Declaration":
                for x in parts:
                    if kind(x) == "Class":
                        o.classes.add(name_of(iri(x)))
                    elif kind(x) in ("DataProperty", "ObjectProperty"):
                        _property(o, iri(x), "data" if kind(x) == "DataProperty" else "object")
            case "SubClassOf" if len(parts) == 2 and all(kind(x) == "Class" for x in parts):
                o.subclasses.add((name_of(iri(parts[0])), name_of(iri(parts[1]))))
            case "EquivalentClasses":
                own = [x for x in parts if kind(x) == "Class"]
                for x in e.iter(f"{_OWL}ObjectSomeValuesFrom"):
                    p, d = list(x)[:2]
                    if own and iri(p) and iri(d):
                        o.existentials.add((name_of(iri(own[0])), name_of(iri(p)), name_of(iri(d))))
            case "DataPropertyDomain" | "ObjectPropertyDomain" | "DataPropertyRange" | "ObjectPropertyRange" as what:
                _, domains, ranges = _property(o, iri(parts[0]), "data" if what.startswith("Data") else "object")
                (domains if what.endswith("Domain") else ranges).update(members(parts[1]))
            case "InverseObjectProperties":
                o.inverses.add(tuple(sorted(name_of(iri(x)) for x in parts[:2])))
