"""What a mapping should give, asked of the graph that it gives: seven kinds of expectations as one
relation, each PASS, WARN, FAIL or SKIP, and the mending of links and inverses that are missing.

Expectations come from the ontology (subclasses; properties with domain and range; existentials;
inverses) and the catalog: which class a table has, what refers to what, which tables are bridges.
The graph is read once, for how many instances a class has and how many of them have each property.

- type: each table's class has instances, else FAIL.
- property: instances of the class have its data properties, else WARN.
- link: they have the object properties whose domain is the class, above or below it, else WARN
  where the table refers to the range's table or a bridge joins the two, SKIP where nothing does.
- weak: the owner of a weak table has the property that the table became, else WARN.
- hidden: a class by flag or discriminator has instances and is related to its table's class, else WARN.
- equivalent: of `C = some p D`, C, D and p are there, else FAIL where p's ends can be joined, or SKIP.
- inverse: if one of a pair is there, so is the other, else WARN; pairs of which none is there are no
  expectation.

Defined cases: an empty graph fails all types; tables without a class and properties without a
domain are not asked for.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relgraph.functions.terms import RDF_TYPE
from relgraph.operators.ontology import inverse_pairs, related
from relgraph.plans.mapping import Mapping, Reference
from relgraph.shared import stored

TESTS = ["kind", "class", "property", "other", "n", "state"]


def usage(graph: DataFrame) -> DataFrame:
    """(class, property, n): instances of each class, with a null property, and of these the ones
    that have each property; a null class is any."""
    types = graph.where(F.col("p") == RDF_TYPE).select("s", F.col("o").alias("class")).distinct()
    has = graph.where(F.col("p") != RDF_TYPE).select("s", F.col("p").alias("property")).distinct()
    none = F.lit(None).cast("string")
    counts = types.groupBy("class").agg(F.count("*").alias("n")).select("class", none.alias("property"), "n")
    by_class = has.join(types, "s").groupBy("class", "property").agg(F.count("*").alias("n"))
    alone = has.groupBy("property").agg(F.count("*").alias("n")).select(none.alias("class"), "property", "n")
    return counts.unionByName(by_class).unionByName(alone)


def simulated(graph: DataFrame, classes: DataFrame, onto: dict[str, DataFrame], references: DataFrame, bridges: DataFrame, weak: DataFrame, hidden: DataFrame) -> DataFrame:
    """(kind, class, property, other, n, state) of all expectations. ``classes`` is (table, class);
    ``onto`` has classes, subclasses, properties, existentials and inverses; ``references`` is (table,
    parent); ``bridges`` (subject, object) tables; ``weak`` (class, property); ``hidden`` (table, class)."""
    used = stored(usage(graph), "usage")
    none = lambda name: F.lit(None).cast("string").alias(name)
    n_type = used.where("property is null").select(F.col("class").alias("_c"), F.col("n").alias("_n"))
    n_has = used.where("class is not null and property is not null").select(F.col("class").alias("_c"), F.col("property").alias("_p"), F.col("n").alias("_n"))
    n_any = used.where("class is null").select(F.col("property").alias("_p"), F.col("n").alias("_n"))
    n = F.coalesce("_n", F.lit(0).cast("long"))

    def judged(rows: DataFrame, kind: str, state) -> DataFrame:
        return rows.select(F.lit(kind).alias("kind"), "class", "property", "other", n.alias("n"), state.alias("state"))

    near = related(onto["classes"], onto["subclasses"]).select("class", "other").unionByName(onto["classes"].select("class", F.col("class").alias("other")))
    near = stored(near.distinct(), "related")
    types = classes.select("class", none("property"), none("other")).join(n_type, F.col("class") == F.col("_c"), "left")
    out = judged(types, "type", F.when(n > 0, "PASS").otherwise("FAIL"))

    data = onto["properties"].where("kind = 'data'").join(classes, F.col("domain") == F.col("class")).select("class", "property", none("other"))
    data = data.distinct().join(n_has, (F.col("class") == F.col("_c")) & (F.col("property") == F.col("_p")), "left")
    out = out.unionByName(judged(data, "property", F.when(n > 0, "PASS").otherwise("WARN")))

    # Tables that a reference or a bridge joins, as classes.
    joined = references.select(F.col("table").alias("a"), F.col("parent").alias("b")).unionByName(bridges.select(F.col("subject").alias("a"), F.col("object").alias("b")))
    ends = joined.join(classes.select(F.col("table").alias("a"), F.col("class").alias("_a")), "a").join(classes.select(F.col("table").alias("b"), F.col("class").alias("_b")), "b")
    ends = stored(ends.select("_a", "_b").distinct().withColumn("_db", F.lit(True)), "joined")
    objects = onto["properties"].where("kind = 'object' and domain is not null and range is not null")
    links = classes.join(near, "class").join(objects, F.col("other") == F.col("domain")).select("class", "property", F.col("range").alias("other")).distinct()
    links = links.join(n_has, (F.col("class") == F.col("_c")) & (F.col("property") == F.col("_p")), "left").join(ends, (F.col("class") == F.col("_a")) & (F.col("other") == F.col("_b")), "left")
    out = out.unionByName(judged(links, "link", F.when(n > 0, "PASS").when(F.col("_db"), "WARN").otherwise("SKIP")))

    owners = weak.select("class", "property", none("other")).join(n_has, (F.col("class") == F.col("_c")) & (F.col("property") == F.col("_p")), "left")
    out = out.unionByName(judged(owners, "weak", F.when(n > 0, "PASS").otherwise("WARN")))

    base = hidden.join(classes.select("table", F.col("class").alias("base")), "table", "left").select("class", none("property"), F.col("base").alias("other"))
    base = base.join(n_type, F.col("class") == F.col("_c"), "left").join(near.select(F.col("class").alias("_x"), F.col("other").alias("_y"), F.lit(True).alias("_near")), (F.col("other") == F.col("_x")) & (F.col("class") == F.col("_y")), "left")
    out = out.unionByName(judged(base, "hidden", F.when((n > 0) & (F.col("_near") | F.col("other").isNull()), "PASS").otherwise("WARN")))

    axioms = onto["existentials"].select("class", "property", F.col("filler").alias("other"))
    can = objects.join(ends, (F.col("domain") == F.col("_a")) & (F.col("range") == F.col("_b"))).select("property").distinct().withColumn("_db", F.lit(True))
    for k, (table, left, right) in enumerate(((n_type, "class", "_c"), (n_type, "other", "_c"), (n_any, "property", "_p"))):
        axioms = axioms.join(table.select(F.col(right).alias(f"_k{k}"), F.col("_n").alias(f"_n{k}")), F.col(left) == F.col(f"_k{k}"), "left").drop(f"_k{k}")
    axioms = axioms.join(can, "property", "left").withColumn("_n", F.least(*(F.coalesce(f"_n{k}", F.lit(0).cast("long")) for k in range(3))))
    out = out.unionByName(judged(axioms, "equivalent", F.when(n > 0, "PASS").when(F.col("_db"), "FAIL").otherwise("SKIP")))

    pairs = inverse_pairs(onto["inverses"]).join(n_any.select(F.col("_p").alias("b"), F.col("_n").alias("_of")), "b").select(none("class"), F.col("a").alias("property"), F.col("b").alias("other"))
    pairs = pairs.join(n_any, F.col("property") == F.col("_p"), "left")
    return out.unionByName(judged(pairs, "inverse", F.when(n > 0, "PASS").otherwise("WARN"))).select(TESTS)


def mended(mapping: Mapping, tests: DataFrame, keys: dict[tuple[str, str], tuple[tuple[str, str], ...]]) -> tuple[Mapping, set[str]]:
    """The mapping with what its WARNs on links and inverses say, and the properties that this adds,
    of which alone tests need a second look. ``keys`` has the column pairs by which a map refers to
    another, (map, parent): a link with such a pair becomes a reference. An inverse becomes a rule."""
    rows = [r for r in tests.where("state = 'WARN' and kind in ('link', 'inverse')").orderBy("kind", "class", "property").collect()]
    maps, inverses, new = {m.name: m for m in mapping.maps}, list(mapping.inverses), set()
    for r in rows:
        if r.kind == "inverse":
            inverses.append((r.other, r.property))
            new.add(r.property)
            continue
        for (child, parent), on in sorted(keys.items()):
            m = maps.get(child)
            if m and r["class"] in m.classes and parent in maps and r.other in maps[parent].classes and all(p != r.property for p, _ in m.objects):
                maps[child] = replace(m, objects=(*m.objects, (r.property, Reference(parent, on))))
                new.add(r.property)
    return replace(mapping, maps=tuple(maps[m.name] for m in mapping.maps), inverses=tuple(dict.fromkeys(inverses))), new
