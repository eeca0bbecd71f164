"""Lookups in an ontology, as joins of its classes and properties.

``subclasses`` is (child, parent); ``properties`` is (property, kind, domain, range), a row per
domain and range, kind ``data`` or ``object``, a null domain for any class.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from relgraph.functions.terms import bare_property, canonical_name, content_name, local_name, loose_name
from relgraph.operators.materialize import closure

THING = "owl:Thing"


def ancestors(classes: DataFrame, subclasses: DataFrame) -> DataFrame:
    """(class, ancestor, depth): each class with itself and all above it."""
    spark = classes.sparkSession
    up = closure(spark, subclasses).where("child <> ancestor").select(F.col("child").alias("class"), "ancestor", "depth")
    own = classes.select("class", F.col("class").alias("ancestor"), F.lit(0).alias("depth"))
    return own.unionByName(up).groupBy("class", "ancestor").agg(F.min("depth").alias("depth"))


def related(classes: DataFrame, subclasses: DataFrame) -> DataFrame:
    """(class, other, relation) of ancestors and descendants."""
    up = ancestors(classes, subclasses).where("depth > 0")
    down = up.select(F.col("ancestor").alias("class"), F.col("class").alias("other"), F.lit("descendant").alias("relation"))
    return up.select("class", F.col("ancestor").alias("other"), F.lit("ancestor").alias("relation")).unionByName(down)


def distances(classes: DataFrame, subclasses: DataFrame) -> DataFrame:
    """(class, other, depth): steps between classes, up or down; unreachable pairs are missing."""
    both = subclasses.unionByName(subclasses.select(F.col("parent").alias("child"), F.col("child").alias("parent")))
    far = closure(classes.sparkSession, both).where("child <> ancestor").select(F.col("child").alias("class"), F.col("ancestor").alias("other"), "depth")
    return far.unionByName(classes.select("class", F.col("class").alias("other"), F.lit(0).alias("depth")))


def resolved(names: DataFrame, classes: DataFrame) -> DataFrame:
    """(name, class): the class so named, else of that IRI's local name, else of the same
    canonical name (the smallest of several)."""
    tries = [(0, F.col("name"), F.col("class")), (1, local_name(F.col("name")), local_name(F.col("class"))), (2, canonical_name(local_name(F.col("name"))), canonical_name(local_name(F.col("class"))))]
    found = None
    for rank, a, b in tries:
        hit = names.select("name", a.alias("_k")).join(classes.select("class", b.alias("_k")), "_k").select("name", F.struct(F.lit(rank).alias("rank"), F.col("class")).alias("hit"))
        found = hit if found is None else found.unionByName(hit)
    best = found.groupBy("name").agg(F.min("hit").alias("hit"))
    return names.join(best, "name", "left").select("name", F.col("hit.class").alias("class"))


def class_properties(classes: DataFrame, subclasses: DataFrame, properties: DataFrame, down: bool = False) -> DataFrame:
    """(class, property, kind, range, depth): declared on the class or above it, and with
    ``down`` below it."""
    near = ancestors(classes, subclasses)
    if down:
        near = near.unionByName(near.where("depth > 0").select(F.col("ancestor").alias("class"), F.col("class").alias("ancestor"), "depth"))
    found = near.join(properties.where("domain is not null"), F.col("ancestor") == F.col("domain"))
    return found.groupBy("class", "property", "kind", "range").agg(F.min("depth").alias("depth"))


def linked_classes(properties: DataFrame) -> DataFrame:
    """(domain, range, properties): the index of object properties by their ends."""
    links = properties.where("kind = 'object' and domain is not null and range is not null")
    return links.groupBy("domain", "range").agg(F.array_sort(F.collect_set("property")).alias("properties"))


def both_ways(properties: DataFrame, inverses: DataFrame) -> DataFrame:
    """Properties with those that the inverses imply."""
    pairs = inverse_pairs(inverses)
    back = properties.where("kind = 'object'").join(pairs, F.col("property") == F.col("a")).select(F.col("b").alias("property"), "kind", F.col("range").alias("domain"), F.col("domain").alias("range"))
    return properties.unionByName(back).distinct()


def inverse_pairs(inverses: DataFrame) -> DataFrame:
    """(a, b) in both directions."""
    return inverses.select("a", "b").unionByName(inverses.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def missing_inverses(links: DataFrame, inverses: DataFrame) -> DataFrame:
    """(subject, property, object) that the inverses imply and ``links`` lacks. The ontology's pairs go
    to the links: by property all links of one would be one task's."""
    implied = links.join(F.broadcast(inverse_pairs(inverses)), F.col("property") == F.col("a")).select(F.col("object").alias("subject"), F.col("b").alias("property"), F.col("subject").alias("object"))
    return implied.distinct().join(links, ["subject", "property", "object"], "left_anti")


def _quality(a, b):
    """The part of the longer name that the shorter one is, if it lies in it."""
    inside = (F.length(a) > 0) & (F.length(b) > 0) & (F.contains(a, b) | F.contains(b, a))
    return F.when(inside, F.least(F.length(a), F.length(b)) / F.greatest(F.length(a), F.length(b))).otherwise(0.0)


def data_property_matches(columns: DataFrame, classes: DataFrame, subclasses: DataFrame, properties: DataFrame, least: float = 0.6) -> DataFrame:
    """(class, column, property, range, quality) of each (class, column): a data property of
    the class or above it with the same name, else of the best quality, else longest."""
    up = ancestors(classes, subclasses).select("class", "ancestor").unionByName(classes.select("class", F.lit(THING).alias("ancestor")))
    data = properties.where("kind = 'data'").withColumn("domain", F.coalesce("domain", F.lit(THING)))
    found = columns.join(up, "class").join(data, F.col("ancestor") == F.col("domain"))
    c, p = F.col("column"), local_name(F.col("property"))
    same = (loose_name(c) == loose_name(p)) | (content_name(c) == content_name(p))
    quality = F.when(same, 2.0).otherwise(F.greatest(_quality(loose_name(c), loose_name(p)), _quality(content_name(c), content_name(p))))
    found = found.withColumn("quality", quality).where(F.col("quality") >= least)
    best = F.max_by(F.struct("property", "range", "quality"), F.struct("quality", F.length(p), "property")).alias("best")
    return columns.join(found.groupBy("class", "column").agg(best), ["class", "column"], "left").select("class", "column", "best.property", "best.range", F.when(F.col("best.quality") > 1, 1.0).otherwise(F.col("best.quality")).alias("quality"))


def object_property_matches(pairs: DataFrame, classes: DataFrame, subclasses: DataFrame, properties: DataFrame) -> DataFrame:
    """(subject, object, column, property, depth) of each (subject, object, column): the
    object property whose domain and range are nearest, above or below; of equals one that is
    named like the column, then the smallest."""
    near = related(classes, subclasses).select("class", "other").unionByName(classes.select("class", F.col("class").alias("other")))
    near = near.join(distances(classes, subclasses), ["class", "other"]).distinct()
    links = properties.where("kind = 'object' and domain is not null and range is not null")
    a = near.select(F.col("class").alias("subject"), F.col("other").alias("domain"), F.col("depth").alias("_a"))
    b = near.select(F.col("class").alias("object"), F.col("other").alias("range"), F.col("depth").alias("_b"))
    found = pairs.join(a, "subject").join(links, "domain").join(b, ["object", "range"])
    c, p = loose_name(F.col("column")), loose_name(local_name(F.col("property")))
    unlike = F.when((F.length(c) > 0) & (F.contains(c, p) | F.contains(p, c)), 0).otherwise(1)
    best = F.min(F.struct((F.col("_a") + F.col("_b")).alias("depth"), unlike.alias("unlike"), "property")).alias("best")
    return pairs.join(found.groupBy("subject", "object", "column").agg(best), ["subject", "object", "column"], "left").select("subject", "object", "column", "best.property", "best.depth")


def object_properties_by_column(columns: DataFrame, classes: DataFrame, subclasses: DataFrame, properties: DataFrame, least: int = 4) -> DataFrame:
    """(class, column, property): where ends say nothing, the object property of the class or
    above it whose name shares the longest part, ``least`` characters or more, with the column's."""
    up = ancestors(classes, subclasses).select("class", "ancestor").unionByName(classes.select("class", F.lit(THING).alias("ancestor")))
    links = properties.where("kind = 'object'").withColumn("domain", F.coalesce("domain", F.lit(THING)))
    c, p = bare_property(F.col("column")), bare_property(local_name(F.col("property")))
    score = F.when(F.contains(p, c), F.length(c)).when(F.contains(c, p), F.length(p))
    found = columns.join(up, "class").join(links, F.col("ancestor") == F.col("domain")).withColumn("score", score).where(F.col("score") >= least)
    best = found.groupBy("class", "column").agg(F.max_by("property", F.struct("score", "property")).alias("property"))
    return columns.join(best, ["class", "column"], "left")


def most_specific(classes: DataFrame, subclasses: DataFrame, properties: DataFrame) -> DataFrame:
    """(class, range, property, depth): for each range the object properties whose domain is
    nearest to the class, above or below."""
    found = class_properties(classes, subclasses, properties.where("kind = 'object' and range is not null"), down=True)
    near = F.rank().over(Window.partitionBy("class", "range").orderBy("depth"))
    return found.withColumn("_r", near).where("_r = 1").select("class", "range", "property", "depth")


def junctions(bridges: DataFrame) -> DataFrame:
    """Bridges (subject, object, bridge, subject_column, object_column) in both directions."""
    back = bridges.select(F.col("object").alias("subject"), F.col("subject").alias("object"), "bridge", F.col("object_column").alias("subject_column"), F.col("subject_column").alias("object_column"))
    return bridges.unionByName(back).distinct()
