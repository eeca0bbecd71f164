"""Rules that build, check and mend mappings, as DataFrame operations on their entries."""

from __future__ import annotations

from dataclasses import replace

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from relgraph.functions.terms import camel_case, canonical_name, local_name, loose_name, placeholders
from relgraph.operators.materialize import rows_of
from relgraph.operators.profile import key_candidates
from relgraph.plans.mapping import Literal, Mapping, Reference, Template, TriplesMap

#: Which pattern's table keeps a class that several have: the lowest. Fixed values.
PRIORITY = {"SE": 0, "SE_SH": 1, "SEw": 2, "SRR": 3}


def class_collisions(entries: DataFrame) -> DataFrame:
    """(class, table, winner) of the classes that several tables have, of entries (table, class,
    pattern). The table named like the class wins if it is one, else that of the strongest
    pattern, else the first by name."""
    same = loose_name(F.col("table")) == loose_name(local_name(F.col("class")))
    same = same | (canonical_name(F.col("table")) == canonical_name(local_name(F.col("class"))))
    rank = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in PRIORITY.items() for x in kv)), F.col("pattern")), F.lit(99))
    w = Window.partitionBy("class")
    e = entries.withColumn("_n", F.count("*").over(w)).where("_n > 1").withColumn("_own", same)
    e = e.withColumn("_one", F.count_if("_own").over(w) == 1)
    order = w.orderBy(F.when(F.col("_one") & F.col("_own"), 0).otherwise(1), rank, "table")
    return e.select("class", "table", (F.row_number().over(order) == 1).alias("winner"))


def resolved_collisions(entries: DataFrame, alternatives: DataFrame) -> DataFrame:
    """``entries`` with losers moved to the first of their alternatives (table, class, rank) that
    nobody has and no other loser takes, else marked ``unresolved``."""
    losers = class_collisions(entries).where("not winner").select("table")
    free = alternatives.join(losers, "table").join(entries.select("class").distinct(), "class", "left_anti")
    first = free.groupBy("table").agg(F.min(F.struct("rank", "class")).alias("pick"))
    taken = Window.partitionBy("pick.class").orderBy("table")
    first = first.withColumn("_k", F.row_number().over(taken)).where("_k = 1").select("table", F.col("pick.class").alias("_new"))
    e = entries.join(losers.withColumn("_lost", F.lit(True)), "table", "left").join(first, "table", "left")
    return e.select("table", F.coalesce("_new", "class").alias("class"), "pattern", (F.coalesce("_lost", F.lit(False)) & F.col("_new").isNull()).alias("unresolved"))


def class_choices(tables: DataFrame, classes: DataFrame) -> DataFrame:
    """(table, class, distance): the class of the same canonical name, else the one whose loose
    name is nearest by edits (ties: the smallest). Where nobody gives other advice, that is it."""
    exact = tables.join(classes, canonical_name(F.col("table")) == canonical_name(local_name(F.col("class")))).groupBy("table").agg(F.min("class").alias("class")).withColumn("distance", F.lit(0))
    every = classes.agg(F.collect_list("class").alias("_all"))  # an ontology's classes: one row
    rest = tables.join(exact, "table", "left_anti").join(F.broadcast(every))
    near = F.array_min(F.transform("_all", lambda c: F.struct(F.levenshtein(loose_name(F.col("table")), loose_name(local_name(c))).alias("d"), c.alias("c"))))
    return exact.unionByName(rest.select("table", near["c"].alias("class"), near["d"].alias("distance")))


def predicates(columns: DataFrame, matches: DataFrame) -> DataFrame:
    """(table, column, predicate): the matched property (table, column, property, quality), each
    once in a table, by quality; other columns get their own name in camel case."""
    w = Window.partitionBy("table", "property").orderBy(F.desc("quality"), "column")
    m = matches.where("property is not null").withColumn("_k", F.row_number().over(w)).where("_k = 1")
    c = columns.join(m.select("table", "column", "property"), ["table", "column"], "left")
    return c.select("table", "column", F.coalesce("property", F.concat(F.lit(":"), camel_case(F.col("column")))).alias("predicate"))


def label_columns(columns: DataFrame, names: tuple = ("label", "name", "title")) -> DataFrame:
    """(table, column): the text column of each table that is named most like a label."""
    rank = F.array_position(F.array(*map(F.lit, names)), F.lower("column"))
    part = F.exists(F.array(*map(F.lit, names)), lambda n: F.contains(F.lower("column"), n))
    c = columns.where(F.col("sql_type").isin("string", "text", "varchar", "char")).where(part)
    return c.groupBy("table").agg(F.min_by("column", F.struct((rank == 0).alias("a"), rank.alias("b"), F.length("column").alias("c"), "column")).alias("column"))


def distinct_objects(entries: DataFrame) -> DataFrame:
    """Objects (map, predicate, object) once each, the first by position."""
    return entries.groupBy("map", "predicate", "object").agg(F.min("position").alias("position"))


def distinct_bridges(entries: DataFrame) -> DataFrame:
    """Bridges (bridge, subject, object, predicate, subject_column, object_column): each
    unordered pair of ends, with the columns that join them, once for a predicate."""
    a = F.struct(F.col("subject").alias("end"), F.col("subject_column").alias("column"))
    b = F.struct(F.col("object").alias("end"), F.col("object_column").alias("column"))
    e = entries.withColumn("_pair", F.array_sort(F.array(a, b)))
    w = Window.partitionBy("bridge", "predicate", "_pair").orderBy("subject", "object")
    return e.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k", "_pair")


def owners(catalog: DataFrame, patterns: DataFrame) -> DataFrame:
    """(table, owner, column): what each weak entity and bridge hangs on: the tables that its
    key refers to, entities before sub-entities before weak ones."""
    keys = catalog.where("is_pk and fk_table is not null").join(patterns.where("pattern in ('SEw', 'SR', 'SRR')"), "table")
    of = patterns.select(F.col("table").alias("owner"), F.col("pattern").alias("_p"))
    k = keys.select("table", F.col("fk_table").alias("owner"), "column", "pattern").join(of, "owner")
    rank = F.when(F.col("_p") == "SE", 0).when(F.col("_p") == "SE_SH", 1).otherwise(2)
    first = F.rank().over(Window.partitionBy("table").orderBy(rank, "owner"))
    return k.withColumn("_r", first).where("_r = 1 or pattern <> 'SEw'").select("table", "owner", "column")


def parents(catalog: DataFrame, patterns: DataFrame) -> DataFrame:
    """(table, parent, column) of sub-entities: by a column named ``id``, else one that ends so,
    else the first foreign key of the key."""
    k = catalog.where("is_pk and fk_table is not null").join(patterns.where("pattern = 'SE_SH'").select("table"), "table")
    rank = F.when(F.lower("column") == "id", 0).when(F.lower("column").endswith("id"), 1).otherwise(2)
    best = k.groupBy("table").agg(F.min(F.struct(rank.alias("r"), "column", F.col("fk_table").alias("parent"))).alias("b"))
    return best.select("table", "b.parent", "b.column")


def hierarchy_order(parents: DataFrame) -> DataFrame:
    """(table, level): parents before their children; tables in a ring have no level."""
    tables = parents.select("table").union(parents.select("parent")).distinct()
    level = tables.join(parents, "table", "left_anti").select("table", F.lit(0).alias("level"))
    out, deepest = level, tables.count()
    while not level.isEmpty():
        level = parents.join(level.withColumnRenamed("table", "parent"), "parent").select("table", (F.col("level") + 1).alias("level")).distinct()
        level = level.join(out, ["table", "level"], "left_anti").where(F.col("level") < deepest)
        out = out.unionByName(level)
    return out.groupBy("table").agg(F.max("level").alias("level"))


def weak_property(mapping: Mapping, m: TriplesMap, owner: str, on: tuple[tuple[str, str], ...], prefix: str = ":") -> TriplesMap:
    """A weak entity's columns as properties of its owner: the owner's template over the foreign
    key, rows without it left out. Columns without a property of their own take the table's name."""
    to = {b: a for a, b in on}
    subject = mapping.map(owner).subject
    for name in placeholders(subject):
        subject = subject.replace("{" + name + "}", "{" + to[name] + "}")
    keep = tuple((p if p else prefix + m.table, o) for p, o in m.objects if not (isinstance(o, Reference) and o.parent == owner))
    there = " AND ".join(f"`{c}` IS NOT NULL" for c in to.values())
    return replace(m, name=f"{m.name}_of_{owner}", subject=subject, classes=(), objects=keep, where=f"({m.where}) AND {there}" if m.where else there, dispatch=None, key=False)


def validity(spark: SparkSession, tables: dict[str, DataFrame], mapping: Mapping) -> list[tuple[str, str]]:
    """(map, issue) of maps whose table or query Spark can't resolve, that name columns it does
    not return, or whose parents are missing or invalid. Only analysis, no job."""
    columns, issues = {}, {}
    for m in mapping.maps:
        try:
            columns[m.name] = set(rows_of(spark, tables, m).columns)
        except PySparkException as e:
            issues[m.name] = f"its table or query is not valid: {e.getCondition() or type(e).__name__}"
            continue
        used = set(placeholders(m.subject)) | ({m.dispatch.column} if m.dispatch else set())
        for _, o in m.objects:
            used |= {o.column} if isinstance(o, Literal) else set(placeholders(o.pattern)) if isinstance(o, Template) else {a for a, _ in o.on}
        if lost := sorted(used - columns[m.name]):
            issues[m.name] = f"columns that its rows lack: {', '.join(lost)}"
    changed = True
    while changed:
        changed = False
        for m in mapping.maps:
            for _, o in m.objects:
                if m.name in issues or not isinstance(o, Reference):
                    continue
                if o.parent not in columns or o.parent in issues:
                    issues[m.name] = f"its parent {o.parent} is missing or invalid"
                elif lost := sorted({b for _, b in o.on} - columns[o.parent]):
                    issues[m.name] = f"columns that its parent {o.parent} lacks: {', '.join(lost)}"
                changed |= m.name in issues
    return sorted(issues.items())


def valid_only(spark: SparkSession, tables: dict[str, DataFrame], mapping: Mapping) -> Mapping:
    bad = {name for name, _ in validity(spark, tables, mapping)}
    return replace(mapping, maps=tuple(m for m in mapping.maps if m.name not in bad))


def mended_parents(mapping: Mapping) -> Mapping:
    """References to maps that are not there go to the one map whose name holds theirs or lies
    in it; where none or several do, they are left out."""
    names = [m.name for m in mapping.maps]

    def mend(o):
        if not isinstance(o, Reference) or o.parent in names:
            return o
        near = [n for n in names if o.parent in n or n in o.parent]
        return replace(o, parent=near[0]) if len(near) == 1 else None

    return replace(mapping, maps=tuple(replace(m, objects=tuple((p, x) for p, o in m.objects if (x := mend(o)) is not None)) for m in mapping.maps))


def coverage(graph: DataFrame, expected: DataFrame) -> DataFrame:
    """(kind, name, n, state) of the classes and properties that a mapping should give (kind,
    name): how many triples there are, PASS or FAIL."""
    is_type = F.col("p") == "rdf:type"
    name = F.when(is_type, F.col("o")).otherwise(F.col("p"))
    got = graph.groupBy(F.when(is_type, "class").otherwise("property").alias("kind"), name.alias("name")).agg(F.count("*").alias("n"))
    e = expected.join(got, ["kind", "name"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    return e.select("kind", "name", "n", F.when(F.col("n") > 0, "PASS").otherwise("FAIL").alias("state"))


def keys_found(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, column) of all columns without nulls or repeated values: each table in one pass."""
    out = None
    for name, df in tables.items():
        k = key_candidates(df, [[c] for c in df.columns]).where("unique and rows > 0").select(F.lit(name).alias("table"), F.col("key").alias("column"))
        out = k if out is None else out.unionByName(k)
    return out


def inclusions_found(tables: dict[str, DataFrame], keys: DataFrame) -> DataFrame:
    """(table, column, parent, parent_column): columns of whole numbers all of whose values are
    in a key found in another table. All columns' distinct values meet all keys' values once;
    a column is included where it finds a partner as often as it has values."""
    whole = ("tinyint", "smallint", "int", "bigint")
    cells = None
    for name, df in tables.items():
        own = [c for c, t in df.dtypes if t in whole]
        if own:
            pairs = F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("long").alias("value")) for c in own))
            x = df.select(F.explode(pairs).alias("x")).select(F.lit(name).alias("table"), "x.column", "x.value").where("value is not null")
            cells = x if cells is None else cells.unionByName(x)
    cells = cells.distinct()
    n = cells.groupBy("table", "column").agg(F.count("*").alias("n"))
    keyed = cells.join(keys, ["table", "column"], "left_semi").select(F.col("table").alias("parent"), F.col("column").alias("parent_column"), "value")
    met = cells.join(keyed, "value").where("table <> parent").groupBy("table", "column", "parent", "parent_column").agg(F.count("*").alias("m"))
    return met.join(n, ["table", "column"]).where("m = n").select("table", "column", "parent", "parent_column")


def valid_constraints(constraints: DataFrame, catalog: DataFrame) -> DataFrame:
    """Constraints (table, column, parent, parent_column) whose ends the catalog has."""
    a = catalog.select("table", "column").distinct()
    b = catalog.select(F.col("table").alias("parent"), F.col("column").alias("parent_column")).distinct()
    return constraints.join(a, ["table", "column"], "left_semi").join(b, ["parent", "parent_column"], "left_semi").select(constraints.columns)


def richness(catalog: DataFrame) -> DataFrame:
    """(tables, keyed, foreign_keys, rich): whether constraints need no search: half of the
    tables have a key, and there are foreign keys for three tables in ten, five at least."""
    t = catalog.groupBy("table").agg(F.max("is_pk").alias("k"), F.count("fk_table").alias("f")).agg(F.count("*").alias("tables"), F.count_if("k").alias("keyed"), F.coalesce(F.sum("f"), F.lit(0)).alias("foreign_keys"))
    rich = (F.col("keyed") >= 0.5 * F.col("tables")) & (F.col("foreign_keys") >= F.greatest(F.lit(5.0), 0.3 * F.col("tables")))
    return t.withColumn("rich", rich)


def without_metadata(tables: DataFrame, mapped: DataFrame, names: tuple = ("alembic_version", "databasechangelog", "schema_migrations", "spatial_ref_sys"), prefixes: tuple = ("flyway_", "pg_", "sqlite_")) -> DataFrame:
    """Tables but those that only tools use; tables with a class stay."""
    t = F.lower("table")
    tool = t.isin(*names) | F.exists(F.array(*map(F.lit, prefixes)), lambda p: F.startswith(t, p))
    return tables.join(mapped.select("table").distinct().withColumn("_mapped", F.lit(True)), "table", "left").where(~tool | F.col("_mapped").isNotNull()).drop("_mapped")
