"""Catalog rules as joins over metadata tables: group paths, axis names, attributes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.errors import Malformed
from tessera.session import shared_dir

# Attributes that conventions use for themselves and users are not shown.
HIDDEN = ("CLASS", "NAME", "REFERENCE_LIST", "DIMENSION_LIST", "_Netcdf4Dimid", "_Netcdf4Coordinates", "_NCProperties", "_nc3_strict")


def paths(groups: DataFrame) -> DataFrame:
    """(id, path, depth) of (id, parent, name); roots have a null parent. One join for each level of depth, however
    deep; each level is checkpointed. Groups that no root holds (a cycle, a missing parent) are malformed."""
    spark = groups.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    level = groups.where(F.col("parent").isNull()).select("id", F.concat(F.lit("/"), "name").alias("path"), F.lit(0).alias("depth")).checkpoint()
    out, depth = level, 0
    while not level.isEmpty():
        depth += 1
        level = groups.alias("g").join(level.alias("p"), F.col("g.parent") == F.col("p.id")).select("g.id", F.concat("p.path", F.lit("/"), "g.name").alias("path"), F.lit(depth).alias("depth")).checkpoint()
        out = out.union(level)
    if not groups.select("id").join(out.select("id"), "id", "left_anti").isEmpty():
        raise Malformed("groups that no root holds")
    return out


def visible(attributes: DataFrame) -> DataFrame:
    return attributes.where(~F.col("name").isin(*HIDDEN))


def named_axes(axes: DataFrame, scales: DataFrame) -> DataFrame:
    """Axes (variable, axis, reference, length) with the name of the scale they refer to; without one, of a made-up
    dimension that axes of one length share within a variable's group but never within one variable."""
    found = axes.join(scales.select(F.col("address").alias("reference"), F.col("name").alias("scale")), "reference", "left")
    nth = F.row_number().over(Window.partitionBy("variable", "length", F.col("scale").isNull()).orderBy("axis"))
    spare = found.withColumn("nth", nth)
    made = spare.where("scale is null").select("length", "nth").distinct().withColumn("made", F.row_number().over(Window.orderBy("length", "nth")) - 1)
    return spare.join(made, ["length", "nth"], "left").select("variable", "axis", "length", F.coalesce("scale", F.concat(F.lit("phony_dim_"), F.col("made").cast("string"))).alias("dimension"))


def coordinates(listed: DataFrame, scales: DataFrame) -> DataFrame:
    """(variable, axis, dimension) of variables whose list of dimension ids (variable, axis, id) is all known: one unknown id and the list says nothing."""
    found = listed.join(scales.select("id", F.col("name").alias("dimension")), "id", "left")
    whole = found.groupBy("variable").agg(F.count("*").alias("rank"), F.count("dimension").alias("known")).where("rank = known").select("variable")
    return found.join(whole, "variable", "left_semi").select("variable", "axis", "dimension")


def scales(variables: DataFrame, attributes: DataFrame) -> DataFrame:
    """Dimension scales among variables (file, address, path, name, ordinal, length, unlimited): those whose attribute
    CLASS is DIMENSION_SCALE, each with its id: the number of its attribute _Netcdf4Dimid, else its place among the scales.

    attributes: (file, address, name, text, number)."""
    named = lambda name, column: F.max(F.when(F.col("name") == name, F.col(column)))
    marks = attributes.groupBy("file", "address").agg(named("CLASS", "text").alias("class"), named("_Netcdf4Dimid", "number").alias("own"))
    found = variables.join(marks.where("class = 'DIMENSION_SCALE'").drop("class"), ["file", "address"])
    place = F.row_number().over(Window.partitionBy("file").orderBy("ordinal")) - 1
    return found.withColumn("id", F.coalesce(F.col("own").cast("long"), place.cast("long"))).drop("own")


def dimensioned(axes: DataFrame, scales: DataFrame) -> DataFrame:
    """Axes (file, path, variable, axis, length, unlimited, reference) with the name of their dimension.

    An axis that refers to a scale (file, address, path, name, length, unlimited) has its name. The others take
    dimensions of their own group, of equal length and equally unlimited, none twice in a variable: first the
    group's scales, then made-up ones, `phony_dim_N`. An empty axis that is not unlimited always gets one of its own.
    Made-up dimensions are numbered through a file, after its scales: groups after those below them, in a group as
    its variables, by name, come to need them."""
    group, like = ["file", "path"], ["length", "unlimited"]
    known = scales.select("file", F.col("address").alias("reference"), F.col("name").alias("scale"))
    # axes without a reference are most of them, and would all meet under one key
    found = axes.where("reference is not null").join(known, ["file", "reference"], "left")
    found = found.unionByName(axes.where("reference is null").withColumn("scale", F.lit(None).cast(known.schema["scale"].dataType)))
    alone = F.when((F.col("length") == 0) & ~F.col("unlimited"), F.concat_ws("/", "variable", F.col("axis").cast("string"))).otherwise("")
    kind = [*group, *like, "alone"]
    spare = found.where("scale is null").select(*group, "variable", "axis", *like, alone.alias("alone"))
    spare = spare.withColumn("nth", F.row_number().over(Window.partitionBy(*kind, "variable").orderBy("axis")))
    # a group's scales of a kind have places; a variable takes the nth of the places that it does not use already
    local = scales.select(*group, *like, F.lit("").alias("alone"), "name", F.row_number().over(Window.partitionBy(*group, *like).orderBy("address")).alias("place"))
    totals = local.groupBy(*kind).agg(F.count("*").alias("total"))
    used = found.where("scale is not null").select(*group, "variable", F.col("scale").alias("name")).distinct()
    used = used.join(local, [*group, "name"]).groupBy(*kind, "variable").agg(F.sort_array(F.collect_list("place")).alias("used"))
    place = F.aggregate(F.coalesce("used", F.array().cast("array<int>")), F.col("nth"), lambda at, taken: F.when(taken <= at, at + 1).otherwise(at))
    placed = spare.join(used, [*kind, "variable"], "left").join(totals, kind, "left")
    free = F.coalesce("total", F.lit(0)) - F.coalesce(F.size("used"), F.lit(0))
    placed = placed.withColumn("made", F.when(F.col("nth") > free, F.col("nth") - free)).withColumn("place", F.when(F.col("made").isNull(), place))
    columns = [*group, "variable", "axis", *like]
    taken = placed.where("place is not null").join(local, [*kind, "place"]).select(*columns, F.col("name").alias("dimension"))
    short = placed.where("made is not null")
    first = short.groupBy(*kind, "made").agg(F.min(F.struct("variable", "axis")).alias("first"))
    # numbered within each group, after all groups before it
    last = F.concat("path", F.lit("/\U0010ffff"))
    sizes = first.groupBy(*group).agg(F.count("*").alias("size"))
    before = F.sum("size").over(Window.partitionBy("file").orderBy(last, "path").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select(*group, F.coalesce(before, F.lit(0)).alias("before")).join(scales.groupBy("file").agg(F.count("*").alias("start")), "file", "left")
    number = F.row_number().over(Window.partitionBy(*group).orderBy("first")) - 1 + F.col("before") + F.coalesce("start", F.lit(0))
    numbered = first.join(starts, group).select(*kind, "made", F.concat(F.lit("phony_dim_"), number.cast("string")).alias("dimension"))
    made = short.join(numbered, [*kind, "made"], "left").select(*columns, "dimension")
    return found.where("scale is not null").select(*columns, F.col("scale").alias("dimension")).union(taken).union(made)


def masked(cells: DataFrame, attributes: DataFrame) -> DataFrame:
    """Cells (path, variable, ..., value) with null for the value that the variable's own `_FillValue` names.

    attributes: (path, variable, name, number), far fewer than cells; a variable without that attribute is left as it is."""
    fills = attributes.where("name = '_FillValue'").groupBy("path", "variable").agg(F.first("number").alias("fill_value"))
    both = cells.join(fills, ["path", "variable"], "left")
    return both.withColumn("value", F.when(~F.col("value").eqNullSafe(F.col("fill_value")), F.col("value"))).drop("fill_value").select(*cells.columns)


def resolved(descriptors: DataFrame, heap: DataFrame) -> DataFrame:
    """Descriptors (..., collection, item, length) with the value each points at; of length 0, an empty one whatever it
    points at. A descriptor that points at nothing is malformed."""
    held = heap.select("collection", "item", F.col("value").alias("held"))
    joined = descriptors.join(held, ["collection", "item"], "left")
    return joined.withColumn("value", F.when(F.col("length") == 0, F.lit("")).when(F.col("held").isNull(), F.raise_error(F.lit("Malformed: a descriptor of an object that is not there"))).otherwise(F.substring("held", F.lit(1), F.col("length")))).drop("held")
