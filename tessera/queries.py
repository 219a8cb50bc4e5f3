"""The array engine's queries over the given tables, each with its SQL twin.

Arrays are derived from the tables by Spark: `embeddings` becomes a chunked two-dimensional variable, `events`
becomes classic files of 4096 records each, and the engine reads both back through its own operators.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import codecs, convert, records, text
from tessera.operators import chunks, joins
from tessera.operators.chunks import Layout
from tessera.operators.selection import Slab, one_value
from tessera.plans import catalog, ranges
from tessera.session import shared_dir
from tessera.sources import classic
from tessera.streaming.windows import decoded_time, sessions, sliding, tumbling

WIDTH, CHUNK = 64, (7, 5)
FILE_RECORDS = 4096
AXES = ("vec_id", "d")
QUERIES: dict = {}
ORACLES: dict[str, str] = {}
CHUNK_TABLES: dict[tuple, str] = {}

#: The cells of the embeddings, for oracles.
CELLS = "cells AS (SELECT vec_id::BIGINT AS vec_id, (generate_subscripts(embedding, 1) - 1)::BIGINT AS d, unnest(embedding)::DOUBLE AS value FROM embeddings)"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def embedding_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("d", "value"))


def layout(spark: SparkSession, sf_dir: str, kind: str = "<f4", filters: tuple[int, ...] = (codecs.SHUFFLE, codecs.DEFLATE), fill: float = -9999) -> Layout:
    n = table(spark, sf_dir, "embeddings").agg(F.max("vec_id")).first()[0]
    return Layout(AXES, ((n if n is not None else -1) + 1, WIDTH), CHUNK, kind, filters, fill)


def stored_chunks(spark: SparkSession, sf_dir: str, **how) -> tuple[DataFrame, Layout]:
    """The embeddings as a chunk table, written once in an application; selections prune it as they scan it."""
    shape = layout(spark, sf_dir, **how)
    known = (spark.sparkContext.applicationId, sf_dir, shape)
    if known not in CHUNK_TABLES:
        path = f"{shared_dir(spark)}/chunks-{uuid.uuid4().hex}"
        chunks.encoded(embedding_cells(spark, sf_dir), shape).sortWithinPartitions(*shape.coordinates).write.parquet(path)
        CHUNK_TABLES[known] = path
    return spark.read.parquet(CHUNK_TABLES[known]), shape


def doubles(cells: DataFrame) -> DataFrame:
    return cells.select(*AXES, F.col("value").cast("double").alias("value"))


# selections


@query(f"WITH {CELLS} SELECT * FROM cells")
def q_scan_all(spark, sf_dir):
    found, shape = stored_chunks(spark, sf_dir)
    return doubles(chunks.cells(found, shape))


def selected(name: str, where: str, make):
    @query(f"WITH {CELLS} SELECT * FROM cells WHERE {where}")
    def run(spark, sf_dir):
        found, shape = stored_chunks(spark, sf_dir)
        return doubles(chunks.cells(found, shape, make(shape.shape)))

    QUERIES[name], ORACLES[name] = QUERIES.pop("run"), ORACLES.pop("run")


selected("q_slab_block", "vec_id BETWEEN 5 AND 14 AND d BETWEEN 2 AND 4", lambda s: Slab.of(s, slice(5, 15), slice(2, 5)))
selected("q_slab_from", "vec_id >= 100 AND d >= 60", lambda s: Slab.of(s, slice(100, None), slice(60, None)))
selected("q_slab_to", "vec_id < 9 AND d < 3", lambda s: Slab.of(s, slice(None, 9), slice(None, 3)))
selected("q_slab_incl", "vec_id BETWEEN 3 AND 20 AND d BETWEEN 10 AND 30", lambda s: Slab.of(s, (3, 20, "inclusive"), (10, 30, "inclusive")))
selected("q_index_axis", "vec_id = 3", lambda s: Slab.of(s, 3, None))
selected("q_start_count", "vec_id >= 40 AND vec_id < 57 AND d >= 7 AND d < 20", lambda s: Slab.start_count(s, (40, 7), (17, 13)))


@query(f"WITH {CELLS} SELECT * FROM cells WHERE vec_id = 11 AND d = 42")
def q_one_value(spark, sf_dir):
    found, shape = stored_chunks(spark, sf_dir)
    slab = Slab.of(shape.shape, 11, 42)
    return doubles(one_value(chunks.cells(found, shape, slab), slab, AXES))


# chunks


@query(f"""WITH {CELLS}, n AS (SELECT max(vec_id) + 1 AS rows FROM cells)
SELECT vec_id // 7 AS chunk_vec_id, d // 5 AS chunk_d, vec_id // 7 * 7 AS first_vec_id, least(7, any_value(rows) - vec_id // 7 * 7)::BIGINT AS count_vec_id,
       d // 5 * 5 AS first_d, least(5, 64 - d // 5 * 5)::BIGINT AS count_d, count(*) AS cells FROM cells, n GROUP BY vec_id // 7, d // 5""")
def q_chunk_grid(spark, sf_dir):
    found, shape = stored_chunks(spark, sf_dir)
    return chunks.described(shape, found).drop("stored").withColumn("cells", F.col("count_vec_id") * F.col("count_d"))


STATS = f"""WITH {CELLS} SELECT vec_id // 7 AS chunk_vec_id, d // 5 AS chunk_d, count(*) AS n, min(value) AS low, max(value) AS high FROM cells GROUP BY 1, 2"""


@query(STATS)
def q_chunk_stats(spark, sf_dir):
    found, shape = stored_chunks(spark, sf_dir)
    each = doubles(chunks.cells(found, shape))
    return each.groupBy(F.floor(F.col("vec_id") / 7).alias("chunk_vec_id"), F.floor(F.col("d") / 5).alias("chunk_d")).agg(F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))


SPARSE = f"""{CELLS}, stored AS (SELECT vec_id, d, CASE WHEN vec_id // 7 % 2 = 0 THEN value ELSE -9999 END AS value FROM cells)"""


def sparse(spark, sf_dir):
    """Only chunks in even rows of chunks are written."""
    found, shape = stored_chunks(spark, sf_dir)
    return found.where("chunk_vec_id % 2 = 0"), shape


@query(f"WITH {SPARSE} SELECT * FROM stored")
def q_fill_sparse(spark, sf_dir):
    return doubles(chunks.filled(*sparse(spark, sf_dir)))


@query(f"WITH {SPARSE} SELECT * FROM stored WHERE vec_id BETWEEN 3 AND 17 AND d BETWEEN 4 AND 12")
def q_fill_straddle(spark, sf_dir):
    found, shape = sparse(spark, sf_dir)
    return doubles(chunks.filled(found, shape, Slab.of(shape.shape, slice(3, 18), slice(4, 13))))


@query(f"WITH {SPARSE} SELECT d, count(nullif(value, -9999)) AS n, min(nullif(value, -9999)) AS low FROM stored GROUP BY d")
def q_mask_fill(spark, sf_dir):
    found, shape = sparse(spark, sf_dir)
    masked = doubles(chunks.filled(found, shape)).withColumn("value", F.nullif("value", F.lit(float(shape.fill))))
    return masked.groupBy("d").agg(F.count("value").alias("n"), F.min("value").alias("low"))


@query("WITH n AS (SELECT max(vec_id) + 1 AS rows FROM embeddings) SELECT v AS chunk_vec_id, d AS chunk_d FROM n, range(0, (rows + 6) // 7) t(v), range(0, 13) u(d) WHERE v % 2 = 1")
def q_chunks_missing(spark, sf_dir):
    return chunks.missing(*sparse(spark, sf_dir))


for codec, filters in {"none": (), "deflate": (codecs.DEFLATE,), "shuffle": (codecs.SHUFFLE,), "shuffle_deflate": (codecs.SHUFFLE, codecs.DEFLATE), "fletcher": (codecs.SHUFFLE, codecs.DEFLATE, codecs.FLETCHER32), "zstd": (codecs.ZSTD,)}.items():

    def read_back(spark, sf_dir, filters=filters):
        found, shape = stored_chunks(spark, sf_dir, filters=filters)
        return doubles(chunks.cells(found, shape))

    QUERIES[f"q_codec_{codec}"], ORACLES[f"q_codec_{codec}"] = read_back, f"WITH {CELLS} SELECT * FROM cells"


@query(f"WITH {CELLS} SELECT * FROM cells")
def q_bigendian(spark, sf_dir):
    found, shape = stored_chunks(spark, sf_dir, kind=">f4")
    return doubles(chunks.cells(found, shape))


@query(f"WITH {CELLS} SELECT vec_id, d, vec_id * 64 + d AS at FROM cells")
def q_ravel(spark, sf_dir):
    found, shape = stored_chunks(spark, sf_dir)
    each = chunks.cells(found, shape)
    at = ranges.raveled([F.col("vec_id"), F.col("d")], shape.shape)
    back = ranges.unraveled(F.col("at"), shape.shape)
    return each.select(at.alias("at")).select(back[0].alias("vec_id"), back[1].alias("d"), "at")


# conversion

PRICE = "(o_totalprice - 150000.0)"
for to, scale in {"i8": 0.001, "i16": 0.5, "i32": 50000.0, "i64": 1e15, "u8": 0.002, "u16": 1.0, "u32": 60000.0}.items():
    bits, signed, kind = convert.INTEGERS[to]
    low, high = (-(1 << bits - 1), (1 << bits - 1) - 1) if signed else (0, (1 << bits) - 1)
    duck = {"tinyint": "TINYINT", "smallint": "SMALLINT", "int": "INTEGER", "bigint": "BIGINT"}[kind]
    x = f"({PRICE} * {scale}::DOUBLE)"

    def cast_float(spark, sf_dir, to=to, scale=scale):
        value = (F.col("o_totalprice") - 150000.0) * scale
        return table(spark, sf_dir, "orders").select("o_orderkey", convert.converted(value, "f64", to).alias("value"))

    QUERIES[f"q_cast_f64_{to}"] = cast_float
    ORACLES[f"q_cast_f64_{to}"] = f"SELECT o_orderkey, CASE WHEN {x} >= {float(high)!r} THEN {high} WHEN {x} <= {float(low)!r} THEN {low} ELSE trunc({x})::BIGINT END::{duck} AS value FROM orders"

for to in ("i8", "i16", "i32", "u8", "u16", "u32"):
    bits, signed, kind = convert.INTEGERS[to]
    duck = {"tinyint": "TINYINT", "smallint": "SMALLINT", "int": "INTEGER", "bigint": "BIGINT"}[kind]
    x, m, h = "(o_orderkey * 7919 - 30000000)", 1 << bits, (1 << bits - 1) if signed else 0

    def cast_whole(spark, sf_dir, to=to):
        return table(spark, sf_dir, "orders").select("o_orderkey", convert.converted(F.col("o_orderkey") * 7919 - 30000000, "i64", to).alias("value"))

    QUERIES[f"q_cast_i64_{to}"] = cast_whole
    ORACLES[f"q_cast_i64_{to}"] = f"SELECT o_orderkey, ((({x} + {h}) % {m} + {m}) % {m} - {h})::{duck} AS value FROM orders"


@query("SELECT o_orderkey, (o_orderkey * 7919 - 30000000)::FLOAT AS value FROM orders")
def q_cast_i64_f32(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", convert.converted(F.col("o_orderkey") * 7919 - 30000000, "i64", "f32").alias("value"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4096 >= 2048 THEN o_orderkey % 4096 - 4096 ELSE o_orderkey % 4096 END::BIGINT AS value FROM orders")
def q_sign_extend(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", convert.sign_extended(F.col("o_orderkey"), 12).alias("value"))


# classic files


def event_files(spark: SparkSession, sf_dir: str, version: int = 5) -> DataFrame:
    """(path, content): the events as classic files of FILE_RECORDS records each."""
    rows = table(spark, sf_dir, "events").select((F.col("event_id") / FILE_RECORDS).cast("long").alias("file"), "event_id", F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast(ts AS timestamp_ntz))").alias("ts"), "user_id", "event_type", "value")

    def make(pdf):
        pdf = pdf.sort_values("event_id")
        names = np.array([list(x.encode()[:12].ljust(12, b"\0")) for x in pdf["event_type"]], dtype=np.uint8).view("S1").reshape(-1, 12)
        content = classic.written(
            version,
            [("event", 0), ("strlen", 12)],
            {"title": "events", "version": np.array([3], dtype=np.int32)},
            [
                ("event_id", [0], ">i8", {}, pdf["event_id"].to_numpy()),
                ("event", [0], ">i8", {"units": "microseconds since 1970-01-01"}, pdf["ts"].to_numpy()),
                ("user_id", [0], ">i4", {"_FillValue": np.array([-1], dtype=np.int32)}, pdf["user_id"].to_numpy()),
                ("value", [0], ">f8", {"valid_range": np.array([0.0, 1000.0])}, pdf["value"].to_numpy()),
                ("event_type", [0, 1], "S1", {}, names),
            ],
            len(pdf),
        )
        import pandas as pd

        return pd.DataFrame({"path": [f"events-{int(pdf['file'].iloc[0]):06d}.nc"], "content": [content]})

    return rows.groupBy("file").applyInPandas(make, "path string, content binary")


PLACED = "e AS (SELECT *, 'events-' || lpad((event_id // 4096)::VARCHAR, 6, '0') || '.nc' AS path, row_number() OVER (PARTITION BY event_id // 4096 ORDER BY event_id) - 1 AS event FROM events)"


@query(f"WITH {PLACED} SELECT path, event, value FROM e")
def q_record_1d(spark, sf_dir):
    return classic.cells(event_files(spark, sf_dir), "value", ">f8", ["event"])


@query(f"WITH {PLACED} SELECT path, event, event_id, user_id::INTEGER AS user_id, value FROM e")
def q_record_2d_interleaved(spark, sf_dir):
    return classic.together(event_files(spark, sf_dir), {"event_id": ">i8", "user_id": ">i4", "value": ">f8"}, ["event"])


@query(f"WITH {PLACED} SELECT path, event, i AS strlen, substr(event_type, (i + 1)::INTEGER, 1) AS value FROM e, range(0, 12) t(i)")
def q_char_chars(spark, sf_dir):
    found = classic.cells(event_files(spark, sf_dir), "event_type", "S1", ["event", "strlen"])
    return found.select("path", "event", "strlen", F.regexp_replace("value", "\0", "").alias("value"))


@query(f"WITH {PLACED} SELECT path, event, event_type FROM e")
def q_char_join(spark, sf_dir):
    found = classic.cells(event_files(spark, sf_dir), "event_type", "S1", ["event", "strlen"])
    return found.groupBy("path", "event").agg(text.joined(F.col("strlen"), F.col("value")).alias("event_type"))


@query("WITH f AS (SELECT 'events-' || lpad((event_id // 4096)::VARCHAR, 6, '0') || '.nc' AS path, count(*) AS n FROM events GROUP BY 1) SELECT path, id::INTEGER AS id, name, CASE WHEN id = 0 THEN n ELSE 12 END AS length, id = 0 AS unlimited FROM f, (VALUES (0, 'event'), (1, 'strlen')) t(id, name)")
def q_meta_dimensions(spark, sf_dir):
    return classic.dimensions(event_files(spark, sf_dir)).toDF("path", "id", "name", "length", "unlimited")


@query("""WITH f AS (SELECT 'events-' || lpad((event_id // 4096)::VARCHAR, 6, '0') || '.nc' AS path, count(*) AS n FROM events GROUP BY 1)
SELECT path, o::INTEGER AS ordinal, name, dims AS dimensions, n * width AS elements, kind, name = dims AS is_coordinate, true AS is_record
FROM f, (VALUES (0, 'event_id', 'event', 1, 'i8'), (1, 'event', 'event', 1, 'i8'), (2, 'user_id', 'event', 1, 'i4'), (3, 'value', 'event', 1, 'f8'), (4, 'event_type', 'event,strlen', 12, 'S1')) t(o, name, dims, width, kind)""")
def q_meta_variables(spark, sf_dir):
    return classic.variables(event_files(spark, sf_dir))


@query("""WITH f AS (SELECT DISTINCT 'events-' || lpad((event_id // 4096)::VARCHAR, 6, '0') || '.nc' AS path FROM events)
SELECT path, variable, name, kind, text, numbers[1]::DOUBLE AS single, len(numbers)::INTEGER AS n FROM f, (VALUES ('', 'title', 'S1', 'events', NULL), ('', 'version', 'i4', NULL, [3.0]), ('event', 'units', 'S1', 'microseconds since 1970-01-01', NULL), ('user_id', '_FillValue', 'i4', NULL, [-1.0]), ('value', 'valid_range', 'f8', NULL, [0.0, 1000.0])) t(variable, name, kind, text, numbers)""")
def q_meta_attributes(spark, sf_dir):
    found = catalog.visible(classic.attributes(event_files(spark, sf_dir)))
    return found.select("path", "variable", "name", "kind", "text", F.try_element_at("numbers", F.lit(1)).alias("single"), F.when(F.col("numbers").isNotNull(), F.size("numbers")).alias("n"))


@query("SELECT DISTINCT 'events-' || lpad((event_id // 4096)::VARCHAR, 6, '0') || '.nc' AS path, 'cdf5' AS container FROM events")
def q_meta_files(spark, sf_dir):
    return classic.containers(event_files(spark, sf_dir))


@query("SELECT event_id, user_id::INTEGER AS user_id FROM events WHERE value > 50")
def q_align_join(spark, sf_dir):
    found = event_files(spark, sf_dir)
    name = lambda variable, kind: classic.cells(found, variable, kind, ["event"]).withColumnRenamed("value", variable)
    joined = name("event_id", ">i8").join(name("user_id", ">i4"), ["path", "event"]).join(name("value", ">f8"), ["path", "event"])
    return joined.where("value > 50").select("event_id", "user_id")


@query(f"WITH {PLACED} SELECT path, event, value, epoch_us(ts)::DOUBLE AS coord_event FROM e")
def q_coord_lookup(spark, sf_dir):
    return classic.cells(event_files(spark, sf_dir), "value", ">f8", ["event"], coordinates=True)


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def q_time_window(spark, sf_dir):
    found = classic.cells(event_files(spark, sf_dir), "value", ">f8", ["event"], coordinates=True)
    rows = found.select(decoded_time(F.col("coord_event").cast("long"), "microseconds since 1970-01-01").alias("time"), "value")
    return tumbling(rows, "time", "1 hour").withColumn("total", F.round("total", 4))


# strings and sequences


@query("SELECT n_nationkey, rtrim(n_name) AS null_cut, rtrim(n_name) AS space_cut FROM nation")
def q_fixed_string_pad(spark, sf_dir):
    rows = table(spark, sf_dir, "nation")
    return rows.select("n_nationkey", text.fixed_string(F.concat(F.rtrim("n_name"), F.lit("\0junk")), "null").alias("null_cut"), text.fixed_string(F.rpad("n_name", 40, " "), "space").alias("space_cut"))


@query("SELECT n_nationkey, i AS place, substr(n_name, i::INTEGER + 1, 1) AS value FROM nation, range(0, 20) t(i)")
def q_string_characters(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_nationkey", F.posexplode(text.characters(F.col("n_name"), 20)).alias("place", "value")).withColumn("place", F.col("place").cast("long"))


@query("SELECT doc_id, text FROM documents WHERE text IS NOT NULL")
def q_vlen_string(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").where("text is not null")
    return rows.select("doc_id", F.decode(F.encode("text", "UTF-8"), "UTF-8").alias("text"))


SEQUENCE = "(l_linenumber, l_quantity, l_extendedprice, l_partkey, l_suppkey)"


def ragged(spark, sf_dir):
    """(o_orderkey, quantities): a sequence of any length for each order; an order without lines has an empty one."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_quantity", "l_extendedprice", "l_partkey", "l_suppkey"))).alias("lines"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    held = F.coalesce(F.transform("lines", lambda x: x["l_quantity"]), F.array().cast("array<double>"))
    return orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", held.alias("quantities"))


@query(f"WITH s AS (SELECT l_orderkey, l_quantity, row_number() OVER (PARTITION BY l_orderkey ORDER BY {SEQUENCE[1:-1]}) - 1 AS place FROM lineitem) SELECT o_orderkey, place::INTEGER AS place, l_quantity AS quantity FROM orders JOIN s ON o_orderkey = l_orderkey")
def q_vlen_seq_explode(spark, sf_dir):
    return ragged(spark, sf_dir).select("o_orderkey", F.posexplode("quantities").alias("place", "quantity"))


@query("SELECT o_orderkey, count(l_orderkey)::INTEGER AS n FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey")
def q_vlen_seq_len(spark, sf_dir):
    return ragged(spark, sf_dir).select("o_orderkey", F.size("quantities").alias("n"))


# catalog


def tree(spark, sf_dir):
    region = table(spark, sf_dir, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("id"), F.lit(None).cast("string").alias("parent"), F.col("r_name").alias("name"))
    nation = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("id"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("parent"), F.col("n_name").alias("name"))
    customer = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("parent"), F.col("c_name").alias("name"))
    return region.union(nation).union(customer)


@query("""WITH RECURSIVE g AS (SELECT 'r' || r_regionkey AS id, NULL AS parent, r_name AS name FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_name FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, c_name FROM customer),
t AS (SELECT id, '/' || name AS path, 0 AS depth FROM g WHERE parent IS NULL UNION ALL SELECT g.id, t.path || '/' || g.name, t.depth + 1 FROM g JOIN t ON g.parent = t.id) SELECT id, path, depth FROM t""")
def q_groups_tree(spark, sf_dir):
    return catalog.paths(tree(spark, sf_dir))


@query("""WITH a AS (SELECT p_partkey AS variable, i AS axis, CASE WHEN (p_partkey + i) % 3 = 0 THEN p_size % 5 END AS reference, (p_size + i * (p_partkey % 2)) % 7 AS length FROM part, range(0, 2) t(i)),
s AS (SELECT i AS address, 'dim' || i AS name FROM range(0, 4) t(i)),
n AS (SELECT a.*, s.name AS scale, row_number() OVER (PARTITION BY variable, length, s.name IS NULL ORDER BY axis) AS nth FROM a LEFT JOIN s ON reference = address),
m AS (SELECT length, nth, row_number() OVER (ORDER BY length, nth) - 1 AS made FROM (SELECT DISTINCT length, nth FROM n WHERE scale IS NULL))
SELECT variable, axis, length, coalesce(scale, 'phony_dim_' || made) AS dimension FROM n LEFT JOIN m USING (length, nth)""")
def q_phony_dims(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_size", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(1).cast("long"))).alias("axis"))
    axes = parts.select(F.col("p_partkey").alias("variable"), "axis", F.when((F.col("p_partkey") + F.col("axis")) % 3 == 0, (F.col("p_size") % 5).cast("long")).alias("reference"), ((F.col("p_size") + F.col("axis") * (F.col("p_partkey") % 2)) % 7).alias("length"))
    scales = spark.range(4).select(F.col("id").alias("address"), F.concat(F.lit("dim"), F.col("id").cast("string")).alias("name"))
    return catalog.named_axes(axes, scales)


@query("""WITH a AS (SELECT p_partkey AS variable, i AS axis, (p_size + i * p_partkey) % 6 AS id FROM part, range(0, 2) t(i)),
f AS (SELECT a.*, CASE WHEN id < 5 THEN 'dim' || id END AS dimension FROM a)
SELECT variable, axis, dimension FROM f WHERE variable IN (SELECT variable FROM f GROUP BY variable HAVING count(*) = count(dimension))""")
def q_axis_coordinates(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_size", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(1).cast("long"))).alias("axis"))
    listed = parts.select(F.col("p_partkey").alias("variable"), "axis", ((F.col("p_size") + F.col("axis") * F.col("p_partkey")) % 6).alias("id"))
    scales = spark.range(5).select("id", F.concat(F.lit("dim"), F.col("id").cast("string")).alias("name"))
    return catalog.coordinates(listed, scales)


@query("SELECT doc_id, coalesce(text, '') AS value FROM documents")
def q_vlen_resolve(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.floor(F.col("doc_id") / 50).alias("collection"), (F.col("doc_id") % 50 + 1).alias("item"), "text")
    descriptors = docs.select("doc_id", "collection", "item", F.coalesce(F.length("text"), F.lit(0)).alias("length"))
    return catalog.resolved(descriptors, docs.where("text is not null").select("collection", "item", F.col("text").alias("value"))).select("doc_id", "value")


@query("SELECT o_custkey, CASE WHEN count(*) = 1 THEN min(o_totalprice) END AS single, CASE WHEN count(*) > 1 THEN count(*) END::INTEGER AS several FROM orders GROUP BY o_custkey")
def q_attribute_fold(spark, sf_dir):
    values = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(text.folded(F.array_sort(F.collect_list("o_totalprice"))).alias("value"))
    return values.select("o_custkey", "value.single", F.when(F.col("value.several").isNotNull(), F.size("value.several")).alias("several"))


MEMBERS = [("station", "<i4", 0), ("value", ">f8", 4), ("label", "S10", 12)]


@query("SELECT c_custkey, c_nationkey AS station, c_acctbal AS value, c_mktsegment AS label FROM customer")
def q_compound(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("station"), F.col("c_acctbal").alias("value"), F.col("c_mktsegment").alias("label"))
    return records.unpacked(records.packed(rows, MEMBERS, 24), MEMBERS, 24)


# relational work on scanned variables


@query(f"WITH {CELLS} SELECT vec_id, d, value FROM cells ORDER BY value DESC, vec_id, d LIMIT 100")
def q_topk(spark, sf_dir):
    found, shape = stored_chunks(spark, sf_dir)
    return doubles(chunks.cells(found, shape)).orderBy(F.col("value").desc(), "vec_id", "d").limit(100)


@query(f"WITH {CELLS}, r AS (SELECT vec_id, d, value, rank() OVER (PARTITION BY vec_id ORDER BY value DESC)::INTEGER AS place FROM cells) SELECT * FROM r WHERE place <= 3")
def q_rank_window(spark, sf_dir):
    found, shape = stored_chunks(spark, sf_dir)
    place = F.rank().over(Window.partitionBy("vec_id").orderBy(F.col("value").desc()))
    return doubles(chunks.cells(found, shape)).withColumn("place", place).where("place <= 3")


@query(f"WITH {CELLS} SELECT label, d % 4 AS part, count(*) AS n, max(value) AS high FROM cells JOIN (SELECT vec_id, label FROM embeddings) USING (vec_id) GROUP BY ROLLUP (label, d % 4)")
def q_rollup(spark, sf_dir):
    found, shape = stored_chunks(spark, sf_dir)
    labels = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    each = doubles(chunks.cells(found, shape)).join(labels, "vec_id").withColumn("part", F.col("d") % 4)
    return each.rollup("label", "part").agg(F.count("*").alias("n"), F.max("value").alias("high"))


@query("SELECT event_id, value FROM events")
def q_union_files(spark, sf_dir):
    return classic.together(event_files(spark, sf_dir), {"event_id": ">i8", "value": ">f8"}, ["event"]).select("event_id", "value")


@query("SELECT event_id FROM events WHERE event_id // 4096 <> 0 EXCEPT SELECT event_id FROM events WHERE value < 10")
def q_except_files(spark, sf_dir):
    both = classic.together(event_files(spark, sf_dir), {"event_id": ">i8", "value": ">f8"}, ["event"])
    return both.where("path <> 'events-000000.nc'").select("event_id").subtract(both.where("value < 10").select("event_id"))


@query("WITH c AS (SELECT o_orderkey // 32 AS chunk, count(*) AS n FROM orders GROUP BY 1), s AS (SELECT o_orderkey AS start, 1 + o_custkey % 50 AS count FROM orders WHERE o_orderstatus = 'P') SELECT chunk, n FROM c WHERE EXISTS (SELECT 1 FROM s WHERE start < chunk * 32 + 32 AND start + count > chunk * 32)")
def q_semi_chunks(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    held = orders.groupBy(F.floor(F.col("o_orderkey") / 32).alias("chunk")).agg(F.count("*").alias("n"))
    slabs = orders.where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("start"), (1 + F.col("o_custkey") % 50).alias("count"), F.lit(32).alias("size"))
    return ranges.overlapping(held, slabs, "size")


@query("""WITH r AS (SELECT l_suppkey AS file, l_orderkey * 100 AS "offset", 50 + l_linenumber * 20 AS length FROM lineitem),
m AS (SELECT *, max("offset" + length) OVER (PARTITION BY file ORDER BY "offset", length ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM r),
o AS (SELECT *, sum(CASE WHEN reach IS NULL OR "offset" - reach > 400 THEN 1 ELSE 0 END) OVER (PARTITION BY file ORDER BY "offset", length ROWS UNBOUNDED PRECEDING) AS run FROM m)
SELECT file, min("offset") AS "offset", max("offset" + length) - min("offset") AS length, count(*) AS parts FROM o GROUP BY file, run""")
def q_coalesce_ranges(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("file"), (F.col("l_orderkey") * 100).alias("offset"), (50 + F.col("l_linenumber") * 20).cast("long").alias("length"))
    return ranges.coalesced(rows, "file", 400)


@query("WITH p AS (SELECT DISTINCT user_id, event_id // 16 AS page FROM events), i AS (SELECT *, page - row_number() OVER (PARTITION BY user_id ORDER BY page) AS island FROM p) SELECT user_id, min(page) AS first, max(page) AS last FROM i GROUP BY user_id, island")
def q_page_islands(spark, sf_dir):
    pages = table(spark, sf_dir, "events").select("user_id", F.floor(F.col("event_id") / 16).alias("page")).distinct()
    return ranges.islands(pages, "user_id", "page")


# conversion from every type to every type

SOURCES = {
    "i8": ("o_orderkey % 256 - 128", "TINYINT"),
    "i16": ("o_orderkey * 7 % 65536 - 32768", "SMALLINT"),
    "i32": ("o_orderkey * 7919 % 4294967296 - 2147483648", "INTEGER"),
    "i64": ("o_orderkey * 790000001 - 3000000000000", "BIGINT"),
    "u8": ("o_orderkey % 256", "SMALLINT"),
    "u16": ("o_orderkey * 7 % 65536", "INTEGER"),
    "u32": ("o_orderkey * 7919 % 4294967296", "BIGINT"),
    "u64": ("CAST(18446744073709551615 AS DECIMAL(20,0)) - o_orderkey", "DECIMAL(20,0)"),
    "f32": ("CAST((o_totalprice - 150000) * 0.7 AS FLOAT)", "FLOAT"),
    "f64": ("(o_totalprice - 150000) * CAST(40000 AS DOUBLE)", "DOUBLE"),
}
DUCK = {"i8": "TINYINT", "i16": "SMALLINT", "i32": "INTEGER", "i64": "BIGINT", "u8": "SMALLINT", "u16": "INTEGER", "u32": "BIGINT", "u64": "DECIMAL(20,0)", "f32": "FLOAT", "f64": "DOUBLE"}


def cast_sql(source: str, to: str) -> str:
    if source == to or to in convert.FLOATS:
        return f"x::{DUCK[to]}"
    bits, signed, _ = convert.INTEGERS[to]
    low, high = (-(1 << bits - 1), (1 << bits - 1) - 1) if signed else (0, (1 << bits) - 1)
    if source in convert.FLOATS:
        return f"CASE WHEN x >= {float(high)!r} THEN {high} WHEN x <= {float(low)!r} THEN {low} ELSE trunc(x)::HUGEINT END::{DUCK[to]}"
    m, h = f"{1 << bits}::HUGEINT", f"{-low}::HUGEINT"
    return f"(((x::HUGEINT + {h}) % {m} + {m}) % {m} - {h})::{DUCK[to]}"


for source, (expression, kind) in SOURCES.items():

    def cast_all(spark, sf_dir, source=source, expression=expression, kind=kind):
        rows = table(spark, sf_dir, "orders").select("o_orderkey", F.expr(f"CAST({expression} AS {kind})").alias("x"))
        return rows.select("o_orderkey", *(convert.converted(F.col("x"), source, to).alias(f"as_{to}") for to in SOURCES))

    QUERIES[f"q_casts_from_{source}"] = cast_all
    ORACLES[f"q_casts_from_{source}"] = f"WITH s AS (SELECT o_orderkey, CAST({expression} AS {kind}) AS x FROM orders) SELECT o_orderkey, {', '.join(f'{cast_sql(source, to)} AS as_{to}' for to in SOURCES)} FROM s"


# joins by order, set operations, groupings and frames


def numbered_events(spark, sf_dir, kind):
    rows = table(spark, sf_dir, "events").where(F.col("event_type") == kind)
    return rows.select("user_id", F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast(ts AS timestamp_ntz))").cast("double").alias("at"), "event_id", "value")


NUMBERED = "{0} AS (SELECT user_id, moment, max(event_id) AS event_id, max_by(value, event_id) AS value FROM (SELECT *, epoch_us(ts)::DOUBLE AS moment FROM events WHERE event_type = '{1}') GROUP BY user_id, moment)"


@query(f"""WITH l AS (SELECT user_id, epoch_us(ts)::DOUBLE AS moment, event_id FROM events WHERE event_type = 'purchase'), {NUMBERED.format('r', 'view')}
SELECT l.event_id, r.event_id AS view_id, r.value AS value FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.moment >= r.moment""")
def q_as_of(spark, sf_dir):
    views = numbered_events(spark, sf_dir, "view").withColumnRenamed("event_id", "view_id")
    return joins.as_of(numbered_events(spark, sf_dir, "purchase").drop("value"), views, "user_id", "at", ["view_id", "value"], 3.6e9).select("event_id", "view_id", "value")


@query(f"""WITH l AS (SELECT user_id, epoch_us(ts)::DOUBLE AS moment, event_id FROM events WHERE event_type = 'purchase'), {NUMBERED.format('r', 'view')},
b AS (SELECT l.event_id, r.event_id AS back, abs(l.moment - r.moment) AS far FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.moment >= r.moment),
a AS (SELECT l.event_id, r.event_id AS ahead, abs(l.moment - r.moment) AS far FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.moment <= r.moment)
SELECT event_id, CASE WHEN back IS NULL OR a.far < b.far THEN coalesce(ahead, back) ELSE back END AS view_id FROM a JOIN b USING (event_id)""")
def q_nearest(spark, sf_dir):
    views = numbered_events(spark, sf_dir, "view").select("user_id", "at", F.col("event_id").alias("view_id"))
    return joins.nearest(numbered_events(spark, sf_dir, "purchase").drop("value"), views, "user_id", "at", ["view_id"], 3.6e9).select("event_id", "view_id")


def event_values(spark, sf_dir):
    """(path, event, user_id, value) of the classic files of events."""
    return classic.together(event_files(spark, sf_dir), {"user_id": ">i4", "value": ">f8"}, ["event"])


@query("SELECT user_id::INTEGER AS user_id FROM events WHERE value > 50 INTERSECT SELECT user_id FROM events WHERE value < 10")
def q_intersect(spark, sf_dir):
    rows = event_values(spark, sf_dir)
    return rows.where("value > 50").select("user_id").intersect(rows.where("value < 10").select("user_id"))


@query(f"WITH {PLACED} SELECT path, event, value FROM e WHERE event_id // 4096 % 2 = 0 UNION ALL SELECT path, event, value FROM e WHERE event_id // 4096 % 2 = 1")
def q_union_parts(spark, sf_dir):
    found = event_files(spark, sf_dir).withColumn("odd", F.regexp_extract("path", r"(\d+)\.nc", 1).cast("int") % 2)
    parts = [classic.cells(found.where(F.col("odd") == k).drop("odd"), "value", ">f8", ["event"]) for k in (0, 1)]
    return parts[0].unionByName(parts[1])


def labelled_cells(spark, sf_dir):
    found, shape = stored_chunks(spark, sf_dir)
    return doubles(chunks.cells(found, shape)).join(table(spark, sf_dir, "embeddings").select("vec_id", "label"), "vec_id").withColumn("part", F.col("d") % 4)


LABELLED = f"WITH {CELLS}, c AS (SELECT vec_id, d, value, label, d % 4 AS part FROM cells JOIN (SELECT vec_id, label FROM embeddings) USING (vec_id))"


@query(f"{LABELLED} SELECT label, part, count(*) AS n, max(value) AS high FROM c GROUP BY CUBE (label, part)")
def q_cube(spark, sf_dir):
    return labelled_cells(spark, sf_dir).cube("label", "part").agg(F.count("*").alias("n"), F.max("value").alias("high"))


@query(f"{LABELLED} SELECT label, part, grouping_id(label, part)::BIGINT AS level, count(*) AS n, min(value) AS low FROM c GROUP BY GROUPING SETS ((label), (part), ())")
def q_grouping_sets(spark, sf_dir):
    rows = labelled_cells(spark, sf_dir)
    return rows.groupingSets([[F.col("label")], [F.col("part")], []], "label", "part").agg(F.grouping_id().alias("level"), F.count("*").alias("n"), F.min("value").alias("low"))


@query(f"WITH {CELLS} SELECT vec_id, d, max(value) OVER w AS high, lag(value) OVER (PARTITION BY vec_id ORDER BY d) AS before FROM cells WINDOW w AS (PARTITION BY vec_id ORDER BY d ROWS BETWEEN 3 PRECEDING AND 1 FOLLOWING)")
def q_frames(spark, sf_dir):
    found, shape = stored_chunks(spark, sf_dir)
    row = Window.partitionBy("vec_id").orderBy("d")
    return doubles(chunks.cells(found, shape)).select("vec_id", "d", F.max("value").over(row.rowsBetween(-3, 1)).alias("high"), F.lag("value").over(row).alias("before"))


def timed_events(spark, sf_dir):
    timed = classic.together(event_files(spark, sf_dir), {"value": ">f8", "user_id": ">i4"}, ["event"], coordinates=True)
    return timed.select("user_id", decoded_time(F.col("coord_event").cast("long"), "microseconds since 1970-01-01").alias("time"), "value")


@query("SELECT start, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT value, time_bucket(INTERVAL 20 MINUTE, ts) - i * INTERVAL 20 MINUTE AS start FROM events, range(0, 3) t(i)) GROUP BY start")
def q_sliding_window(spark, sf_dir):
    return sliding(timed_events(spark, sf_dir), "time", "1 hour", "20 minutes").withColumn("total", F.round("total", 4))


@query("""WITH e AS (SELECT user_id, ts, value, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 6 HOUR, true) AS opens FROM events),
s AS (SELECT *, sum(opens::INT) OVER (PARTITION BY user_id ORDER BY ts) AS nth FROM e)
SELECT user_id::INTEGER AS user_id, min(ts) AS start, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY user_id, nth""")
def q_session_window(spark, sf_dir):
    return sessions(timed_events(spark, sf_dir), "user_id", "time", "6 hours").withColumn("total", F.round("total", 4))


# catalog of groups, and fill values


@query("""WITH c AS (SELECT c_mktsegment AS path, c_custkey, c_nationkey AS value FROM customer), f AS (SELECT path, min(value) AS fill FROM c WHERE path <> 'MACHINERY' GROUP BY path)
SELECT path, c_custkey, CASE WHEN value IS DISTINCT FROM fill THEN value END AS value FROM c LEFT JOIN f USING (path)""")
def q_fill_attribute(spark, sf_dir):
    cells = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("path"), F.lit("nation").alias("variable"), "c_custkey", F.col("c_nationkey").alias("value"))
    attributes = cells.where("path <> 'MACHINERY'").groupBy("path", "variable").agg(F.min("value").alias("number")).withColumn("name", F.lit("_FillValue"))
    return catalog.masked(cells, attributes).select("path", "c_custkey", "value")


def part_catalog(spark, sf_dir):
    """Metadata made of parts: three files, a group for each brand; two axes a variable, some parts are scales."""
    parts = table(spark, sf_dir, "part").select(F.concat(F.lit("f"), (F.col("p_partkey") % 3).cast("string")).alias("file"), F.concat(F.lit("/"), "p_brand").alias("path"), F.col("p_partkey").alias("address"), F.col("p_name").alias("name"), F.col("p_partkey").alias("ordinal"), (F.col("p_size") % 4).cast("long").alias("length"), (F.col("p_partkey") % 5 == 0).alias("unlimited"))
    marks = parts.where("address % 10 = 3")
    attributes = marks.select("file", "address", F.lit("CLASS").alias("name"), F.lit("DIMENSION_SCALE").alias("text"), F.lit(None).cast("long").alias("number"))
    own = marks.where("address % 20 = 3").select("file", "address", F.lit("_Netcdf4Dimid").alias("name"), F.lit(None).cast("string").alias("text"), (F.col("address") * 2).alias("number"))
    return parts, attributes.union(own)


@query("""SELECT 'f' || p_partkey % 3 AS file, p_partkey AS address, CASE WHEN p_partkey % 20 = 3 THEN p_partkey * 2 ELSE row_number() OVER (PARTITION BY p_partkey % 3 ORDER BY p_partkey) - 1 END::BIGINT AS id
FROM part WHERE p_partkey % 10 = 3""")
def q_dimension_scales(spark, sf_dir):
    return catalog.scales(*part_catalog(spark, sf_dir)).select("file", "address", "id")


@query("""WITH p AS (SELECT 'f' || p_partkey % 3 AS file, '/' || p_brand AS path, p_partkey AS variable, (p_size % 4)::BIGINT AS length, p_partkey % 5 = 0 AS unlimited FROM part),
s AS (SELECT file, path, variable AS address, 's' || variable AS name, length, unlimited FROM p WHERE variable % 10 = 3),
a AS (SELECT file, path, variable, i AS axis, CASE WHEN i = 0 THEN length ELSE (length + variable % 2) % 4 END AS length, unlimited, CASE WHEN i = 1 AND variable % 7 = 0 THEN variable - variable % 10 + 3 END AS reference FROM p, range(0, 2) t(i)),
x AS (SELECT a.*, s.name AS scale, CASE WHEN a.length = 0 AND NOT a.unlimited THEN variable || '/' || axis ELSE '' END AS alone FROM a LEFT JOIN s ON a.file = s.file AND reference = address),
n AS (SELECT *, row_number() OVER (PARTITION BY file, path, length, unlimited, alone, variable ORDER BY axis) AS nth FROM x WHERE scale IS NULL),
-- a list of what a variable may take before made-up dimensions
f AS (SELECT n.file, n.path, n.variable, n.length, n.unlimited, list(DISTINCT s.name ORDER BY s.name) AS names FROM n JOIN s ON s.file = n.file AND s.path = n.path AND s.length = n.length AND s.unlimited = n.unlimited
      WHERE n.alone = '' AND NOT EXISTS (SELECT 1 FROM x WHERE x.file = n.file AND x.variable = n.variable AND x.scale = s.name) GROUP BY ALL),
m AS (SELECT n.*, coalesce(names, []) AS names, nth - len(coalesce(names, [])) AS made FROM n LEFT JOIN f ON f.file = n.file AND f.path = n.path AND f.variable = n.variable AND f.length = n.length AND f.unlimited = n.unlimited AND alone = ''),
o AS (SELECT file, path, length, unlimited, alone, made, min(variable * 10 + axis) AS first FROM m WHERE made > 0 GROUP BY ALL),
q AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY path, first) - 1 AS number FROM o),
c AS (SELECT file, count(*) AS start FROM s GROUP BY file)
SELECT file, path, variable, axis, length, CASE WHEN made <= 0 THEN names[nth] ELSE 'phony_dim_' || (number + coalesce(start, 0)) END AS dimension
FROM m LEFT JOIN q USING (file, path, length, unlimited, alone, made) LEFT JOIN c USING (file) UNION ALL SELECT file, path, variable, axis, length, scale FROM x WHERE scale IS NOT NULL""")
def q_group_dimensions(spark, sf_dir):
    parts, _ = part_catalog(spark, sf_dir)
    scales = parts.where("address % 10 = 3").select("file", "path", F.concat(F.lit("s"), F.col("address").cast("string")).alias("address"), "length", "unlimited").withColumn("name", F.col("address"))
    each = parts.select("file", "path", F.col("address").alias("variable"), "length", "unlimited", F.explode(F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))).alias("axis"))
    reference = F.when((F.col("axis") == 1) & (F.col("variable") % 7 == 0), F.concat(F.lit("s"), (F.col("variable") - F.col("variable") % 10 + 3).cast("string")))
    axes = each.withColumn("length", F.when(F.col("axis") == 0, F.col("length")).otherwise((F.col("length") + F.col("variable") % 2) % 4)).withColumn("reference", reference)
    return catalog.dimensioned(axes, scales).select("file", "path", "variable", "axis", "length", "dimension")


@query("""WITH RECURSIVE r AS (SELECT l_suppkey AS file, l_orderkey * 100 AS "offset", (50 + l_linenumber * 20)::BIGINT AS length, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey * 100, l_linenumber) AS nth FROM lineitem),
g AS (SELECT file, nth, "offset" AS low, "offset" + length AS high, 1 AS run FROM r WHERE nth = 1
      UNION ALL
      SELECT g.file, r.nth, CASE WHEN joins THEN g.low ELSE r."offset" END, CASE WHEN joins THEN greatest(g.high, r."offset" + r.length) ELSE r."offset" + r.length END, CASE WHEN joins THEN run ELSE run + 1 END
      FROM g JOIN r ON r.file = g.file AND r.nth = g.nth + 1, LATERAL (SELECT r."offset" - g.high <= 4000 AND greatest(g.high, r."offset" + r.length) - g.low <= 10000 AS joins))
SELECT file, min(low) AS "offset", max(high) - min(low) AS length, count(*) AS parts FROM g GROUP BY file, run""")
def q_requests(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("file"), (F.col("l_orderkey") * 100).alias("offset"), (50 + F.col("l_linenumber") * 20).cast("long").alias("length"))
    return ranges.requests(rows, "file", 4000, 10000)


def checksums(spark, sf_dir, function):
    rows = table(spark, sf_dir, "part").select("p_partkey", F.encode("p_name", "UTF-8").alias("data"))

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(function(batch.column(1).to_pylist()), pa.int64())], ["p_partkey", "sum"])

    return rows.mapInArrow(run, "p_partkey long, sum long")


@query()
def q_checksum_lookup3(spark, sf_dir):
    return checksums(spark, sf_dir, lambda values: codecs.lookup3(values).astype(np.int64))


@query()
def q_checksum_fletcher32(spark, sf_dir):
    return checksums(spark, sf_dir, lambda values: [codecs.fletcher32(v) for v in values])


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of each decoded chunk of the embeddings, with the labels of its rows."""
    found, shape = stored_chunks(spark, sf_dir)
    labels = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    each = doubles(chunks.cells(found, shape)).join(labels, "vec_id")
    return each.groupBy(F.floor(F.col("vec_id") / 7).alias("chunk_vec_id"), F.floor(F.col("d") / 5).alias("chunk_d")).agg(F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"), F.countDistinct("label").alias("labels"))
