"""Registered queries of containers, imaging and labware: one entry per operator of their handles, with SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.operators import imaging, labware
from gridloom.plans.inputs import read
from gridloom.sources.container import Container, Dataset, Group, scratch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def register(name: str, make: Callable[[SparkSession, str], DataFrame], sql: str) -> None:
    QUERIES[name], SQL[name] = make, sql


def joined(column: str, cast: str = "string") -> Column:
    return F.array_join(F.transform(column, lambda x: x.cast(cast)), ",").alias(column)


# labware: customers as samples, parts as treatments, suppliers as reporters, orders as data
def samples(s: SparkSession, d: str) -> labware.Samples:
    df = read(s, d, "customer")
    return labware.Core(s).new_sample(df, "c_custkey", ID="c_custkey", refDB=F.lit("customer"), name="c_name", description="c_mktsegment", EFOID=F.concat(F.lit("EFO:"), F.col("c_nationkey").cast("string")), EFOterm=F.lower("c_mktsegment"), nation="c_nationkey")


def treatments(s: SparkSession, d: str) -> labware.Treatments:
    return labware.Core(s).new_treatment(read(s, d, "part"), "p_partkey", ID="p_partkey", refDB=F.lit("part"), type="p_type", description="p_name", EFOID="p_brand", EFOterm=F.lower("p_type"), size="p_size")


def reporters(s: SparkSession, d: str) -> labware.Reporters:
    return labware.Core(s).new_reporter(read(s, d, "supplier"), "s_suppkey", ID="s_suppkey", refDB=F.lit("supplier"), type=(F.col("s_nationkey") % 3), description="s_name", EFOID=F.concat(F.lit("EFO:"), F.col("s_nationkey").cast("string")), EFOterm=F.lower("s_name"), nation="s_nationkey")


def data(s: SparkSession, d: str) -> labware.Data:
    path = F.concat(F.lit("/data/"), F.col("o_orderkey").cast("string"))
    return labware.Core(s).new_data(read(s, d, "orders"), "o_orderkey", ID="o_orderkey", type="o_orderstatus", filepath=path, filename=F.concat(F.col("o_orderkey").cast("string"), F.lit(".csv")), format=F.lit("csv"), origin="o_orderpriority", customer="o_custkey")


ITEMS = {
    "sample": (samples, "customer", "c_custkey", {"ID": "c_custkey", "refDB": "'customer'", "name": "c_name", "description": "c_mktsegment", "EFOID": "'EFO:' || c_nationkey", "EFOterm": "lower(c_mktsegment)", "nation": "c_nationkey"}),
    "treatment": (treatments, "part", "p_partkey", {"ID": "p_partkey", "refDB": "'part'", "type": "p_type", "description": "p_name", "EFOID": "p_brand", "EFOterm": "lower(p_type)", "size": "p_size"}),
    "reporter": (reporters, "supplier", "s_suppkey", {"ID": "s_suppkey", "refDB": "'supplier'", "type": "s_nationkey % 3", "description": "s_name", "EFOID": "'EFO:' || s_nationkey", "EFOterm": "lower(s_name)", "nation": "s_nationkey"}),
    "data": (data, "orders", "o_orderkey", {"ID": "o_orderkey", "type": "o_orderstatus", "filepath": "'/data/' || o_orderkey", "filename": "o_orderkey || '.csv'", "format": "'csv'", "origin": "o_orderpriority", "customer": "o_custkey"}),
}
for kind, (make, table, key, attributes) in ITEMS.items():
    names = ", ".join(f"({x})::VARCHAR AS {k}" for k, x in attributes.items())
    other = next(k for k in attributes if k not in labware.ITEMS[kind])
    register(f"labware_new_{kind}", lambda s, d, m=make, k=kind, o=other: m(s, d).df.select("item_id", *labware.ITEMS[k], F.col("attrs")[o].alias(o)), f"SELECT {key} AS item_id, {names} FROM {table}")
    for name in labware.ITEMS[kind]:
        # read after some are set anew, so that both uses of the accessor show
        register(f"labware_{kind}_{name}", lambda s, d, m=make, n=name: getattr(getattr(m(s, d), n)("changed", F.col("item_id") % 7 == 3), n)(), f"SELECT {key} AS item_id, CASE WHEN {key} % 7 = 3 THEN 'changed' ELSE ({attributes[name]})::VARCHAR END AS value FROM {table}")
    register(f"labware_{kind}_autoload", lambda s, d, m=make, o=other: m(s, d).with_attribute("grade", F.concat(F.lit("g"), F.col("attrs")[o]), F.col("item_id") % 2 == 0).attribute("grade"), f"SELECT {key} AS item_id, CASE WHEN {key} % 2 = 0 THEN 'g' || {attributes[other]} END AS value FROM {table}")


def plates(s: SparkSession, d: str) -> labware.Plates:
    """A 96-well plate for each nation."""
    df = read(s, d, "nation").select(F.col("n_name").alias("plate_id"), F.concat(F.lit("plate "), F.col("n_nationkey").cast("string")).alias("name"), F.lit(8).alias("nrows"), F.lit(12).alias("ncols"), F.create_map(F.lit("region"), F.col("n_regionkey").cast("string")).alias("attrs"))
    return labware.Core(s).new_plates(df)


WELL = ("plate_id", "position", "row", "row_idx", "col", "idx")
P = "P AS (SELECT n_name AS plate_id, 'plate ' || n_nationkey AS name, n_regionkey, chr((65 + r)::INTEGER) || (c + 1) AS position, chr((65 + r)::INTEGER) AS row, (r + 1)::INTEGER AS row_idx, (c + 1)::INTEGER AS col, (r * 12 + c + 1)::INTEGER AS idx FROM nation CROSS JOIN range(8) a(r) CROSS JOIN range(12) b(c))"
PLATE = {"ID": ("plate_id", "n_name"), "name": ("name", "'plate ' || n_nationkey"), "type": ("type", "'96-well plate'"), "nrows": ("nrows", "8"), "ncols": ("ncols", "12")}
register("labware_new_core", lambda s, d: labware.Core(s).new_plate("p", wells=96).wells().df.select(*WELL), f"WITH {P} SELECT 'p' AS plate_id, position, row, row_idx, col, idx FROM P WHERE n_regionkey IS NOT NULL AND plate_id = (SELECT min(n_name) FROM nation)")
register("labware_new_plate", lambda s, d: plates(s, d).df.select("plate_id", "name", "type", "nrows", "ncols", F.col("attrs")["region"].alias("region")), "SELECT n_name AS plate_id, 'plate ' || n_nationkey AS name, '96-well plate' AS type, 8 AS nrows, 12 AS ncols, n_regionkey::VARCHAR AS region FROM nation")
for name in ("name", "type", "nrows", "ncols"):
    new = "99" if name in ("nrows", "ncols") else "'changed'"
    register(f"labware_plate_{name}", lambda s, d, n=name, v=new.strip("'"): getattr(getattr(plates(s, d), n)(v, F.col("attrs")["region"] == "1"), n)(), f"SELECT n_name AS plate_id, CASE WHEN n_regionkey = 1 THEN {new} ELSE {PLATE[name][1]} END AS value FROM nation")
register("labware_plate_id", lambda s, d: plates(s, d).ID(F.concat(F.lit("id-"), F.col("plate_id"))).ID(), "SELECT 'id-' || n_name AS plate_id, 'id-' || n_name AS value FROM nation")
register("labware_plate_autoload", lambda s, d: plates(s, d).with_attribute("owner", "me", F.col("attrs")["region"] == "2").attribute("owner"), "SELECT n_name AS plate_id, CASE WHEN n_regionkey = 2 THEN 'me' END AS value FROM nation")


def held(s: SparkSession, d: str) -> DataFrame:
    """Customers in the wells of their nation's plate, in order of their numbers."""
    place = F.concat(F.char((F.lit(65) + F.col("c_custkey") % 4).cast("long")), (F.col("c_custkey") % 12 + 1).cast("string"))
    df = read(s, d, "customer").join(read(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("plate_id"), place.alias("position"), F.col("c_custkey").alias("item_id"))
    order = F.row_number().over(Window.partitionBy("plate_id", "position").orderBy("item_id")) - 1
    return df.select("plate_id", "position", order.alias("ord"), "item_id")


HELD = "Q AS (SELECT plate_id, position, (row_number() OVER (PARTITION BY plate_id, position ORDER BY item_id) - 1)::INTEGER AS ord, item_id FROM (SELECT n_name AS plate_id, chr((65 + c_custkey % 4)::INTEGER) || (c_custkey % 12 + 1) AS position, c_custkey AS item_id FROM customer JOIN nation ON c_nationkey = n_nationkey))"
register("labware_new_well", lambda s, d: labware.Core(s).new_well(plates(s, d), "C04").df.select(*WELL), f"WITH {P} SELECT plate_id, position, row, row_idx, col, idx FROM P WHERE position = 'C4'")
register("labware_well_plate", lambda s, d: plates(s, d).wells().plate(plates(s, d)).select("plate_id", "position", "name"), f"WITH {P} SELECT plate_id, position, name FROM P")
for name in ("row", "row_idx", "col", "idx"):
    register(f"labware_well_{name}", lambda s, d, n=name: getattr(plates(s, d).wells(), n)(), f"WITH {P} SELECT plate_id, position, {name} AS value FROM P")
register("labware_well_label", lambda s, d: plates(s, d).wells().label("control", F.col("col") == 1).label(), f"WITH {P} SELECT plate_id, position, CASE WHEN col = 1 THEN 'control' END AS value FROM P")
register("labware_well_autoload", lambda s, d: plates(s, d).wells().with_attribute("edge", "yes", F.col("row").isin("A", "H")).attribute("edge"), f"WITH {P} SELECT plate_id, position, CASE WHEN row IN ('A', 'H') THEN 'yes' END AS value FROM P")
# write-once: only wells that hold nothing take new items; here one new item for every well of column 1
fresh = lambda s, d: plates(s, d).wells().df.where("col = 1").select("plate_id", "position", F.lit(0).alias("ord"), F.lit(-1).cast("long").alias("item_id"))
ONCE = f"WITH {P}, {HELD} SELECT plate_id, position, ord, item_id FROM Q UNION ALL SELECT plate_id, position, 0, -1 FROM P WHERE col = 1 AND NOT EXISTS (SELECT 1 FROM Q WHERE Q.plate_id = P.plate_id AND Q.position = P.position)"
for name in ("samples", "treatments", "reporters"):
    register(f"labware_well_{name}", lambda s, d, n=name: (lambda w: getattr(w, n)(w.hold(held(s, d), fresh(s, d))))(plates(s, d).wells()), ONCE)
register("labware_well_data", lambda s, d: plates(s, d).wells().data(held(s, d), fresh(s, d)), f"WITH {P}, {HELD} SELECT plate_id, position, ord, item_id FROM Q UNION ALL SELECT plate_id, position, (SELECT count(*) FROM Q WHERE Q.plate_id = P.plate_id AND Q.position = P.position)::INTEGER, -1 FROM P WHERE col = 1")
plate_data = lambda s, d: held(s, d).where("position = 'A1'").select("plate_id", "ord", "item_id")
register("labware_plate_data", lambda s, d: plates(s, d).data(plate_data(s, d), plate_data(s, d)), f"WITH {HELD}, D AS (SELECT plate_id, ord, item_id FROM Q WHERE position = 'A1') SELECT plate_id, ord, item_id FROM D UNION ALL SELECT plate_id, (ord + (SELECT max(ord) + 1 FROM D x WHERE x.plate_id = D.plate_id))::INTEGER, item_id FROM D")


def stored(s: SparkSession, d: str) -> dict[str, DataFrame]:
    """Tables of labware after a way through the store; schemas come back with them."""
    path = labware.store({"wells": plates(s, d).wells().df, "held": held(s, d)}, scratch(s, "labware"))
    return labware.retrieve(s, path, ["wells", "held"])


register("labware_store", lambda s, d: stored(s, d)["held"], f"WITH {HELD} SELECT plate_id, position, ord, item_id FROM Q")
register("labware_retrieve", lambda s, d: stored(s, d)["wells"].select(*WELL), f"WITH {P} SELECT plate_id, position, row, row_idx, col, idx FROM P")
register("labware_rebless", lambda s, d: labware.Wells(stored(s, d)["wells"]).with_attribute("seen", "1", F.col("idx") == 5).attribute("seen"), f"WITH {P} SELECT plate_id, position, CASE WHEN idx = 5 THEN '1' END AS value FROM P")


# imaging: regions as plates, nations as wells, embeddings as objects of the position of their label
def catalog(s: SparkSession, d: str) -> DataFrame:
    """Groups of a container: /sample/0/plate/REGION/experiment/NATION/position/1 to 3."""
    places = read(s, d, "nation").join(read(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    each = places.select("r_name", "n_name", F.explode(F.array(F.lit("1"), F.lit("2"), F.lit("3"))).alias("p"))
    parts = each.select(F.array(F.lit("sample"), F.lit("0"), F.lit("plate"), "r_name", F.lit("experiment"), "n_name", F.lit("position"), "p").alias("x"))
    rows = parts.select("x", F.explode(F.sequence(F.lit(1), F.lit(8))).alias("n"))
    path = lambda n: F.concat(F.lit("/"), F.array_join(F.slice("x", F.lit(1), n), "/"))
    return rows.select(path(F.col("n")).alias("path"), F.when(F.col("n") == 1, "/").otherwise(path(F.col("n") - 1)).alias("parent"), F.col("x")[F.col("n") - 1].alias("name"), F.lit("group").alias("kind")).distinct()


def place(nation: Column) -> Column:
    """The path of position 1 of a nation (column n_nationkey) by the names of the tables."""
    return F.concat(F.lit("/sample/0/plate/"), F.col("r_name"), F.lit("/experiment/"), F.col("n_name"), F.lit("/position/1"))


def imaged(s: SparkSession, d: str) -> dict[str, DataFrame]:
    """Tables of all positions; vectors belong to the nation of their label."""
    paths = read(s, d, "nation").join(read(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", place(F.col("n_nationkey")).alias("path"))
    v = read(s, d, "embeddings").join(F.broadcast(paths), F.col("label") == F.col("n_nationkey"))
    x = lambda k: F.pmod(F.floor(F.col("embedding")[k].cast("double") * 256), F.lit(32)).cast("int")
    weight = lambda e: F.abs(e.cast("double"))
    probs = F.slice("embedding", 1, 10)
    total = F.aggregate(probs, F.lit(0.0), lambda a, e: a + weight(e))
    after = F.lead("idx").over(Window.partitionBy("path").orderBy("idx"))
    objects = v.select("path", F.col("vec_id").alias("idx"), (F.col("vec_id") + 1000).alias("obj_label_id"), (F.col("vec_id") % 4).cast("int").alias("time_idx"))
    edges = objects.select("path", F.col("idx").alias("obj_idx1"), after.alias("obj_idx2")).where("obj_idx2 IS NOT NULL")
    pixel = v.select("path", F.explode(F.sequence(F.lit(0), F.lit(1))).alias("c"), (F.col("vec_id") % 4).cast("int").alias("t"), F.lit(0).alias("z"), F.expr("cast(vec_id div 40 as int)").alias("y"), F.posexplode(F.slice("embedding", 1, 32)).alias("x", "e"))
    return {
        "objects": objects,
        "prediction": v.select("path", F.col("vec_id").alias("idx"), F.pmod(F.col("vec_id"), F.lit(10)).cast("int").alias("label_idx")),
        "probability": v.select("path", F.col("vec_id").alias("idx"), F.transform(probs, lambda e: weight(e) / total).alias("probs")),
        "features": v.select("path", F.col("vec_id").alias("idx"), F.col("embedding").alias("features")),
        "centers": v.select("path", F.col("vec_id").alias("idx"), x(0).alias("x"), x(1).alias("y"), F.when(F.col("vec_id") % 2 == 0, x(2)).alias("z")),
        "boxes": v.select("path", F.col("vec_id").alias("idx"), (x(1) - 1).alias("top"), (x(1) + 2).alias("bottom"), (x(0) - 2).alias("left"), (x(0) + 1).alias("right")),
        "tracking": edges,
        "links": edges.select("path", F.expr("obj_idx1 div 100").alias("obj_id"), F.col("obj_idx1").alias("pos"), F.col("obj_idx1").alias("idx1"), F.col("obj_idx2").alias("idx2")),
        "pixels": pixel.groupBy("path", "c", "t", "z", "y", "x").agg(F.max(F.pmod(F.floor(F.col("e").cast("double") * 256) + F.col("c"), F.lit(256))).cast("int").alias("v")),
        "channels": s.createDataFrame([(0, "secondary"), (1, "primary")], "idx int, channel_name string"),
        "classes": read(s, d, "nation").where("n_nationkey < 10").select(F.col("n_nationkey").alias("ord"), (F.col("n_nationkey") + 1).alias("label"), F.col("n_name").alias("name"), F.concat(F.lit("#"), F.col("n_regionkey").cast("string")).alias("color")),
    }


def file(s: SparkSession, d: str) -> imaging.File:
    return imaging.File(catalog(s, d), imaged(s, d))


def nation_place(s: SparkSession, d: str, key: int = 3) -> tuple[str, str]:
    row = read(s, d, "nation").where(F.col("n_nationkey") == key).join(read(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).first()
    return row["r_name"], row["n_name"]


def position(s: SparkSession, d: str) -> imaging.Position:
    region, nation = nation_place(s, d)
    return file(s, d).get_plate_by_name(region).get_well(nation).get_position("1")


PLACES = "N AS (SELECT n_nationkey, r_name, n_name, '/sample/0/plate/' || r_name AS plate, '/sample/0/plate/' || r_name || '/experiment/' || n_name AS well, '/sample/0/plate/' || r_name || '/experiment/' || n_name || '/position/1' AS path FROM nation JOIN region ON n_regionkey = r_regionkey)"
X = lambda k: f"((floor(embedding[{k + 1}]::DOUBLE * 256)::BIGINT % 32 + 32) % 32)::INTEGER"
V = f"{PLACES}, V AS (SELECT vec_id AS idx, embedding, label, vec_id + 1000 AS obj_label_id, (vec_id % 4)::INTEGER AS time_idx, (vec_id % 10)::INTEGER AS class_idx, {X(0)} AS x, {X(1)} AS y, CASE WHEN vec_id % 2 = 0 THEN {X(2)} ELSE 0 END AS z, path FROM embeddings JOIN N ON label = n_nationkey WHERE label = 3)"
EDGES = f"{V}, K AS (SELECT * FROM (SELECT idx AS obj_idx1, lead(idx) OVER (ORDER BY idx) AS obj_idx2 FROM V) WHERE obj_idx2 IS NOT NULL)"
CLASSES = "Z AS (SELECT n_nationkey AS idx, n_nationkey + 1 AS label, n_name AS name, '#' || n_regionkey AS color FROM nation WHERE n_nationkey < 10)"
PIXELS = f"{V}, E AS (SELECT idx, time_idx AS t, (idx // 40)::INTEGER AS y, unnest(range(32))::INTEGER AS x, unnest(embedding[1:32])::DOUBLE AS e FROM V), I AS (SELECT c::INTEGER AS c, t, y, x, max(((floor(e * 256)::BIGINT + c) % 256 + 256) % 256)::INTEGER AS v FROM E CROSS JOIN range(2) r(c) GROUP BY ALL)"


def told(s: SparkSession, *rows: tuple[str, str]) -> DataFrame:
    """What handles tell of themselves, as (what, value)."""
    return s.createDataFrame(list(rows), "what string, value string")


OWN = "(SELECT {} FROM N WHERE n_nationkey = 3)"
register("imaging_file_new", lambda s, d: file(s, d).all_positions(), f"WITH {PLACES} SELECT r_name AS plate, n_name AS well, p::VARCHAR AS position, well || '/position/' || p AS path FROM N CROSS JOIN range(1, 4) x(p)")
register("imaging_file_plates", lambda s, d: file(s, d).plates(), f"WITH {PLACES} SELECT DISTINCT r_name AS name, plate AS path FROM N")
register("imaging_file_get_plate_by_name", lambda s, d: told(s, ("plate", file(s, d).get_plate_by_name(nation_place(s, d)[0]).path)), f"WITH {PLACES} SELECT 'plate' AS what, plate AS value FROM N WHERE n_nationkey = 3")
register("imaging_plate_new", lambda s, d: told(s, ("plate", imaging.Plate(file(s, d), nation_place(s, d, 5)[0]).path)), f"WITH {PLACES} SELECT 'plate' AS what, plate AS value FROM N WHERE n_nationkey = 5")
register("imaging_plate_file", lambda s, d: imaging.Plate(file(s, d), nation_place(s, d)[0]).file().plates().select("name"), "SELECT r_name AS name FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation)")
register("imaging_plate_wells", lambda s, d: file(s, d).get_plate_by_name(nation_place(s, d)[0]).wells(), f"WITH {PLACES} SELECT n_name AS name, well AS path FROM N WHERE r_name = {OWN.format('r_name')}")
register("imaging_plate_get_well", lambda s, d: told(s, ("well", position(s, d).well().plate().get_well(nation_place(s, d)[1]).path)), f"WITH {PLACES} SELECT 'well' AS what, well AS value FROM N WHERE n_nationkey = 3")
register("imaging_well_new", lambda s, d: told(s, ("well", imaging.Well(position(s, d).well().plate(), nation_place(s, d)[1]).path)), f"WITH {PLACES} SELECT 'well' AS what, well AS value FROM N WHERE n_nationkey = 3")
register("imaging_well_plate", lambda s, d: position(s, d).well().plate().wells().select("name"), f"WITH {PLACES} SELECT n_name AS name FROM N WHERE r_name = {OWN.format('r_name')}")
register("imaging_well_positions", lambda s, d: position(s, d).well().positions(), f"WITH {PLACES} SELECT p::VARCHAR AS name, well || '/position/' || p AS path FROM N CROSS JOIN range(1, 4) x(p) WHERE n_nationkey = 3")
register("imaging_well_get_position", lambda s, d: told(s, ("position", position(s, d).well().get_position("2").path)), f"WITH {PLACES} SELECT 'position' AS what, well || '/position/2' AS value FROM N WHERE n_nationkey = 3")
register("imaging_position_new", lambda s, d: told(s, ("position", imaging.Position(position(s, d).well(), "3").path)), f"WITH {PLACES} SELECT 'position' AS what, well || '/position/3' AS value FROM N WHERE n_nationkey = 3")
register("imaging_position_well", lambda s, d: position(s, d).well().positions().select("path"), f"WITH {PLACES} SELECT well || '/position/' || p AS path FROM N CROSS JOIN range(1, 4) x(p) WHERE n_nationkey = 3")
register("imaging_position_get_object_handle", lambda s, d: position(s, d).get_object_handle().get_all_objects().df, f"WITH {V} SELECT idx, obj_label_id, time_idx, class_idx FROM V")
register("imaging_position_get_image_handle", lambda s, d: told(s, ("primary", str(position(s, d).get_image_handle().get_primary_channel_idx()))), "SELECT 'primary' AS what, '1' AS value")
register("imaging_position_get_event_handle", lambda s, d: position(s, d).get_event_handle().get_all_events().df.select("obj_id", joined("objects")), f"WITH {EDGES} SELECT obj_id, string_agg(idx::VARCHAR, ',' ORDER BY idx) AS objects FROM (SELECT DISTINCT obj_idx1 // 100 AS obj_id, unnest([obj_idx1, obj_idx2]) AS idx FROM K) GROUP BY obj_id")
register("imaging_event_handle_new", lambda s, d: imaging.EventHandle(position(s, d)).get_all_events().id(), f"WITH {EDGES} SELECT DISTINCT obj_idx1 // 100 AS obj_id FROM K")
register("imaging_event_handle_position", lambda s, d: told(s, ("position", position(s, d).get_event_handle().position().path)), f"WITH {PLACES} SELECT 'position' AS what, path AS value FROM N WHERE n_nationkey = 3")
register("imaging_event_by_id", lambda s, d: position(s, d).get_event_handle().get_event_by_id(1).df.select("obj_id", joined("objects")), f"WITH {EDGES} SELECT 1::BIGINT AS obj_id, string_agg(idx::VARCHAR, ',' ORDER BY idx) AS objects FROM (SELECT DISTINCT unnest([obj_idx1, obj_idx2]) AS idx FROM K WHERE obj_idx1 // 100 = 1) HAVING count(*) > 0")
register("imaging_event_new", lambda s, d: imaging.Events(position(s, d).get_event_handle(), s.createDataFrame([(7, [1, 2])], "obj_id long, objects array<long>")).df.select("obj_id", joined("objects")), "SELECT 7::BIGINT AS obj_id, '1,2' AS objects")
register("imaging_event_position", lambda s, d: told(s, ("position", position(s, d).get_event_handle().get_all_events().position().path)), f"WITH {PLACES} SELECT 'position' AS what, path AS value FROM N WHERE n_nationkey = 3")
register("imaging_event_id", lambda s, d: position(s, d).get_event_handle().get_all_events().id(), f"WITH {EDGES} SELECT DISTINCT obj_idx1 // 100 AS obj_id FROM K")
register("imaging_event_objects", lambda s, d: position(s, d).get_event_handle().get_all_events().objects().select("obj_id", F.size("objects").cast("long").alias("n")), f"WITH {EDGES} SELECT obj_idx1 // 100 AS obj_id, count(*) + 1 AS n FROM K GROUP BY ALL")
register("imaging_class_handle_new", lambda s, d: imaging.ClassHandle(file(s, d)).get_all_classes().select(F.col("idx").cast("long").alias("idx"), "name"), f"WITH {CLASSES} SELECT idx::BIGINT AS idx, name FROM Z")
register("imaging_class_handle_file", lambda s, d: imaging.ClassHandle(file(s, d)).file().plates().select("name"), "SELECT r_name AS name FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation)")
all_classes = lambda s, d: imaging.Classes(file(s, d).get_all_classes().withColumn("idx", F.col("idx").cast("long")))
register("imaging_class_new", lambda s, d: all_classes(s, d).df, f"WITH {CLASSES} SELECT idx::BIGINT AS idx, label, name, color FROM Z")
register("imaging_class_idx", lambda s, d: all_classes(s, d).idx(), f"WITH {CLASSES} SELECT idx::BIGINT AS idx FROM Z")
for name in ("label", "name"):
    register(f"imaging_class_{name}", lambda s, d, n=name: getattr(all_classes(s, d), n)(), f"WITH {CLASSES} SELECT idx::BIGINT AS idx, {name} FROM Z")
register("imaging_class_color", lambda s, d: all_classes(s, d).color("#new", F.col("idx") % 3 == 1).color(), f"WITH {CLASSES} SELECT idx::BIGINT AS idx, CASE WHEN idx % 3 = 1 THEN '#new' ELSE color END AS color FROM Z")
register("imaging_image_handle_new", lambda s, d: imaging.ImageHandle(position(s, d)).get_image(0, 1, 0).pixels(), f"WITH {PIXELS} SELECT y, x, v FROM I WHERE c = 0 AND t = 1")
register("imaging_image_handle_position", lambda s, d: told(s, ("position", position(s, d).get_image_handle().position().path)), f"WITH {PLACES} SELECT 'position' AS what, path AS value FROM N WHERE n_nationkey = 3")
plane = lambda s, d, c=1, t=2: position(s, d).get_image_handle().get_image(c, t, 0)
register("imaging_get_image", lambda s, d: plane(s, d).pixels(), f"WITH {PIXELS} SELECT y, x, v FROM I WHERE c = 1 AND t = 2")
register("imaging_new_image", lambda s, d: position(s, d).get_image_handle().new_image(plane(s, d).pixels().where("x < 5")).pixels(), f"WITH {PIXELS} SELECT y, x, v FROM I WHERE c = 1 AND t = 2 AND x < 5")
register("imaging_image_new", lambda s, d: imaging.Image(plane(s, d).pixels().where("y < 3")).pixels(), f"WITH {PIXELS} SELECT y, x, v FROM I WHERE c = 1 AND t = 2 AND y < 3")
register("imaging_image_pixels", lambda s, d: plane(s, d, 0, 3).pixels(), f"WITH {PIXELS} SELECT y, x, v FROM I WHERE c = 0 AND t = 3")
register("imaging_image_dims", lambda s, d: plane(s, d).dims(), f"WITH {PIXELS} SELECT max(x) + 1 AS width, max(y) + 1 AS height FROM I WHERE c = 1 AND t = 2")
register("imaging_primary_channel_idx", lambda s, d: imaging.primary_channel_idx(imaged(s, d)["channels"]), "SELECT 1 AS idx")


def dense(s: SparkSession, d: str) -> imaging.Image:
    """The sums of the vectors' first 8 components by their number modulo 6: an image without holes."""
    x = read(s, d, "embeddings").select((F.col("vec_id") % 6).cast("int").alias("y"), F.posexplode(F.slice("embedding", 1, 8)).alias("x", "e"))
    return imaging.Image(x.groupBy("y", "x").agg(F.max(F.pmod(F.floor(F.col("e").cast("double") * 256), F.lit(256))).cast("int").alias("v")))


DENSE = "J AS (SELECT y, x, max((floor(e * 256)::BIGINT % 256 + 256) % 256)::INTEGER AS v FROM (SELECT (vec_id % 6)::INTEGER AS y, unnest(range(8))::INTEGER AS x, unnest(embedding[1:8])::DOUBLE AS e FROM embeddings) GROUP BY ALL)"


def written_pgm(s: SparkSession, d: str) -> DataFrame:
    path = dense(s, d).pgm(f"{scratch(s, 'image')}/plane.pgm")
    return s.read.text(path, wholetext=True)


register("imaging_image_pgm", lambda s, d: written_pgm(s, d).select(F.col("value").alias("text")), f"WITH {DENSE} SELECT 'P2' || chr(10) || '8 6' || chr(10) || '255' || chr(10) || string_agg(v::VARCHAR, ' ' ORDER BY y, x) || chr(10) AS text FROM J")


def png_pixels(s: SparkSession, d: str) -> DataFrame:
    """The pixels of a written PNG, read back."""
    import struct
    import zlib

    body = bytes(s.read.format("binaryFile").load(dense(s, d).png(f"{scratch(s, 'image')}/plane.png")).first()["content"])
    width, height = struct.unpack(">II", body[16:24])
    at = body.index(b"IDAT")
    raw = zlib.decompress(body[at + 4 : at + 4 + struct.unpack(">I", body[at - 4 : at])[0]])
    return s.createDataFrame([(y, x, raw[y * (width + 1) + 1 + x]) for y in range(height) for x in range(width)], "y int, x int, v int")


register("imaging_image_png", png_pixels, f"WITH {DENSE} SELECT y, x, v FROM J")


def converted(s: SparkSession, d: str) -> DataFrame:
    width, _, values = imaging.pnm_to_png(written_pgm(s, d).first()["value"])
    return s.createDataFrame([(n // width, n % width, v) for n, v in enumerate(values)], "y int, x int, v int")


register("imaging_image_pnm2png", converted, f"WITH {DENSE} SELECT y, x, v FROM J")
register("imaging_make_gallery", lambda s, d: position(s, d).get_image_handle().make_gallery([dense(s, d), imaging.Image(dense(s, d).pixels().where("x < 3")), dense(s, d)]).pixels(), f"WITH {DENSE} SELECT y, x, v FROM J UNION ALL SELECT y, x + 8, v FROM J WHERE x < 3 UNION ALL SELECT y, x + 11, v FROM J")
objects = lambda s, d: position(s, d).get_object_handle()
everything = lambda s, d: objects(s, d).get_all_objects()
register("imaging_object_handle_new", lambda s, d: imaging.ObjectHandle(position(s, d)).get_all_objects().idx(), f"WITH {V} SELECT idx FROM V")
register("imaging_object_handle_position", lambda s, d: told(s, ("position", objects(s, d).position().path)), f"WITH {PLACES} SELECT 'position' AS what, path AS value FROM N WHERE n_nationkey = 3")
register("imaging_all_objects", lambda s, d: everything(s, d).df, f"WITH {V} SELECT idx, obj_label_id, time_idx, class_idx FROM V")
first_idx = "(SELECT min(vec_id) FROM embeddings WHERE label = 3)"
some = lambda s, d: objects(s, d).get_object_by_idx(read(s, d, "embeddings").where("label = 3").agg(F.min("vec_id")).first()[0])
register("imaging_object_by_idx", lambda s, d: some(s, d).df, f"WITH {V} SELECT idx, obj_label_id, time_idx, class_idx FROM V WHERE idx = {first_idx}")
register("imaging_object_new", lambda s, d: imaging.Objects(objects(s, d), some(s, d).df).idx(), f"SELECT {first_idx} AS idx")
register("imaging_object_position", lambda s, d: told(s, ("position", some(s, d).position().path)), f"WITH {PLACES} SELECT 'position' AS what, path AS value FROM N WHERE n_nationkey = 3")
register("imaging_all_objects_by_time", lambda s, d: objects(s, d).get_all_objects_by_time(1).df, f"WITH {V} SELECT idx, obj_label_id, time_idx, class_idx FROM V WHERE time_idx = 1")
features = lambda df: df.select("idx", F.posexplode("features").alias("n", "v")).select("idx", "n", F.round(F.col("v").cast("double"), 6).alias("v"))
FEATURES = "SELECT idx, n, round(v, 6) AS v FROM (SELECT idx, unnest(range(len(embedding)))::INTEGER AS n, unnest(embedding)::DOUBLE AS v FROM V{})"
register("imaging_all_features", lambda s, d: features(objects(s, d).get_all_features()), f"WITH {V} {FEATURES.format('')}")
register("imaging_object_features", lambda s, d: features(some(s, d).features()), f"WITH {V} {FEATURES.format(f' WHERE idx = {first_idx}')}")
register("imaging_tracking_data", lambda s, d: objects(s, d).get_tracking_data().select("idx", joined("children"), joined("parents")), f"WITH {EDGES} SELECT idx, coalesce(string_agg(child::VARCHAR, ','), '') AS children, coalesce(string_agg(parent::VARCHAR, ','), '') AS parents FROM (SELECT obj_idx1 AS idx, obj_idx2 AS child, NULL AS parent FROM K UNION ALL SELECT obj_idx2, NULL, obj_idx1 FROM K) GROUP BY idx")
register("imaging_classification_data", lambda s, d: objects(s, d).get_classification_data(), f"WITH {V} SELECT idx, class_idx AS label_idx FROM V")
register("imaging_all_centers", lambda s, d: objects(s, d).get_all_centers(), f"WITH {V} SELECT idx, x, y, z FROM V")
BOX = "idx, y - 1 AS top, y + 2 AS bottom, x - 2 AS left, x + 1 AS right"
register("imaging_all_bounding_boxes", lambda s, d: objects(s, d).get_all_bounding_boxes(), f'WITH {V} SELECT idx, y - 1 AS top, y + 2 AS bottom, x - 2 AS "left", x + 1 AS "right" FROM V')
register("imaging_object_idx", lambda s, d: everything(s, d).idx(), f"WITH {V} SELECT idx FROM V")
register("imaging_object_label_id", lambda s, d: everything(s, d).label_id(), f"WITH {V} SELECT idx, obj_label_id FROM V")
register("imaging_object_time_idx", lambda s, d: everything(s, d).time_idx(), f"WITH {V} SELECT idx, time_idx FROM V")
register("imaging_object_center", lambda s, d: objects(s, d).get_all_objects_by_time(2).center(), f"WITH {V} SELECT idx, x, y, z FROM V WHERE time_idx = 2")
register("imaging_object_bounding_box", lambda s, d: objects(s, d).get_all_objects_by_time(2).bounding_box(), f'WITH {V} SELECT idx, y - 1 AS top, y + 2 AS bottom, x - 2 AS "left", x + 1 AS "right" FROM V WHERE time_idx = 2')
register("imaging_object_class", lambda s, d: everything(s, d).class_().select("idx", "class_idx", "class_label", "class_name", "color"), f"WITH {V}, {CLASSES} SELECT V.idx, class_idx, Z.label AS class_label, name AS class_name, color FROM V JOIN Z ON Z.idx = class_idx")
register("imaging_object_class_idx", lambda s, d: everything(s, d).class_idx(), f"WITH {V} SELECT idx, class_idx FROM V")
register("imaging_object_class_probability", lambda s, d: everything(s, d).class_probability().select("idx", F.round("class_probability", 6).alias("p")), f"WITH {V} SELECT idx, round(abs(embedding[class_idx + 1]::DOUBLE) / list_sum(list_transform(embedding[1:10], lambda e: abs(e::DOUBLE))), 6) AS p FROM V")
register("imaging_object_parents", lambda s, d: everything(s, d).parents(), f"WITH {EDGES} SELECT obj_idx2 AS idx, obj_idx1 AS parent FROM K")
register("imaging_object_children", lambda s, d: everything(s, d).children(), f"WITH {EDGES} SELECT obj_idx1 AS idx, obj_idx2 AS child FROM K")
CROP = """SELECT B.idx, dy::INTEGER AS y, dx::INTEGER AS x, coalesce(I.v, 0) AS v FROM B CROSS JOIN range({h}) a(dy) CROSS JOIN range({w}) b(dx)
    LEFT JOIN I ON I.c = 1 AND I.t = B.time_idx AND I.y = B.top + dy AND I.x = B.lft + dx"""
register("imaging_object_get_image", lambda s, d: everything(s, d).get_image(), f"WITH {PIXELS}, B AS (SELECT idx, time_idx, y - 1 AS top, x - 2 AS lft FROM V) {CROP.format(h=4, w=4)}")
register("imaging_object_get_image_sized", lambda s, d: everything(s, d).get_image(5, 3), f"WITH {PIXELS}, B AS (SELECT idx, time_idx, y - 1 AS top, x - 2 AS lft FROM V) {CROP.format(h=3, w=5)}")


# containers: a group for every region, in it groups for its nations, and a dataset of its suppliers' balances
def filled(s: SparkSession, d: str) -> Container:
    c = Container.new(s, scratch(s, "container"), overwrite=True)
    regions = read(s, d, "region").orderBy("r_regionkey").collect()
    nations = read(s, d, "nation").orderBy("n_nationkey").collect()
    balance = read(s, d, "supplier").join(read(s, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    for r in regions:
        c.create_group(f"/{r['r_name']}")
        for n in nations:
            if n["n_regionkey"] == r["r_regionkey"]:
                c.create_group(f"/{r['r_name']}/{n['n_name']}")
    ours = read(s, d, "nation").where("n_nationkey < 3").join(read(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).collect()
    for n in ours:
        rows = balance.where(F.col("n_nationkey") == n["n_nationkey"]).select(F.array("s_suppkey").alias("idx"), F.col("s_acctbal").alias("value"))
        c.write_data(f"/{n['r_name']}/{n['n_name']}/balance", rows, [rows.count()], "float", f"nation {n['n_nationkey']}")
    return c


def path_of(s: SparkSession, d: str, key: int = 1) -> str:
    return "/{}/{}".format(*nation_place(s, d, key))


def dataset(s: SparkSession, d: str, key: int = 1) -> Dataset:
    return filled(s, d).open_dataset(f"{path_of(s, d, key)}/balance")


def group(s: SparkSession, d: str, key: int = 1) -> Group:
    return filled(s, d).open_group(path_of(s, d, key))


G = "N AS (SELECT n_nationkey, n_name, r_name, '/' || r_name || '/' || n_name AS path, n_regionkey FROM nation JOIN region ON n_regionkey = r_regionkey)"
ONE = "FROM N WHERE n_nationkey = 1"
VALUES = "SELECT s_suppkey AS idx, round(s_acctbal, 6) AS value FROM supplier WHERE s_nationkey = 1"
values = lambda df: df.select(F.col("idx")[0].alias("idx"), F.round("value", 6).alias("value"))
ALL = "SELECT '/' || r_name AS path, 2 AS depth FROM region UNION ALL SELECT path, 3 FROM N"


def c_query(name: str, f: Callable[[SparkSession, str], DataFrame], sql: str) -> None:
    register(f"container_{name}", f, f"WITH {G} {sql}")


def raised(f: Callable[[], object]) -> str:
    try:
        f()
    except (KeyError, FileExistsError, FileNotFoundError, ValueError, PermissionError) as e:
        return type(e).__name__
    return "none"


def reopened(s: SparkSession, d: str, mode: str = "rw") -> Container:
    c = filled(s, d)
    c.close()
    return Container.open(s, c.folder, mode)


c_query("file_new", lambda s, d: filled(s, d).get_all_groups(), ALL)
c_query("file_open", lambda s, d: reopened(s, d).get_all_groups(), ALL)
c_query("file_open_readonly", lambda s, d: (lambda c: c.get_groups().withColumn("refused", F.lit(raised(lambda: c.create_group("/x")))))(reopened(s, d, "readonly")), "SELECT r_name AS name, 'PermissionError' AS refused FROM region")
c_query("file_close", lambda s, d: (lambda c: told(s, ("closed", str(c.close())), ("again", str(c.close())), ("use", raised(c.get_all_groups))))(filled(s, d)), "SELECT * FROM (VALUES ('closed', 'True'), ('again', 'False'), ('use', 'ValueError')) v(what, value)")
c_query("file_flush", lambda s, d: (lambda c: c.flush() or Container.open(s, c.folder).catalog().select("path", "kind"))(filled(s, d)), "SELECT '/' || r_name AS path, 'group' AS kind FROM region UNION ALL SELECT path, 'group' FROM N UNION ALL SELECT path || '/balance', 'dataset' FROM N WHERE n_nationkey < 3")
c_query("file_reopen", lambda s, d: filled(s, d).reopen().get_groups(), "SELECT r_name AS name FROM region")
c_query("file_is_open", lambda s, d: (lambda c: told(s, ("before", str(c.is_open())), ("closed", str(c.close())), ("after", str(c.is_open()))))(filled(s, d)), "SELECT * FROM (VALUES ('before', 'True'), ('closed', 'True'), ('after', 'False')) v(what, value)")
c_query("file_name", lambda s, d: told(s, ("name", str(filled(s, d).name().startswith("container-")))), "SELECT 'name' AS what, 'True' AS value")
c_query("file_id", lambda s, d: (lambda c: s.createDataFrame([(str(c.id()), c.get_groups().count())], "id string, n long"))(filled(s, d)), "SELECT '0' AS id, count(*) AS n FROM region")
c_query("file_create_group", lambda s, d: (lambda c: c.create_group("/new") or c.get_groups())(filled(s, d)), "SELECT r_name AS name FROM region UNION ALL SELECT 'new'")
c_query("file_open_group", lambda s, d: (lambda c: c.open_group("/" + nation_place(s, d)[0]).get_groups())(filled(s, d)), "SELECT n_name AS name FROM N WHERE n_regionkey = (SELECT n_regionkey FROM nation WHERE n_nationkey = 3)")


def mounted(s: SparkSession, d: str) -> Container:
    c, other = filled(s, d), Container.new(s, scratch(s, "container"), overwrite=True)
    for n in read(s, d, "nation").where("n_regionkey = 0").collect():
        other.create_group(f"/{n['n_name']}")
    c.create_group("/mnt")
    c.mount("/mnt", other)
    return c


c_query("file_mount", lambda s, d: mounted(s, d).get_groups("/mnt"), "SELECT n_name AS name FROM N WHERE n_regionkey = 0")
c_query("file_unmount", lambda s, d: (lambda c: c.unmount("/mnt") or c.get_all_groups())(mounted(s, d)), f"{ALL} UNION ALL SELECT '/mnt', 2")
c_query("group_new", lambda s, d: (lambda g: g.create_group("inner").file().get_groups(g.path))(group(s, d)), "SELECT 'inner' AS name")
c_query("group_open", lambda s, d: (lambda g, c: told(s, ("path", g.path), ("missing", raised(lambda: c.open_group("/missing"))), ("dataset", raised(lambda: c.open_group(g.path + "/balance")))))(*(lambda c: (c.open_group(path_of(s, d)), c))(filled(s, d))), f"SELECT 'path' AS what, path AS value {ONE} UNION ALL SELECT 'missing', 'KeyError' UNION ALL SELECT 'dataset', 'KeyError'")
c_query("group_close", lambda s, d: (lambda g: told(s, ("closed", str(g.close())), ("again", str(g.close())), ("use", raised(g.get_groups))))(group(s, d)), "SELECT * FROM (VALUES ('closed', 'True'), ('again', 'False'), ('use', 'ValueError')) v(what, value)")
c_query("group_id", lambda s, d: (lambda c: s.createDataFrame([(r["path"], c.open_group(r["path"]).id()) for r in c.get_all_groups().collect()], "path string, id long"))(filled(s, d)), "SELECT path, row_number() OVER (ORDER BY n_regionkey, k) AS id FROM (SELECT '/' || r_name AS path, r_regionkey AS n_regionkey, -1 AS k FROM region UNION ALL SELECT path, n_regionkey, n_nationkey FROM N)")
c_query("group_name", lambda s, d: told(s, ("name", group(s, d).name())), f"SELECT 'name' AS what, n_name AS value {ONE}")
c_query("group_file", lambda s, d: group(s, d).file().get_groups(), "SELECT r_name AS name FROM region")
c_query("group_is_open", lambda s, d: (lambda g: told(s, ("before", str(g.is_open())), ("file", str(g.file().close())), ("after", str(g.is_open()))))(group(s, d)), "SELECT * FROM (VALUES ('before', 'True'), ('file', 'True'), ('after', 'False')) v(what, value)")
c_query("group_get_datasets", lambda s, d: group(s, d).get_datasets(), "SELECT 'balance' AS name")
c_query("group_open_dataset", lambda s, d: values(group(s, d).open_dataset("balance").read_data()), VALUES)
c_query("group_get_groups", lambda s, d: filled(s, d).open_group("/" + nation_place(s, d)[0]).get_groups(), "SELECT n_name AS name FROM N WHERE n_regionkey = (SELECT n_regionkey FROM nation WHERE n_nationkey = 3)")
c_query("group_get_all_groups", lambda s, d: filled(s, d).open_group("/" + nation_place(s, d)[0]).get_all_groups(), "SELECT path, 3 AS depth FROM N WHERE n_regionkey = (SELECT n_regionkey FROM nation WHERE n_nationkey = 3)")
c_query("group_get_parent", lambda s, d: told(s, ("parent", group(s, d).get_parent())), f"SELECT 'parent' AS what, '/' || r_name AS value {ONE}")
c_query("group_move", lambda s, d: (lambda g: g.move("/", "moved") and g.file().catalog().where(F.col("path").startswith("/moved")).select("path", "kind"))(group(s, d)), "SELECT '/moved' AS path, 'group' AS kind UNION ALL SELECT '/moved/balance', 'dataset'")
c_query("group_rename", lambda s, d: (lambda g: g.rename("renamed") and g.file().get_groups(g.get_parent()))(group(s, d)), "SELECT CASE WHEN n_nationkey = 1 THEN 'renamed' ELSE n_name END AS name FROM N WHERE n_regionkey = (SELECT n_regionkey FROM nation WHERE n_nationkey = 1)")
c_query("dataset_new", lambda s, d: (lambda c: c.write_data("/names", read(s, d, "nation").select(F.array(F.col("n_nationkey").cast("long")).alias("idx"), F.col("n_name").alias("value")), [25], "string") or c.read_data("/names").select(F.col("idx")[0].alias("idx"), "value"))(filled(s, d)), "SELECT n_nationkey::BIGINT AS idx, n_name AS value FROM N")
c_query("dataset_open", lambda s, d: values(dataset(s, d).read_data()), VALUES)
c_query("dataset_open_missing", lambda s, d: told(s, ("missing", raised(lambda: filled(s, d).open_dataset("/missing")))), "SELECT 'missing' AS what, 'KeyError' AS value")
c_query("dataset_close", lambda s, d: (lambda x: told(s, ("closed", str(x.close())), ("again", str(x.close())), ("use", raised(x.read_data))))(dataset(s, d)), "SELECT * FROM (VALUES ('closed', 'True'), ('again', 'False'), ('use', 'ValueError')) v(what, value)")
c_query("dataset_id", lambda s, d: (lambda x: s.createDataFrame([(x.path, x.id())], "path string, id long"))(dataset(s, d, 0)), "SELECT path || '/balance' AS path, (SELECT count(*) FROM region) + (SELECT count(*) FROM nation) + 1 AS id FROM N WHERE n_nationkey = 0")
c_query("dataset_name", lambda s, d: told(s, ("name", dataset(s, d).name())), "SELECT 'name' AS what, 'balance' AS value")
c_query("dataset_dims", lambda s, d: s.createDataFrame([(k, dataset(s, d, k).dims()[0]) for k in (0, 1, 2)], "nation long, n long"), "SELECT n_nationkey::BIGINT AS nation, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS n FROM N WHERE n_nationkey < 3")
c_query("dataset_datatype", lambda s, d: filled(s, d).catalog().where("kind = 'dataset'").select("path", "dtype"), "SELECT path || '/balance' AS path, 'float' AS dtype FROM N WHERE n_nationkey < 3")
c_query("dataset_tag", lambda s, d: (lambda x: told(s, ("before", x.tag()), ("set", x.tag("other")), ("after", x.file().reopen().tag(x.path))))(dataset(s, d)), "SELECT * FROM (VALUES ('before', 'nation 1'), ('set', 'other'), ('after', 'other')) v(what, value)")
c_query("dataset_file", lambda s, d: dataset(s, d).file().get_groups(), "SELECT r_name AS name FROM region")
c_query("dataset_group", lambda s, d: told(s, ("group", dataset(s, d).group().path)), f"SELECT 'group' AS what, path AS value {ONE}")
c_query("dataset_is_open", lambda s, d: (lambda x: told(s, ("before", str(x.is_open())), ("closed", str(x.close())), ("after", str(x.is_open()))))(dataset(s, d)), "SELECT * FROM (VALUES ('before', 'True'), ('closed', 'True'), ('after', 'False')) v(what, value)")
c_query("dataset_write_data", lambda s, d: (lambda x: x.write_data(x.read_data().withColumn("value", F.col("value") * 2)) or values(x.read_data()))(dataset(s, d)), VALUES.replace("s_acctbal", "s_acctbal * 2"))
c_query("dataset_read_data", lambda s, d: values(dataset(s, d, 2).read_data()), VALUES.replace("= 1", "= 2"))
c_query("dataset_read_data_slice", lambda s, d: values(dataset(s, d).read_data_slice([0], [50], [1000], [20])), f"{VALUES} AND s_suppkey % 50 < 20 AND s_suppkey < 50 * 999 + 20")
c_query("dataset_move", lambda s, d: (lambda x: x.move("/", "moved") and values(x.file().read_data("/moved")))(dataset(s, d)), VALUES)
