"""Cell imaging: objects, tracking, events, classes and pixels of plate positions, as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Where plates, wells and positions stand in a container.
PLATES, WELLS, POSITIONS = "/sample/0/plate", "experiment", "position"


def all_objects(objects: DataFrame, prediction: DataFrame | None = None) -> DataFrame:
    """Objects by idx, with their class index where a prediction is given."""
    return objects if prediction is None else objects.join(prediction.select("idx", F.col("label_idx").alias("class_idx")), "idx", "left")


def objects_by_time(objects: DataFrame, time_idx: int) -> DataFrame:
    return objects.where(F.col("time_idx") == time_idx)


def object_by_idx(objects: DataFrame, idx: int) -> DataFrame:
    return objects.where(F.col("idx") == idx)


def tracking_data(edges: DataFrame) -> DataFrame:
    """(idx, children, parents): sorted neighbours of every object in the tracking edges (obj_idx1, obj_idx2)."""
    sided = edges.select(F.col("obj_idx1").alias("idx"), F.col("obj_idx2").alias("child"), F.lit(None).cast("long").alias("parent")).unionByName(edges.select(F.col("obj_idx2").alias("idx"), F.lit(None).cast("long").alias("child"), F.col("obj_idx1").alias("parent")))
    return sided.groupBy("idx").agg(F.sort_array(F.collect_list("child")).alias("children"), F.sort_array(F.collect_list("parent")).alias("parents"))


def children(objects: DataFrame, edges: DataFrame, idx: int) -> DataFrame:
    return objects.join(edges.where(F.col("obj_idx1") == idx).select(F.col("obj_idx2").alias("idx")), "idx", "left_semi")


def parents(objects: DataFrame, edges: DataFrame, idx: int) -> DataFrame:
    return objects.join(edges.where(F.col("obj_idx2") == idx).select(F.col("obj_idx1").alias("idx")), "idx", "left_semi")


def all_events(links: DataFrame) -> DataFrame:
    """(obj_id, objects): the distinct objects of each event in order of first appearance; links (obj_id, pos, idx1, idx2)."""
    seen = links.select("obj_id", "pos", F.posexplode(F.array("idx1", "idx2")).alias("side", "idx"))
    first = seen.groupBy("obj_id", "idx").agg(F.min(F.col("pos") * 2 + F.col("side")).alias("at"))
    return first.groupBy("obj_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "idx"))), lambda s: s["idx"]).alias("objects"))


def event_by_id(links: DataFrame, obj_id: int) -> DataFrame:
    return all_events(links.where(F.col("obj_id") == obj_id))


def all_classes(classes: DataFrame) -> DataFrame:
    """Class rows with their ordinal idx; classes (label, name, color) in order of ord."""
    return classes.select((F.row_number().over(Window.orderBy("ord")) - 1).alias("idx"), "label", "name", "color")  # a handful of class labels


def object_classes(objects: DataFrame, prediction: DataFrame, classes: DataFrame, probability: DataFrame | None = None) -> DataFrame:
    """Objects with class index, label, name, colour, and the probability of that class."""
    named = classes.select(F.col("idx").alias("class_idx"), F.col("label").alias("class_label"), F.col("name").alias("class_name"), "color")
    out = all_objects(objects, prediction).join(named, "class_idx", "left")
    if probability is not None:
        out = out.join(probability, "idx", "left").withColumn("class_probability", F.try_element_at("probs", F.col("class_idx") + 1)).drop("probs")
    return out


def centers(rows: DataFrame) -> DataFrame:
    """(idx, x, y, z), z 0 where there is none."""
    z = F.coalesce("z", F.lit(0)) if "z" in rows.columns else F.lit(0)
    return rows.select("idx", "x", "y", z.alias("z"))


def image(pixels: DataFrame, c: int, t: int, z: int) -> DataFrame:
    """(y, x, v) of one plane of pixels (c, t, z, y, x, v)."""
    return pixels.where((F.col("c") == c) & (F.col("t") == t) & (F.col("z") == z)).select("y", "x", "v")


def image_dims(plane: DataFrame) -> DataFrame:
    """Width first."""
    return plane.agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"))


def primary_channel_idx(channels: DataFrame) -> DataFrame:
    return channels.where("channel_name = 'primary'").agg(F.min("idx").alias("idx"))


def crop(plane: DataFrame, boxes: DataFrame) -> DataFrame:
    """(idx, y, x, v) of a plane in boxes (idx, top, left, height, width), zero outside the plane."""
    cells = boxes.select("idx", "top", "left", F.explode(F.sequence(F.lit(0), F.col("height") - 1)).alias("y"), "width").select("idx", "top", "left", "y", F.explode(F.sequence(F.lit(0), F.col("width") - 1)).alias("x"))
    source = plane.select(F.col("y").alias("py"), F.col("x").alias("px"), "v")
    return cells.join(source, (F.col("top") + F.col("y") == F.col("py")) & (F.col("left") + F.col("x") == F.col("px")), "left").select("idx", "y", "x", F.coalesce("v", F.lit(0)).alias("v"))


def object_boxes(bounds: DataFrame, middle: DataFrame, width: int | None = None, height: int | None = None) -> DataFrame:
    """Boxes of objects: their own bounds, or of a fixed size about their centres."""
    if width is None and height is None:
        return bounds.select("idx", "top", "left", (F.col("bottom") - F.col("top") + 1).alias("height"), (F.col("right") - F.col("left") + 1).alias("width"))
    width, height = width or height, height or width
    return middle.select("idx", (F.col("y") - height // 2).alias("top"), (F.col("x") - width // 2).alias("left"), F.lit(height).alias("height"), F.lit(width).alias("width"))


def make_gallery(tiles: DataFrame) -> DataFrame:
    """(y, x, v): tiles (ord, y, x, v) side by side."""
    widths = tiles.groupBy("ord").agg((F.max("x") + 1).alias("w"))
    offset = F.coalesce(F.sum("w").over(Window.orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row a tile
    return tiles.join(widths.select("ord", offset.alias("o")), "ord").select("y", (F.col("x") + F.col("o")).alias("x"), "v")


def pgm(plane: DataFrame) -> str:
    """An ASCII grey map of one plane."""
    rows = plane.groupBy("y").agg(F.sort_array(F.collect_list(F.struct("x", "v"))).alias("r")).orderBy("y").collect()  # one image
    values = [str(c["v"]) for r in rows for c in r["r"]]
    width = len(rows[0]["r"]) if rows else 0
    return f"P2\n{width} {len(rows)}\n255\n" + "\n".join(" ".join(values[k : k + 70]) for k in range(0, len(values), 70)) + "\n"


class File:
    """The plates of a container, by its catalog (path, parent, name, kind)."""

    def __init__(self, catalog: DataFrame, tables: dict[str, DataFrame] | None = None):
        self.catalog, self.tables = catalog, tables or {}

    def groups(self, parent: str) -> DataFrame:
        """(name, path) of the groups under a path."""
        return self.catalog.where((F.col("parent") == parent) & (F.col("kind") == "group")).select("name", "path").distinct()

    def find(self, parent: str, name: str) -> str:
        path = f"{parent}/{name}"
        if not self.catalog.where((F.col("path") == path) & (F.col("kind") == "group")).limit(1).count():
            raise KeyError(path)
        return path

    def plates(self) -> DataFrame:
        return self.groups(PLATES)

    def get_plate_by_name(self, name: str) -> Plate:
        return Plate(self, name)

    def get_all_classes(self) -> DataFrame:
        return ClassHandle(self).get_all_classes()

    def all_positions(self) -> DataFrame:
        """(plate, well, position, path) of the whole container in one scan."""
        parts = F.split("path", "/")
        inside = F.col("path").rlike(f"^{PLATES}/[^/]+/{WELLS}/[^/]+/{POSITIONS}/[^/]+$") & (F.col("kind") == "group")
        return self.catalog.where(inside).select(parts[4].alias("plate"), parts[6].alias("well"), parts[8].alias("position"), "path").distinct()


class Plate:
    def __init__(self, file: File, name: str):
        self._file, self.name, self.path = file, name, file.find(PLATES, name)

    def file(self) -> File:
        return self._file

    def wells(self) -> DataFrame:
        """(name, path) of the wells; each once, however often it is asked."""
        return self._file.groups(f"{self.path}/{WELLS}")

    def get_well(self, name: str) -> Well:
        return Well(self, name)


class Well:
    def __init__(self, plate: Plate, name: str):
        self._plate, self.name, self.path = plate, name, plate.file().find(f"{plate.path}/{WELLS}", name)

    def plate(self) -> Plate:
        return self._plate

    def positions(self) -> DataFrame:
        return self._plate.file().groups(f"{self.path}/{POSITIONS}")

    def get_position(self, name: str) -> Position:
        return Position(self, name)


class Position:
    """A position; its tables are the rows of the container's tables with its path, or all where they have none."""

    def __init__(self, well: Well, name: str):
        self._well, self.name = well, name
        self.path = well.plate().file().find(f"{well.path}/{POSITIONS}", name)

    def well(self) -> Well:
        return self._well

    def file(self) -> File:
        return self._well.plate().file()

    def table(self, name: str) -> DataFrame:
        df = self.file().tables[name]
        return df.where(F.col("path") == self.path).drop("path") if "path" in df.columns else df

    def get_image_handle(self) -> ImageHandle:
        return ImageHandle(self)

    def get_object_handle(self) -> ObjectHandle:
        return ObjectHandle(self)

    def get_event_handle(self) -> EventHandle:
        return EventHandle(self)


class ClassHandle:
    """The classes of a container, table `classes` (ord, label, name, color)."""

    def __init__(self, file: File):
        self._file = file

    def file(self) -> File:
        return self._file

    def get_all_classes(self) -> DataFrame:
        return all_classes(self._file.tables["classes"])


class Classes:
    """Accessors of class rows (idx, label, name, color)."""

    def __init__(self, df: DataFrame):
        self.df = df

    def idx(self) -> DataFrame:
        return self.df.select("idx")

    def label(self) -> DataFrame:
        return self.df.select("idx", "label")

    def name(self) -> DataFrame:
        return self.df.select("idx", "name")

    def color(self, value: str | Column | None = None, where: Column | None = None) -> DataFrame | Classes:
        """The colours; with a value, the classes with it set for those that the condition holds of."""
        if value is None:
            return self.df.select("idx", "color")
        new = value if isinstance(value, Column) else F.lit(value)
        return Classes(self.df.withColumn("color", new if where is None else F.when(where, new).otherwise(F.col("color"))))


class ImageHandle:
    """Pixels (c, t, z, y, x, v) and channels (idx, channel_name) of a position."""

    def __init__(self, position: Position):
        self._position = position

    def position(self) -> Position:
        return self._position

    def new_image(self, pixels: DataFrame) -> Image:
        return Image(pixels)

    def get_image(self, c: int, t: int, z: int) -> Image:
        return self.new_image(image(self._position.table("pixels"), c, t, z))

    def get_primary_channel_idx(self) -> int:
        return primary_channel_idx(self._position.table("channels")).first()["idx"]

    def make_gallery(self, images: list[Image]) -> Image:
        """Images of one height side by side."""
        tiles = [x.pixels().select(F.lit(n).alias("ord"), "y", "x", "v") for n, x in enumerate(images)]
        every = tiles[0]
        for tile in tiles[1:]:
            every = every.unionByName(tile)
        heights = every.groupBy("ord").agg(F.max("y").alias("h")).select("h").distinct().count()
        if heights > 1:
            raise ValueError("images of one height are needed")
        return self.new_image(make_gallery(every))


class Image:
    def __init__(self, pixels: DataFrame):
        self._pixels = pixels

    def pixels(self) -> DataFrame:
        return self._pixels

    def dims(self) -> DataFrame:
        return image_dims(self._pixels)

    def pgm(self, path: str) -> str:
        """Writes the ASCII grey map to a path of Spark's file systems."""
        return _put(self._pixels.sparkSession, path, pgm(self._pixels).encode())

    def png(self, path: str) -> str:
        """Writes a grey PNG to a path of Spark's file systems."""
        return _put(self._pixels.sparkSession, path, png(self._pixels))


def _put(spark, path: str, body: bytes) -> str:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where, True)
    out.write(bytearray(body))
    out.close()
    return path


def png(plane: DataFrame) -> bytes:
    """An 8-bit grey PNG of one plane, by the standard's chunks; missing pixels are 0."""
    import struct
    import zlib

    import numpy as np

    size = image_dims(plane).first()
    width, height = size["width"] or 0, size["height"] or 0
    pixels = np.zeros((height, width), dtype=np.uint8)
    for r in plane.collect():  # one image
        pixels[r["y"], r["x"]] = min(255, max(0, int(r["v"])))

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    rows = b"".join(b"\0" + pixels[y].tobytes() for y in range(height))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def pnm_to_png(text: str) -> tuple[int, int, list[int]]:
    """Width, height and values of an ASCII grey map, as a converter reads it."""
    numbers = [int(x) for line in text.splitlines()[1:] for x in line.split("#")[0].split()]
    return numbers[0], numbers[1], numbers[3:]


class ObjectHandle:
    """Objects of a position: tables objects (idx, obj_label_id, time_idx), prediction (idx, label_idx), probability
    (idx, probs), features (idx, features), centers (idx, x, y, z), boxes (idx, top, bottom, left, right), tracking."""

    def __init__(self, position: Position):
        self._position = position

    def position(self) -> Position:
        return self._position

    def get_all_objects(self) -> Objects:
        return Objects(self, all_objects(self._position.table("objects"), self._position.table("prediction")))

    def get_object_by_idx(self, idx: int) -> Objects:
        return Objects(self, object_by_idx(self.get_all_objects().df, idx))

    def get_all_objects_by_time(self, time_idx: int) -> Objects:
        return Objects(self, objects_by_time(self.get_all_objects().df, time_idx))

    def get_all_features(self) -> DataFrame:
        return self._position.table("features").select("idx", "features")

    def get_tracking_data(self) -> DataFrame:
        return tracking_data(self._position.table("tracking"))

    def get_classification_data(self) -> DataFrame:
        return self._position.table("prediction").select("idx", "label_idx")

    def get_all_centers(self) -> DataFrame:
        return centers(self._position.table("centers"))

    def get_all_bounding_boxes(self) -> DataFrame:
        return self._position.table("boxes").select("idx", "top", "bottom", "left", "right")


class Objects:
    """Accessors of some objects of a position."""

    def __init__(self, handle: ObjectHandle, df: DataFrame):
        self._handle, self.df = handle, df

    def position(self) -> Position:
        return self._handle.position()

    def _own(self, df: DataFrame) -> DataFrame:
        return df.join(self.df.select("idx"), "idx", "left_semi")

    def idx(self) -> DataFrame:
        return self.df.select("idx")

    def label_id(self) -> DataFrame:
        return self.df.select("idx", "obj_label_id")

    def time_idx(self) -> DataFrame:
        return self.df.select("idx", "time_idx")

    def center(self) -> DataFrame:
        return self._own(self._handle.get_all_centers())

    def bounding_box(self) -> DataFrame:
        return self._own(self._handle.get_all_bounding_boxes())

    def features(self) -> DataFrame:
        return self._own(self._handle.get_all_features())

    def class_idx(self) -> DataFrame:
        return self.df.select("idx", "class_idx")

    def class_(self) -> DataFrame:
        """(idx, class_idx, class_label, class_name, color)."""
        position = self.position()
        classes = position.file().get_all_classes()
        return object_classes(self.df.drop("class_idx"), position.table("prediction"), classes).select("idx", "class_idx", "class_label", "class_name", "color")

    def class_probability(self) -> DataFrame:
        position = self.position()
        named = object_classes(self.df.drop("class_idx"), position.table("prediction"), position.file().get_all_classes(), position.table("probability"))
        return named.select("idx", "class_probability")

    def parents(self) -> DataFrame:
        """(idx, parent) over the tracking edges."""
        edges = self.position().table("tracking").select(F.col("obj_idx2").alias("idx"), F.col("obj_idx1").alias("parent"))
        return self._own(edges)

    def children(self) -> DataFrame:
        edges = self.position().table("tracking").select(F.col("obj_idx1").alias("idx"), F.col("obj_idx2").alias("child"))
        return self._own(edges)

    def get_image(self, width: int | None = None, height: int | None = None) -> DataFrame:
        """(idx, y, x, v): the primary channel about each object, at the object's own time."""
        position = self.position()
        primary = position.get_image_handle().get_primary_channel_idx()
        boxes = object_boxes(self.bounding_box(), self.center(), width, height).join(self.df.select("idx", "time_idx"), "idx")
        pixels = position.table("pixels").where((F.col("c") == primary) & (F.col("z") == 0))
        rows = boxes.select("*", F.explode(F.sequence(F.lit(0), F.col("height") - 1)).alias("y"))
        cells = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("width") - 1)).alias("x"))
        source = pixels.select(F.col("t").alias("pt"), F.col("y").alias("py"), F.col("x").alias("px"), "v")
        joined = cells.join(source, (F.col("time_idx") == F.col("pt")) & (F.col("top") + F.col("y") == F.col("py")) & (F.col("left") + F.col("x") == F.col("px")), "left")
        return joined.select("idx", "y", "x", F.coalesce("v", F.lit(0)).alias("v"))


class EventHandle:
    """Events of a position, table links (obj_id, pos, idx1, idx2)."""

    def __init__(self, position: Position):
        self._position = position

    def position(self) -> Position:
        return self._position

    def get_all_events(self) -> Events:
        return Events(self, all_events(self._position.table("links")))

    def get_event_by_id(self, obj_id: int) -> Events:
        return Events(self, event_by_id(self._position.table("links"), obj_id))


class Events:
    """Some events: obj_id and objects in order of first appearance."""

    def __init__(self, handle: EventHandle, df: DataFrame):
        self._handle, self.df = handle, df

    def position(self) -> Position:
        return self._handle.position()

    def id(self) -> DataFrame:
        return self.df.select("obj_id")

    def objects(self) -> DataFrame:
        return self.df.select("obj_id", "objects")
