"""Multi-well plates as tables: plates, wells, and the items that wells hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and columns of the standard formats.
FORMATS = {8: (2, 4), 48: (6, 8), 96: (8, 12), 384: (16, 24)}
#: The kinds of items and their named attributes; any other attribute lives in attrs.
ITEMS = {
    "sample": ("ID", "refDB", "name", "description", "EFOID", "EFOterm"),
    "treatment": ("ID", "refDB", "type", "description", "EFOID", "EFOterm"),
    "reporter": ("ID", "refDB", "type", "description", "EFOID", "EFOterm"),
    "data": ("ID", "type", "filepath", "filename", "format", "origin"),
}
WELLS = "plate_id string, position string, row string, row_idx int, col int, idx int, label string"


def plate(spark: SparkSession, plate_id: str, wells: int | None = None, rows: int | None = None, cols: int | None = None, **attributes) -> tuple[DataFrame, DataFrame]:
    """The plate's row and its wells, A1 and on, by rows."""
    if wells is not None:
        if wells not in FORMATS:
            raise ValueError(f"no format of {wells} wells")
        rows, cols = FORMATS[wells]
    if not rows or not cols or rows > 26:
        raise ValueError("1 to 26 rows and some columns are needed")
    kind = attributes.pop("type", f"{rows * cols}-well plate")
    row = spark.createDataFrame([(plate_id, attributes.pop("name", plate_id), kind, rows, cols, {k: str(v) for k, v in attributes.items()})], "plate_id string, name string, type string, nrows int, ncols int, attrs map<string,string>")
    return row, layout(row)


def layout(plates: DataFrame) -> DataFrame:
    """All wells of all plates."""
    cells = plates.select("plate_id", "ncols", F.explode(F.sequence(F.lit(0), F.col("nrows") - 1)).alias("r")).select("plate_id", "ncols", "r", F.explode(F.sequence(F.lit(1), F.col("ncols"))).alias("col"))
    letter = F.char((F.lit(65) + F.col("r")).cast("long"))
    return cells.select("plate_id", F.concat(letter, F.col("col").cast("string")).alias("position"), letter.alias("row"), (F.col("r") + 1).alias("row_idx"), F.col("col").cast("int").alias("col"), (F.col("r") * F.col("ncols") + F.col("col")).cast("int").alias("idx"), F.lit(None).cast("string").alias("label"))


def normal_position(position: Column) -> Column:
    """A01 as A1."""
    return F.regexp_replace(position, r"^([A-Z]+)0*([0-9]+)$", "$1$2")


def get_well(wells: DataFrame, position: str) -> DataFrame:
    return wells.where(F.col("position") == normal_position(F.lit(position)))


def get_well_by_idx(wells: DataFrame, idx: int) -> DataFrame:
    return wells.where(F.col("idx") == idx)


def get_row(wells: DataFrame, letter: str) -> DataFrame:
    return wells.where(F.col("row") == letter)


def get_col(wells: DataFrame, col: int) -> DataFrame:
    return wells.where(F.col("col") == col)


def items(spark: SparkSession, kind: str, rows: list[dict]) -> DataFrame:
    """Items of a kind: item_id from 0, the named attributes, and attrs for the others."""
    names = ITEMS[kind]
    values = [(n, *[r.get(k) for k in names], {k: str(v) for k, v in r.items() if k not in names}) for n, r in enumerate(rows)]
    return spark.createDataFrame(values, ", ".join(["item_id long", *[f"{k} string" for k in names], "attrs map<string,string>"]))


def attribute(df: DataFrame, name: str) -> Column:
    """A named column, or an entry of attrs."""
    return F.col(name) if name in df.columns else F.col("attrs")[name]


def set_attribute(df: DataFrame, name: str, value: str) -> DataFrame:
    if name in df.columns:
        return df.withColumn(name, F.lit(value))
    return df.withColumn("attrs", F.map_concat(F.map_filter("attrs", lambda k, _: k != name), F.create_map(F.lit(name), F.lit(value))))


def fill(held: DataFrame | None, plate_id: str, position: str, item_ids: list[int], spark: SparkSession) -> DataFrame:
    """Adds items to a well that holds none yet: (plate_id, position, ord, item_id)."""
    new = spark.createDataFrame([(plate_id, position, n, i) for n, i in enumerate(item_ids)], "plate_id string, position string, ord int, item_id long")
    if held is None:
        return new
    taken = held.select("plate_id", "position").distinct()
    return held.unionByName(new.join(taken, ["plate_id", "position"], "left_anti").select(*held.columns))


def filled_wells(wells: DataFrame, samples: DataFrame) -> DataFrame:
    return wells.join(samples.select("plate_id", "position"), ["plate_id", "position"], "left_semi")


def duplicate(held: DataFrame, source: tuple[str, str], target: tuple[str, str]) -> DataFrame:
    """The items of one well also in another, in place of what that held."""
    own = held.where((F.col("plate_id") == source[0]) & (F.col("position") == source[1])).withColumns({"plate_id": F.lit(target[0]), "position": F.lit(target[1])})
    return held.where(~((F.col("plate_id") == target[0]) & (F.col("position") == target[1]))).unionByName(own)


def replicate(df: DataFrame, copies: int) -> DataFrame:
    """So many copies of plates, wells or held items, under plate ids with the copy's number."""
    each = df.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(copies))))
    return each.withColumn("plate_id", F.concat_ws("-", "plate_id", F.col("copy").cast("string"))).drop("copy")


def accessor(name: str):
    """A method that reads a named attribute of all records, or sets it for some of them."""

    def method(self, value=None, where: Column | None = None):
        return self.attribute(name) if value is None else self.with_attribute(name, value, where)

    method.__name__, method.__doc__ = name, f"(key, value) of {name}; with a value, the records with it set."
    return method


class Records:
    """A table of records with named attributes; any other attribute lives in the map `attrs`."""

    key: tuple[str, ...] = ("item_id",)

    def __init__(self, df: DataFrame):
        self.df = df

    def attribute(self, name: str) -> DataFrame:
        """The key and the value of an attribute, null where a record has none."""
        return self.df.select(*self.key, attribute(self.df, name).alias("value"))

    def with_attribute(self, name: str, value: str | Column, where: Column | None = None):
        """The records with an attribute set, for those that the condition holds of (all without one)."""
        new = value if isinstance(value, Column) else F.lit(value)
        if name in self.df.columns:
            new = new.cast(self.df.schema[name].dataType)
            return type(self)(self.df.withColumn(name, new if where is None else F.when(where, new).otherwise(F.col(name))))
        held = F.coalesce("attrs", F.create_map().cast("map<string,string>"))
        changed = F.map_concat(F.map_filter(held, lambda k, _: k != name), F.create_map(F.lit(name), new.cast("string")))
        return type(self)(self.df.withColumn("attrs", changed if where is None else F.when(where, changed).otherwise(F.col("attrs"))))


class Samples(Records):
    ID, refDB, name, description, EFOID, EFOterm = map(accessor, ITEMS["sample"])


class Treatments(Records):
    ID, refDB, type, description, EFOID, EFOterm = map(accessor, ITEMS["treatment"])


class Reporters(Records):
    ID, refDB, type, description, EFOID, EFOterm = map(accessor, ITEMS["reporter"])


class Data(Records):
    ID, type, filepath, filename, format, origin = map(accessor, ITEMS["data"])


class Plates(Records):
    """Plates: plate_id, name, type, nrows, ncols, attrs."""

    key = ("plate_id",)
    ID, name, type, nrows, ncols = map(accessor, ("plate_id", "name", "type", "nrows", "ncols"))

    def wells(self) -> Wells:
        return Wells(layout(self.df).withColumn("attrs", F.create_map().cast("map<string,string>")))

    def data(self, held: DataFrame, add: DataFrame | None = None) -> DataFrame:
        """(plate_id, ord, item_id) of the plates' data, with more of them appended in order."""
        return appended(held, add, ("plate_id",)).join(self.df.select("plate_id"), "plate_id", "left_semi")


class Wells(Records):
    """Wells of plates: plate_id, position, row, row_idx, col, idx, label, attrs."""

    key = ("plate_id", "position")
    row, row_idx, col, idx, label = map(accessor, ("row", "row_idx", "col", "idx", "label"))

    def plate(self, plates: Plates) -> DataFrame:
        """Each well with its plate's row."""
        return self.df.select("plate_id", "position").join(plates.df, "plate_id")

    def held(self, items: DataFrame) -> DataFrame:
        """(plate_id, position, ord, item_id) of the items that these wells hold."""
        return items.join(self.df.select(*self.key), list(self.key), "left_semi")

    def hold(self, items: DataFrame, new: DataFrame) -> DataFrame:
        """items with new ones in wells that hold none yet; what is held once stays."""
        fresh = new.join(items.select(*self.key).distinct(), list(self.key), "left_anti").join(self.df.select(*self.key), list(self.key), "left_semi")
        return items.unionByName(fresh.select(*items.columns))

    samples = treatments = reporters = held

    def data(self, items: DataFrame, add: DataFrame | None = None) -> DataFrame:
        """(plate_id, position, ord, item_id) of the wells' data, with more of them appended in order."""
        return self.held(appended(items, add, self.key))


def appended(held: DataFrame, add: DataFrame | None, key: tuple[str, ...]) -> DataFrame:
    """Rows (key, ord, item_id) with those of add behind the others of their key."""
    if add is None:
        return held
    top = held.groupBy(*key).agg((F.max("ord") + 1).alias("_next"))
    moved = add.join(top, list(key), "left").withColumn("ord", F.col("ord") + F.coalesce("_next", F.lit(0))).select(*held.columns)
    return held.unionByName(moved)


class Core:
    """Makes plates, wells and items, from single values or from whole tables."""

    KINDS = {"sample": Samples, "treatment": Treatments, "reporter": Reporters, "data": Data}

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def new_plate(self, plate_id: str, **parameters) -> Plates:
        return Plates(plate(self.spark, plate_id, **parameters)[0])

    def new_plates(self, df: DataFrame) -> Plates:
        """Plates from a table with plate_id and any of the other columns."""
        given = lambda name, other: F.col(name) if name in df.columns else other
        size = F.concat((F.col("nrows") * F.col("ncols")).cast("string"), F.lit("-well plate"))
        return Plates(df.select("plate_id", given("name", F.col("plate_id")).alias("name"), given("type", size).alias("type"), "nrows", "ncols", given("attrs", F.create_map().cast("map<string,string>")).alias("attrs")))

    def new_well(self, plates: Plates, position: str) -> Wells:
        """The well at a position of every plate that has it; raises where none has."""
        found = plates.wells().df.where(F.col("position") == normal_position(F.lit(position)))
        if not found.limit(1).count():
            raise ValueError(f"no plate has a well {position}")
        return Wells(found)

    def new_items(self, kind: str, df: DataFrame, item_id: str, **attributes: str | Column) -> Records:
        """Items of a kind from a table; attributes that the kind does not name go to attrs."""
        value = lambda x: (F.col(x) if isinstance(x, str) else x).cast("string")
        named = [value(attributes[k]).alias(k) if k in attributes else F.lit(None).cast("string").alias(k) for k in ITEMS[kind]]
        others = [c for k, x in attributes.items() if k not in ITEMS[kind] for c in (F.lit(k), value(x))]
        return self.KINDS[kind](df.select(F.col(item_id).cast("long").alias("item_id"), *named, F.create_map(*others).cast("map<string,string>").alias("attrs")))

    def new_sample(self, df: DataFrame, item_id: str, **attributes) -> Samples:
        return self.new_items("sample", df, item_id, **attributes)

    def new_treatment(self, df: DataFrame, item_id: str, **attributes) -> Treatments:
        return self.new_items("treatment", df, item_id, **attributes)

    def new_reporter(self, df: DataFrame, item_id: str, **attributes) -> Reporters:
        return self.new_items("reporter", df, item_id, **attributes)

    def new_data(self, df: DataFrame, item_id: str, **attributes) -> Data:
        return self.new_items("data", df, item_id, **attributes)


def store(tables: dict[str, DataFrame], path: str) -> str:
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    return path


def retrieve(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{path}/{name}") for name in names}
