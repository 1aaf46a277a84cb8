"""Small dimensions: gazetteer, states, search matrix, polygons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitrep import constants as K
from sitrep import schemas
from sitrep.functions.text import literal_array, quoted, split_camel


def literal_rows(spark: SparkSession, names: list[str], rows: list[tuple]) -> DataFrame:
    """A constant table inside the plan: no Python worker, no file, known size."""
    values = ", ".join("(" + ", ".join(quoted(v) for v in row) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t({', '.join(names)})")


def gazetteer(spark: SparkSession) -> DataFrame:
    """``(name, state, district)`` of every known state and district: about a hundred rows."""
    return literal_rows(spark, ["name", "state", "district"], K.gazetteer_rows())


def state_districts(spark: SparkSession) -> DataFrame:
    rows = [(s, d) for s, ds in K.STATE_DISTRICTS.items() for d in ds]
    return literal_rows(spark, ["state", "district"], rows)


def search_queries(
    places: DataFrame, place: str, terms: list[str] = K.SEARCH_TERMS
) -> DataFrame:
    """Every term with every place: '<term> <place>'. Each place row unfolds the short list."""
    words = literal_array(terms)
    tidy = F.trim(F.regexp_replace(F.col(place), "[\\r\\n]", ""))
    return (
        places.select(tidy.alias("place"))
        .select("place", F.explode(words).alias("term"))
        .select(F.concat_ws(" ", "term", "place").alias("query"))
    )


def place_keywords(spark: SparkSession) -> DataFrame:
    return literal_rows(spark, ["place"], [(p,) for p in K.PLACE_KEYWORDS])


# --- polygons ---------------------------------------------------------------------------
_RINGS = "array<array<array<double>>>"


def _points(rings: Column) -> Column:
    return F.transform(
        rings,
        lambda ring: F.transform(
            ring, lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))
        ),
    )


def read_polygons(spark: SparkSession, path: str) -> DataFrame:
    """District outlines from GeoJSON: ``(polygon_id, state, district, rings)``.

    Parts of a multi-polygon and holes become rings of one row; the even-odd rule tells them
    apart. ``polygon_id`` is the position in the file, which decides between overlaps.
    """
    doc = spark.read.schema(schemas.struct(schemas.GEOJSON)).option("multiLine", True).json(path)
    feature = doc.select(F.posexplode("features").alias("polygon_id", "f"))
    kind, shape = F.col("f.geometry.type"), F.col("f.geometry.coordinates")
    rings = F.when(kind == "Polygon", F.from_json(shape, _RINGS)).otherwise(
        F.flatten(F.from_json(shape, f"array<{_RINGS}>"))
    )
    return feature.select(
        F.col("polygon_id").cast("bigint"),
        split_camel(F.coalesce("f.properties.NAME_1", F.lit("unknown state"))).alias("state"),
        split_camel(F.coalesce("f.properties.NAME_2", F.lit("unknown district"))).alias("district"),
        _points(rings).alias("rings"),
    )
