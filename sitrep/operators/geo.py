"""Places: gazetteer mentions, points in polygons, and the decision between the two."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitrep import constants as K
from sitrep.functions import places, text
from sitrep.functions import predicates as P
from sitrep.skew import salted_join
from sitrep.sources.dimensions import gazetteer

CELL = 0.5
NO_CELL = -1_000_000_000


# --- gazetteer -------------------------------------------------------------------------
def with_place_intent(
    posts: DataFrame, column: str, out: str = "intent", extra: DataFrame | None = None
) -> DataFrame:
    """Adds ``struct<state, district>`` named in a text: the first district, else the first
    state, else null; and the columns of ``extra``, which has one row per gazetteer ``name``.

    One pattern finds all names in one pass over the text. Only the found name meets the
    gazetteer, a constant of about a hundred rows, which is why it may be broadcast.
    """
    rows = K.gazetteer_rows()
    district_names = text.literal_array(n for n, _, d in rows if d != K.UNKNOWN_DISTRICT)
    found = posts.withColumn("_found", text.term_matches(F.col(column), [n for n, _, _ in rows]))
    is_district = F.filter("_found", lambda m: F.array_contains(district_names, m))
    named = found.withColumn(
        "name",
        F.coalesce(
            F.try_element_at(is_district, F.lit(1)), F.try_element_at(F.col("_found"), F.lit(1))
        ),
    ).drop("_found")
    names = gazetteer(posts.sparkSession).select(
        "name", F.struct("state", "district").alias(out)
    )
    if extra is not None:
        names = names.join(extra, "name", "left")
    return named.join(F.broadcast(names), "name", "left").drop("name")


def lookup_places(posts: DataFrame, column: str) -> DataFrame:
    """Adds ``state`` and ``district`` of a location field by exact (trimmed, lower) name."""
    names = gazetteer(posts.sparkSession)
    keyed = posts.withColumn("name", F.lower(F.trim(F.col(column))))
    return keyed.join(F.broadcast(names), "name", "left").drop("name")


#: Characters of the pieces that texts and names are matched by.
PIECE = 3


def _pieces(text: str, width: int) -> Column:
    """Distinct pieces of a text, ``width`` characters each; none of a shorter text."""
    last = F.length(text) - (width - 1)
    starts = F.when(last > 0, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.substring(F.col(text), i, F.lit(width))))


def place_names_in(posts: DataFrame, column: str, names: DataFrame, name: str) -> DataFrame:
    """Distinct pairs of a location text and a listed name contained in it (``_text, _name``).

    A substring join without comparing every pair. A name can only occur in texts that hold all
    its three-character pieces, so it is looked up by the rarest of them: the pieces of the
    distinct texts are counted, and each name takes the one that the fewest texts have. A name
    with a piece that no text has is done there. Names below three characters are one piece.

    Rows of the index are a piece and a 64-bit hash of the text, only of pieces that names chose.
    Texts return for the pairs that are left, and ``contains`` decides, so texts that share a
    hash cost a comparison and change nothing. Texts and names are reduced to distinct values
    first; a piece of a large share of the texts is split by its count, which is known here.
    """
    texts = posts.select(F.lower(F.col(column)).alias("_text")).where(
        F.col("_text").isNotNull()
    ).distinct().withColumn("_key", F.xxhash64("_text"))
    wanted = names.select(F.lower(F.col(name)).alias("_name")).where(
        F.coalesce(F.col("_name"), F.lit("")) != ""
    ).distinct()
    whole = F.array("_name")
    named = wanted.select(
        "_name",
        F.explode(F.when(F.length("_name") < PIECE, whole).otherwise(_pieces("_name", PIECE))).alias("_piece"),
    )
    of_text = F.flatten(F.array(*[_pieces("_text", n) for n in range(1, PIECE + 1)]))
    index = texts.select("_key", F.explode(of_text).alias("_piece")).join(
        named.select("_piece").distinct(), "_piece", "left_semi"
    )
    postings = index.groupBy("_piece").agg(F.count(F.lit(1)).alias("n"))
    rarest = (
        named.join(postings, "_piece", "left")
        .groupBy("_name")
        .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "_piece")).alias("_by"))
        .where(F.col("_by.n") > 0)
        .select("_name", "_by._piece", "_by.n")
    )
    chosen = rarest.groupBy("_piece").agg(F.max("n").alias("n"))
    pairs = salted_join(index, rarest.drop("n"), ["_piece"], spread=["_key"], counts=chosen)
    # a text and a name meet at one piece only, so no pair comes twice
    return (
        pairs.join(texts, "_key").where(F.contains("_text", "_name")).select("_text", "_name").distinct()
    )


# --- polygons ----------------------------------------------------------------------------
def ring_edges(ring: Column) -> Column:
    following = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))
    return F.zip_with(
        ring,
        following,
        lambda a, b: F.struct(
            a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2")
        ),
    )


def polygon_grid(polygons: DataFrame, cell: float = CELL) -> DataFrame:
    """Polygons cut to a grid: one row per cell with the polygons that may cover it.

    Each entry only keeps the edges a horizontal ray inside the cell can cross, so the later
    test touches a few edges of even a very detailed outline. Entries are ordered by polygon
    id. The table grows with the outlines, not with the points.
    """

    outline = polygons.select(
        "polygon_id",
        "state",
        "district",
        F.flatten(F.transform("rings", ring_edges)).alias("edges"),
    )
    low = lambda field: F.array_min(F.transform("edges", lambda e: e[field]))
    high = lambda field: F.array_max(F.transform("edges", lambda e: e[field]))
    span = outline.select(
        "*",
        F.sequence(
            places.grid_cell(low("x1"), cell), places.grid_cell(high("x1"), cell)
        ).alias("_xs"),
        F.sequence(
            places.grid_cell(low("y1"), cell), places.grid_cell(high("y1"), cell)
        ).alias("_ys"),
    )
    rows = span.withColumn("cell_y", F.explode("_ys")).withColumn(
        "_near",
        F.filter(
            "edges",
            lambda e: (F.greatest(e["y1"], e["y2"]) >= F.col("cell_y") * cell)
            & (F.least(e["y1"], e["y2"]) <= (F.col("cell_y") + 1) * cell),
        ),
    )
    return (
        rows.withColumn("cell_x", F.explode("_xs"))
        .groupBy("cell_x", "cell_y")
        .agg(
            F.array_sort(
                F.collect_list(
                    F.struct("polygon_id", "state", "district", F.col("_near").alias("edges"))
                )
            ).alias("candidates")
        )
    )


def _inside(edges: Column, lon: Column, lat: Column) -> Column:
    """Even-odd rule: the ray to the east crosses an odd number of edges."""
    crossings = F.filter(
        edges,
        lambda e: ((e["y1"] > lat) != (e["y2"] > lat))
        & (
            lon
            < (e["x2"] - e["x1"]) * (lat - e["y1"]) / F.nullif(e["y2"] - e["y1"], F.lit(0.0))
            + e["x1"]
        ),
    )
    return F.size(crossings) % 2 == 1


def locate_points(
    points: DataFrame,
    polygons: DataFrame,
    lat: str = "lat",
    lon: str = "lon",
    out: str = "gps",
    cell: float = CELL,
    salts: int | None = None,
) -> DataFrame:
    """Adds ``struct<polygon_id, state, district>`` of the polygon holding each point (lowest
    id where several do), or null. Points outside the bounding box are not tested.

    A point meets exactly one grid row, so points are never multiplied nor grouped again: one
    left join on the cell, then a test inside the row. A busy cell is spread over partitions.
    """
    grid = polygon_grid(polygons, cell)
    usable = places.in_bounding_box(F.col(lat), F.col(lon))
    spread = [lat, lon] + [c for c in ("post_id", "event_id", "postId") if c in points.columns]
    # points without a usable coordinate may be the majority: they get keys of their own that
    # no cell has, instead of one null key that would gather them in a few tasks
    own = F.coalesce(-1 - F.pmod(F.xxhash64(*spread), F.lit(1_000_003)), F.lit(-1)).cast("bigint")
    keyed = points.withColumns(
        {
            "cell_x": F.when(usable, places.grid_cell(F.col(lon), cell)).otherwise(own),
            "cell_y": F.when(usable, places.grid_cell(F.col(lat), cell)).otherwise(NO_CELL),
        }
    )
    cells = keyed.where(F.col("cell_y") != NO_CELL).groupBy("cell_x", "cell_y").agg(F.count(F.lit(1)).alias("n"))
    joined = salted_join(keyed, grid, ["cell_x", "cell_y"], "left", spread=spread, salts=salts, counts=cells)
    hit = F.try_element_at(
        F.filter("candidates", lambda p: _inside(p["edges"], F.col(lon), F.col(lat))), F.lit(1)
    )
    return (
        joined.withColumn("_hit", hit)
        .withColumn(
            out,
            F.when(
                F.col("_hit").isNotNull(),
                F.struct("_hit.polygon_id", "_hit.state", "_hit.district"),
            ),
        )
        .drop("_hit", "candidates", "cell_x", "cell_y")
    )


def _same_state(c: Column) -> Column:
    """One spelling for all names of a state."""
    return F.lower(places.canonical_state(c))


def place_points(polygons: DataFrame) -> DataFrame:
    """A coordinate per (state, district), and per state under the unknown district: the middle
    of the outline of the lowest polygon id, or its first corner where the middle lies outside.

    States are in one spelling, so that a place named either way finds its outline.
    """
    outline = polygons.select(
        "polygon_id",
        _same_state(F.col("state")).alias("state"),
        "district",
        F.flatten("rings").alias("_points"),
        F.flatten(F.transform("rings", ring_edges)).alias("_edges"),
    )
    xs, ys = F.transform("_points", lambda p: p["x"]), F.transform("_points", lambda p: p["y"])
    centre = outline.withColumns(
        {
            "_lon": (F.array_min(xs) + F.array_max(xs)) / 2,
            "_lat": (F.array_min(ys) + F.array_max(ys)) / 2,
        }
    )
    inside = _inside(F.col("_edges"), F.col("_lon"), F.col("_lat"))
    corner = F.get("_points", F.lit(0))
    centre = centre.select(
        "polygon_id",
        "state",
        "district",
        F.when(inside, F.col("_lon")).otherwise(corner["x"]).alias("lon"),
        F.when(inside, F.col("_lat")).otherwise(corner["y"]).alias("lat"),
    )
    best = F.min_by(F.struct("district", "lat", "lon"), "polygon_id").alias("at")
    by_district = centre.groupBy("state", F.col("district").alias("named")).agg(best)
    by_state = centre.groupBy("state").agg(best).withColumn("named", F.lit(K.UNKNOWN_DISTRICT))
    return by_district.unionByName(by_state)


def rescue_points(polygons: DataFrame) -> DataFrame:
    """``name, at``: for every gazetteer name a point of its district, else of its state.

    At most one row per gazetteer name, so it may be broadcast however many outlines there are.
    """
    points = place_points(polygons)
    names = gazetteer(polygons.sparkSession).select(
        "name", _same_state(F.col("state")).alias("state"), F.col("district").alias("named")
    )
    near = names.join(points, ["state", "named"], "left")
    anywhere = points.where(F.col("named") == K.UNKNOWN_DISTRICT).select(
        "state", F.col("at").alias("_at")
    )
    return near.join(anywhere, "state", "left").select("name", F.coalesce("at", "_at").alias("at"))


# --- decision ------------------------------------------------------------------------------
def resolve_geo(posts: DataFrame, polygons: DataFrame, text_column: str = "postText") -> DataFrame:
    """Adds ``geo_data``: where a post is, how sure that is, and how it was found.

    Coordinates confirmed by the text 1.0; text against or without coordinates 0.8; coordinates
    alone 0.6; nothing 0.0.
    """
    # the point of a named place comes with the name: posts are not joined again by place
    named = with_place_intent(posts, text_column, extra=rescue_points(polygons))
    located = locate_points(named, polygons, "latitude", "longitude", "gps")
    gps, intent, at = F.col("gps"), F.col("intent"), F.col("at")
    confirmed = gps.isNotNull() & (_same_state(gps["state"]) == _same_state(intent["state"]))
    inside = places.in_bounding_box(F.col("latitude"), F.col("longitude"))

    def result(state, district, lat, lon, known, score, how) -> Column:
        return F.struct(
            state.alias("state"),
            district.alias("district"),
            lat.cast("double").alias("lat"),
            lon.cast("double").alias("lon"),
            F.coalesce(known, F.lit(False)).alias("is_malaysia"),
            F.lit(float(score)).alias("confidence_score"),
            F.lit(how).alias("inference"),
        )

    lat, lon = F.col("latitude"), F.col("longitude")
    decision = (
        F.when(
            confirmed,
            result(gps["state"], gps["district"], lat, lon, F.lit(True), 1.0, K.FOUND_BY_BOTH),
        )
        .when(
            at.isNotNull(),
            result(
                intent["state"], at["district"], at["lat"], at["lon"], F.lit(True), 0.8,
                K.FOUND_BY_TEXT,
            ),
        )
        .when(
            gps.isNotNull(),
            result(gps["state"], gps["district"], lat, lon, F.lit(True), 0.6, K.FOUND_BY_GPS),
        )
        .otherwise(
            result(
                F.lit(K.UNKNOWN_STATE), F.lit(K.UNKNOWN_DISTRICT), lat, lon, inside, 0.0, K.NOT_FOUND
            )
        )
    )
    return located.withColumn("geo_data", decision).drop("gps", "intent", "at")


def retry_geo(pending: DataFrame, polygons: DataFrame, now: Column) -> DataFrame:
    """One more try to locate posts with ``attempts``: adds ``geo_data`` and ``geo_processed``, counts
    the try and notes its time.

    A second try also reads the hashtags and the topic, a third one the place fields of the post.
    """
    tries = F.col("attempts")
    words = F.concat_ws(
        " ",
        "postText",
        F.when(tries >= 1, F.concat_ws(" ", F.array_join("hashtags", " "), "keywords")),
        F.when(tries >= 2, F.concat_ws(" ", "location", "address", "city")),
    )
    located = resolve_geo(pending.withColumn("_words", words), polygons, "_words").drop("_words")
    return located.withColumns(
        {
            "geo_processed": F.lit(True),
            "attempts": tries + 1,
            "last_processed_at": now.cast("timestamp"),
        }
    )


# --- map roll-ups ---------------------------------------------------------------------------
def map_extent(events: DataFrame) -> DataFrame:
    """One row: what the map should show for a selection of events."""
    at = F.col("geometry.coordinates")
    ok = events.where(P.valid_coordinates(at)).select(at[0].alias("lon"), at[1].alias("lat"))
    box = ok.agg(
        F.count("*").alias("n"),
        F.min("lat").alias("south"),
        F.max("lat").alias("north"),
        F.min("lon").alias("west"),
        F.max("lon").alias("east"),
    )
    none, one = F.col("n") == 0, F.col("n") == 1
    return box.select(
        F.when(none, "default").when(one, "point").otherwise("box").alias("mode"),
        F.col("n").alias("events"),
        F.when(none, K.DEFAULT_CENTRE_LAT)
        .otherwise((F.col("south") + F.col("north")) / 2)
        .alias("centre_lat"),
        F.when(none, K.DEFAULT_CENTRE_LON)
        .otherwise((F.col("west") + F.col("east")) / 2)
        .alias("centre_lon"),
        "south",
        "north",
        "west",
        "east",
        F.when(none, K.DEFAULT_ZOOM).when(one, K.POINT_ZOOM).cast("int").alias("zoom"),
    )


def marker_grid(events: DataFrame, cell: float = 1.0) -> DataFrame:
    """Markers rolled up to a grid, with a size class by count."""
    at = F.col("geometry.coordinates")
    return (
        events.where(P.valid_coordinates(at))
        .groupBy(
            places.grid_cell(at[0], cell).alias("cell_x"),
            places.grid_cell(at[1], cell).alias("cell_y"),
        )
        .agg(F.count("*").alias("events"))
        .withColumn(
            "size_class",
            F.when(F.col("events") >= 50, "large")
            .when(F.col("events") >= 10, "medium")
            .otherwise("small"),
        )
    )
