"""Which ways may be walked and which count: first match wins, as one CASE expression each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import in_any_zone
from ..functions.names import CORRIDORS, canonical_name, display_name, first_name, tag, values

#: The vocabulary of the map's tags.
SERVICES = ("driveway", "parking_aisle", "drive-through", "drive_through")
ACCESS = ("private", "no", "customers", "emergency", "permit")
FOOT_ALLOWED = ("yes", "designated", "permissive", "official")
HIGHWAYS = ("bus_stop", "motorway", "motorway_link", "raceway", "busway", "bus_guideway")
FOOT_RESTRICTED = ("no", "use_sidepath")
PARKING_NAMES = ("parking entrance", "parking ramp", "parking garage", "parking structure", "loading dock", "garage entrance")
TRAILS = ("path", "footway", "pedestrian", "bridleway", "track", "cycleway")
TRANSIT_NAMES = ("Van Ness Bus Rapid Transit", "Transbay Bus Ramp")
#: Circles out of scope (lat, lon, radius in metres). Edit for your own city.
OUT_OF_SCOPE = ((37.8267, -122.4230, 600.0),)


def has(name: str, *wanted: str, tags: str = "tags") -> Column:
    return F.arrays_overlap(values(tag(name, tags)), F.array(*[F.lit(x) for x in wanted]))


def is_pier(tags: str = "tags") -> Column:
    return has("man_made", "pier", tags=tags)


def passage_class(tags: str = "tags") -> Column:
    return (
        F.when(is_pier(tags), F.lit("pier"))
        .when(has("highway", "steps", tags=tags), F.lit("staircase"))
        .when(has("service", "alley", tags=tags), F.lit("alley"))
        .when(has("highway", *TRAILS, tags=tags), F.lit("trail"))
        .otherwise(F.lit("street"))
    )


def foot_restricted(tags: str = "tags") -> Column:
    return has("foot", *FOOT_RESTRICTED, tags=tags) | has("sidewalk", "separate", tags=tags)


def exclusion_reason(tags: str = "tags") -> Column:
    """Why a way isn't public and walkable; null if it is.

    The tags' values are normalised once a row, and the rules look into that: as one expression with
    the normalisation in every branch, the chain would outgrow what can be compiled.
    """
    name = F.lower(display_name(tags))
    parking_name = F.lit(False)
    for words in PARKING_NAMES:
        parking_name = parking_name | F.contains(name, F.lit(words))
    plain = F.transform_values(tags, lambda _, v: values(v))

    def reason(t: Column) -> Column:
        def is_(key: str, *wanted: str) -> Column:
            return F.coalesce(F.arrays_overlap(F.try_element_at(t, F.lit(key)), F.array(*[F.lit(x) for x in wanted])), F.lit(False))

        return (
            F.when(is_("service", *SERVICES), F.lit("parking_or_driveway"))
            .when(is_("highway", *HIGHWAYS), F.lit("non_pedestrian_highway"))
            .when(is_("highway", "elevator"), F.lit("mechanical_vertical_transport"))
            .when(is_("railway", "platform") | is_("public_transport", "platform") | is_("highway", "platform"), F.lit("transit_platform"))
            .when(is_("access", *ACCESS) & ~is_("foot", *FOOT_ALLOWED), F.lit("restricted_access"))
            .when(is_("amenity", "parking") | (F.size(F.coalesce(F.try_element_at(t, F.lit("parking")), F.array().cast("array<string>"))) > 0), F.lit("parking_facility"))
            .when(is_("indoor", "yes", "room", "corridor"), F.lit("indoor"))
            .when(is_("tunnel", "building_passage"), F.lit("building_passage"))
            .when(is_("area", "yes", "1", "true") & ~is_("man_made", "pier"), F.lit("non_linear_area"))
        )

    return F.coalesce(F.transform(F.array(plain), reason)[0], F.when(parking_name, F.lit("parking_or_loading")))


def is_pier_ring(tags: str = "tags") -> Column:
    """A pier drawn as an area: walkable, but no passage to be covered."""
    return is_pier(tags) & has("area", "yes", "1", "true", tags=tags)


def is_routable(tags: str = "tags") -> Column:
    return exclusion_reason(tags).isNull()


def is_eligible(tags: str = "tags") -> Column:
    return is_routable(tags) & (display_name(tags) != "")


def is_required(tags: str = "tags", annotated: Column | None = None, corridors: tuple = CORRIDORS) -> Column:
    """Whether a way has to be covered: what the inventory says; before there is one, every named, walkable, canonical way."""
    name = F.coalesce(first_name(tags), F.lit(""))
    legacy = ~has("highway", "bus_stop", tags=tags) & (name != "") & ~name.isin(*TRANSIT_NAMES) & (canonical_name(name, corridors) == name)
    return legacy if annotated is None else F.coalesce(annotated, legacy)


def is_road_like(tags: str = "tags") -> Column:
    """Named, and no trail by its highway tag."""
    return (display_name(tags) != "") & ~has("highway", *TRAILS, "steps", tags=tags)


def is_unnamed_foot(tags: str = "tags") -> Column:
    return (display_name(tags) == "") & has("highway", *TRAILS, "steps", "corridor", tags=tags)


def match_rank(tags: str = "tags") -> Column:
    """Preference of a way for map matching: lower first."""
    return F.when(is_road_like(tags), F.lit(0)).when(is_unnamed_foot(tags), F.lit(2)).otherwise(F.lit(1))


def not_matchable(tags: str = "tags") -> Column:
    """Ways a walker is never on: guideways, transit ways by name, and unnamed busways."""
    name = F.coalesce(first_name(tags), F.lit(""))
    return has("highway", "bus_guideway", "bus_stop", tags=tags) | name.isin(*TRANSIT_NAMES) | (has("highway", "busway", tags=tags) & (name == ""))


def with_ends(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """edges with the coordinates of both ends: ulon, ulat, vlon, vlat (null where a node has none)."""
    a = nodes.select(F.col("node_id").alias("u"), F.col("x").alias("ulon"), F.col("y").alias("ulat"))
    b = nodes.select(F.col("node_id").alias("v"), F.col("x").alias("vlon"), F.col("y").alias("vlat"))
    return edges.join(a, "u", "left").join(b, "v", "left")


def public_network(edges: DataFrame, nodes: DataFrame, zones: tuple = OUT_OF_SCOPE) -> DataFrame:
    """edges with ends and `reason`: why an edge leaves the routing network, null if it stays."""
    placed = with_ends(edges, nodes)
    outside = in_any_zone((F.col("ulat") + F.col("vlat")) / 2, (F.col("ulon") + F.col("vlon")) / 2, list(zones))
    return placed.withColumn("reason", F.coalesce(exclusion_reason(), F.when(outside, F.lit("out_of_scope"))))


def audit(with_reason: DataFrame) -> DataFrame:
    """(reason, edges, m) of what left."""
    return with_reason.where("reason is not null").groupBy("reason").agg(F.count("*").alias("edges"), F.sum(F.coalesce("length", F.lit(0.0))).alias("m"))


def without_driveways(edges: DataFrame) -> DataFrame:
    """The narrow filter of older snapshots."""
    return edges.where(~has("service", *SERVICES))


#: Tags without which a snapshot can't be classified.
CRITICAL_TAGS = [
    "foot", "footway", "sidewalk", "amenity", "parking", "indoor", "building", "layer", "level", "man_made", "barrier", "railway", "public_transport", "area",
]


def tag_gaps(edges: DataFrame, declared: list[str], critical: list[str]) -> list[str]:
    """Critical tags that the snapshot neither declares nor has."""
    present = edges.select(F.explode(F.map_keys("tags")).alias("k")).distinct().where(F.col("k").isin(*critical))
    return sorted(set(critical) - set(declared) - {r.k for r in present.collect()})  # at most as many rows as critical tags
