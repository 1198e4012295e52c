"""Classification of elements by their tags into layers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Layers in output order, each with its key, known values and zoom rules ({value: zoom}, else default).
LAYERS: tuple[tuple[str, str, tuple[str, ...], dict[str, int], int], ...] = (
    ("amenity", "amenity", ("parking", "school", "place_of_worship", "restaurant", "fuel", "hospital", "pharmacy", "bank", "cafe", "fast_food", "pub", "bar", "police", "fire_station", "post_office", "library", "university", "kindergarten", "marketplace"), {}, 13),
    ("shop", "shop", ("supermarket", "convenience", "clothes", "hairdresser", "car_repair", "bakery", "beauty", "car", "mobile_phone", "hardware", "butcher", "alcohol", "furniture", "electronics", "department_store", "mall", "bicycle", "books", "jewelry", "gift", "florist", "pet", "sports", "optician"), {}, 14),
    ("tourism", "tourism", ("hotel", "motel", "attraction", "museum", "viewpoint", "information", "guest_house", "camp_site", "picnic_site", "theme_park", "zoo", "hostel", "artwork"), {"theme_park": 10, "zoo": 10, "hotel": 13, "museum": 13, "attraction": 13}, 14),
    ("office", "office", ("company", "government", "insurance", "lawyer", "estate_agent", "financial", "it", "ngo", "accountant", "architect"), {}, 14),
    ("healthcare", "healthcare", ("doctor", "dentist", "clinic", "hospital", "pharmacy", "optometrist", "physiotherapist", "laboratory", "rehabilitation"), {}, 14),
    ("craft", "craft", ("carpenter", "electrician", "plumber", "painter", "brewery", "photographer", "tailor", "hvac", "shoemaker", "gardener", "locksmith", "roofer"), {}, 14),
    ("historic", "historic", ("monument", "memorial", "castle", "ruins", "archaeological_site", "fort", "battlefield", "building"), {"castle": 10, "fort": 10}, 13),
    ("club", "club", ("sport", "social", "veterans", "music", "gaming", "fishing"), {}, 14),
    ("emergency", "emergency", ("ambulance_station", "fire_station", "fire_hydrant", "hospital", "phone", "defibrillator", "assembly_point"), {}, 13),
    ("education", "education", ("school", "university", "college", "kindergarten", "language_school", "driving_school", "music_school"), {}, 13),
    ("leisure", "leisure", ("park", "garden", "playground", "golf_course", "sports_centre", "swimming_pool", "stadium", "pitch", "nature_reserve", "marina"), {"park": 8, "nature_reserve": 8, "golf_course": 10, "stadium": 10}, 12),
    ("highway", "highway", ("motorway", "motorway_link", "trunk", "trunk_link", "primary", "primary_link", "secondary", "secondary_link", "tertiary", "tertiary_link", "residential", "unclassified", "service", "living_street", "pedestrian", "track", "bus_guideway", "footway", "bridleway", "steps", "corridor", "path", "cycleway"),
     {"motorway": 4, "motorway_link": 4, "trunk": 5, "trunk_link": 5, "primary": 7, "primary_link": 7, "secondary": 9, "secondary_link": 9, "tertiary": 11, "tertiary_link": 11, "residential": 12, "unclassified": 12, "living_street": 12, "service": 13, "pedestrian": 13}, 14),
    ("railway", "railway", ("rail", "subway", "tram", "light_rail", "monorail", "narrow_gauge", "preserved", "disused", "abandoned", "platform", "station"), {"rail": 8, "subway": 10, "light_rail": 10}, 12),
    ("water", "waterway", ("river", "stream", "canal", "drain", "ditch"), {"river": 8, "stream": 12, "canal": 12, "lake": 6, "reservoir": 6, "pond": 10, "basin": 10}, 13),
    ("natural", "natural", ("wood", "scrub", "grassland", "heath", "sand", "bare_rock", "wetland", "glacier", "beach", "cliff", "peak", "volcano", "tree", "coastline"), {"coastline": 0, "wood": 6, "glacier": 6}, 10),
    ("landuse", "landuse", ("residential", "commercial", "industrial", "retail", "farmland", "forest", "grass", "meadow", "orchard", "vineyard", "cemetery", "military", "quarry", "recreation_ground"), {}, 7),
    ("building", "building", ("yes", "house", "apartments", "commercial", "industrial", "retail", "garage", "garages", "shed", "hut", "cabin", "church", "cathedral", "mosque", "temple", "synagogue", "hospital", "school", "university", "kindergarten", "hotel", "office"), {}, 13),
    ("boundary", "boundary", ("administrative", "national_park", "protected_area", "maritime"), {}, 2),
    ("place", "place", ("city", "town", "village", "hamlet", "suburb", "neighbourhood", "isolated_dwelling"), {"city": 4, "town": 7, "village": 10}, 12),
)
WATER_VALUES = ("lake", "pond", "reservoir", "basin", "river")
FARMLAND_ALIASES = ("farm", "farmyard")
# Keys and values for which a closed way is an area (True) or a line (False); boundaries never are areas, other keys always.
AREA_ONLY = {"highway": ("rest_area", "services", "platform"), "railway": ("platform", "station", "turntable", "roundhouse"), "waterway": ("riverbank", "dock", "boatyard", "dam", "fuel")}
LINE_ONLY = {"natural": ("coastline", "cliff", "ridge", "arete", "tree_row", "valley", "gorge", "earth_bank", "dyke"), "leisure": ("track", "slipway"), "historic": ("citywalls",)}
# What a layer adds to importance.
IMPORTANCE_BONUS = {"place": 3, "highway": 2, "railway": 2, "water": 2, "boundary": 1}


_LAYER_OF = {key: layer for layer, key, *_ in LAYERS} | {"water": "water"}
_RANK_OF = {layer: i for i, (layer, *_) in enumerate(LAYERS)}
_VALUES_OF = {key: values for _, key, values, *_ in LAYERS} | {"water": WATER_VALUES}
#: Keys that say something about an element's classes, or whether it is an area.
CLASS_KEYS = tuple(_LAYER_OF)


def _fixed_map(rows: dict) -> Column:
    """A literal map: one lookup in generated code where a chain of cases would be copied into each of its uses."""
    value = lambda v: F.array(*[F.lit(x) for x in v]) if isinstance(v, tuple) else F.lit(v)
    return F.create_map(*[c for k, v in rows.items() for c in (F.lit(k), value(v))])


def layer_set(names: str) -> set[str]:
    """Layers of a comma-separated list; an unknown name is an error."""
    out = {n.strip() for n in names.split(",") if n.strip()}
    unknown = sorted(out - _RANK_OF.keys())
    if unknown or not out:
        raise ValueError(f"unknown layers: {', '.join(unknown) or names!r}; known: {', '.join(_RANK_OF)}")
    return out


def class_tags(tags: Column) -> Column:
    """The tags that classify an element, one for each key: empty values count as absent, of duplicate keys the last holds.

    waterway hides water, and both hide natural=water; building=no is none.
    """
    own = F.filter(tags, lambda t: t["k"].isin(*CLASS_KEYS) & (t["v"] != ""))
    last = F.filter(own, lambda t, i: ~F.exists(F.slice(own, i + 2, F.size(own)), lambda u: u["k"] == t["k"]))
    has = lambda *keys: F.exists(own, lambda u: u["k"].isin(*keys))
    hidden = lambda t: ((t["k"] == "water") & has("waterway")) | ((t["k"] == "natural") & (t["v"] == "water") & has("waterway", "water")) | ((t["k"] == "building") & (t["v"] == "no"))
    return F.filter(F.when(F.size(own) > 1, last).otherwise(own), lambda t: ~hidden(t))


def classified(elements: DataFrame, layers: set[str] | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per element and layer: osm_type, id, the columns to keep, layer, rank, class_key, class_value, class, min_zoom, importance.

    Elements without a tag of a class go before anything is computed for them.
    """
    if layers is not None and layers - _RANK_OF.keys():
        raise ValueError(f"unknown layers: {', '.join(sorted(layers - _RANK_OF.keys()))}")
    rows = elements.where(F.exists("tags", lambda t: t["k"].isin(*CLASS_KEYS))).select("osm_type", "id", *keep, F.explode(class_tags(F.col("tags"))).alias("t"))
    key, value = F.col("class_key"), F.col("class_value")
    rows = rows.select("osm_type", "id", *keep, F.col("t.k").alias("class_key"), F.col("t.v").alias("class_value"))
    lake = (key == "natural") & (value == "water")
    layer = F.when(lake, "water").otherwise(F.element_at(_fixed_map(_LAYER_OF), key))
    rank = F.element_at(_fixed_map(_RANK_OF), layer)
    name = F.when(lake, "lake").when((key == "landuse") & value.isin(*FARMLAND_ALIASES), "farmland")
    name = name.when(F.array_contains(F.element_at(_fixed_map(_VALUES_OF), key), value), value).otherwise("other")
    if layers is not None:  # by key first, so that it goes to the scan
        keys = [k for k, own in _LAYER_OF.items() if own in layers] + (["natural"] if "water" in layers else [])
        rows = rows.where(key.isin(*keys))
    rows = rows.withColumns({"layer": layer, "rank": rank, "class": name})
    if layers is not None:
        rows = rows.where(F.col("layer").isin(*layers))
    rows = rows.withColumn("min_zoom", min_zoom(F.col("layer"), F.col("class")))
    rows = rows.withColumn("importance", importance(F.col("layer"), F.col("min_zoom")))
    return rows.select("osm_type", "id", *keep, "layer", "rank", "class_key", "class_value", "class", "min_zoom", "importance")


def min_zoom(layer: Column, name: Column) -> Column:
    """The smallest zoom at which a class is drawn."""
    own = {f"{layer}/{value}": zoom for layer, _, _, zooms, _ in LAYERS for value, zoom in zooms.items()}
    usual = {layer: default for layer, _, _, _, default in LAYERS}
    return F.coalesce(F.element_at(_fixed_map(own), F.concat(layer, F.lit("/"), name)), F.element_at(_fixed_map(usual), layer))


def importance(layer: Column, zoom: Column) -> Column:
    return (F.lit(32) - zoom) * 4 + F.coalesce(F.element_at(_fixed_map(IMPORTANCE_BONUS), layer), F.lit(0))


def closed_way_is_area(key: Column, value: Column, area: Column) -> Column:
    """Whether a closed way is an area for one of its classes; `area` is the value of its tag area, or null."""
    rule = F.when(key == "boundary", False)
    for k, values in AREA_ONLY.items():
        rule = rule.when(key == k, value.isin(*values))
    for k, values in LINE_ONLY.items():
        rule = rule.when(key == k, ~value.isin(*values))
    return F.when(area == "yes", True).when(area == "no", False).otherwise(rule.otherwise(True))
