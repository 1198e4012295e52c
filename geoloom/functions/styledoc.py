"""Style documents: layers of a version-8 style, checked, and applied to features.

A document names sources and layers. A layer draws the features of its source layer that its filter accepts, while the
zoom is in its range; each of its properties has a kind and a default. What this engine doesn't know is an error, with
the place in the document.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import colors
from . import style as S

# Fixed values of the style specification: section, kind, default and allowed words of each property, by layer type.
_COLOR, _OPACITY = ("paint", S.COLOR, colors.BLACK, ()), ("paint", S.NUMBER, 1.0, ())
ANCHORS = ("center", "left", "right", "top", "bottom", "top-left", "top-right", "bottom-left", "bottom-right")
PROPERTIES = {
    "background": {"background-color": _COLOR, "background-opacity": _OPACITY},
    "fill": {"fill-color": _COLOR, "fill-opacity": _OPACITY},
    "line": {
        "line-cap": ("layout", S.STRING, "butt", ("butt", "round", "square")), "line-join": ("layout", S.STRING, "miter", ("bevel", "round", "miter")),
        "line-color": _COLOR, "line-width": ("paint", S.NUMBER, 1.0, ()), "line-opacity": _OPACITY, "line-dasharray": ("paint", S.NUMBERS, (), ()),
    },
    "circle": {
        "circle-radius": ("paint", S.NUMBER, 5.0, ()), "circle-color": _COLOR, "circle-opacity": _OPACITY,
        "circle-stroke-color": _COLOR, "circle-stroke-width": ("paint", S.NUMBER, 0.0, ()), "circle-stroke-opacity": _OPACITY,
    },
    "symbol": {
        "symbol-placement": ("layout", S.STRING, "point", ("point", "line", "line-center")), "symbol-sort-key": ("layout", S.NUMBER, 0.0, ()), "text-field": ("layout", S.STRING, "", ()),
        "text-font": ("layout", S.STRINGS, ("Open Sans Regular", "Arial Unicode MS Regular"), ()), "text-size": ("layout", S.NUMBER, 16.0, ()), "text-transform": ("layout", S.STRING, "none", ("none", "uppercase", "lowercase")),
        "text-anchor": ("layout", S.STRING, "center", ANCHORS), "text-offset": ("layout", S.NUMBERS, (), ()), "text-padding": ("layout", S.NUMBER, 2.0, ()), "text-allow-overlap": ("layout", S.BOOL, False, ()),
        "text-max-angle": ("layout", S.NUMBER, 45.0, ()), "text-rotation-alignment": ("layout", S.STRING, "auto", ("map", "viewport", "auto")), "text-color": _COLOR,
        "text-halo-color": ("paint", S.COLOR, colors.TRANSPARENT, ()), "text-halo-width": ("paint", S.NUMBER, 0.0, ()), "text-opacity": _OPACITY,
    },
}
UNSUPPORTED_TYPES = ("raster", "hillshade", "color-relief", "fill-extrusion", "heatmap", "sky", "model")
LAYER_KEYS = ("id", "type", "source", "source-layer", "minzoom", "maxzoom", "filter", "layout", "paint", "metadata")
#: Opacity that is multiplied into each colour; sizes are not below 0.
_OPACITY_OF = {
    "background-color": "background-opacity", "fill-color": "fill-opacity", "line-color": "line-opacity", "circle-color": "circle-opacity", "circle-stroke-color": "circle-stroke-opacity",
    "text-color": "text-opacity", "text-halo-color": "text-opacity",
}
_SIZES = ("line-width", "circle-radius", "circle-stroke-width", "text-size", "text-padding", "text-halo-width")


@dataclass(frozen=True)
class Layer:
    id: str
    type: str
    source: str | None = None
    source_layer: str | None = None
    min_zoom: float | None = None
    max_zoom: float | None = None
    filter: object = True  # an expression
    visible: bool = True
    properties: dict = field(default_factory=dict)
    metadata: object = None

    def active(self, zoom: Column) -> Column:
        """Whether the layer draws at a zoom: from its smallest zoom on, below its largest."""
        out = F.lit(self.visible)
        if self.min_zoom is not None:
            out = out & (zoom >= F.lit(self.min_zoom))
        return out & (zoom < F.lit(self.max_zoom)) if self.max_zoom is not None else out

    def resolved(self, name: str, attrs: Column, zoom: Column) -> Column:
        """A property for each feature: its value or default, with opacity in colours, sizes from 0 and text transformed."""
        _, kind, default, among = PROPERTIES[self.type][name]
        out = S.property_column(self.properties[name], attrs, zoom, default, kind, among) if name in self.properties else S._default(default, kind)
        if name in _OPACITY_OF:
            out = colors.with_opacity(out, self.resolved(_OPACITY_OF[name], attrs, zoom))
        elif kind == S.NUMBER and name.endswith("opacity"):
            out = F.greatest(F.least(out, F.lit(1.0)), F.lit(0.0))
        elif name in _SIZES:
            out = F.greatest(out, F.lit(0.0))
        elif name == "text-offset":
            out = F.array(*[F.coalesce(F.get(out, F.lit(i)), F.lit(0.0)) for i in (0, 1)])
        elif name == "text-field" and "text-transform" in self.properties:
            how = self.resolved("text-transform", attrs, zoom)
            out = F.when(how == "uppercase", F.upper(out)).when(how == "lowercase", F.lower(out)).otherwise(out)
        return out

    def varies(self, name: str) -> bool:
        """Whether a property's value is computed; if not, the optimizer folds it into a literal."""
        return any(S.is_expression(self.properties.get(n)) for n in (name, _OPACITY_OF.get(name), "text-transform"))

    def depends_on_feature(self) -> bool:
        return any(S.is_expression(e) and S.depends_on_feature(e) for e in self.properties.values())

    def size_depends_on_zoom(self) -> bool:
        return any(S.is_expression(e) and S.depends_on_zoom(e) for n, e in self.properties.items() if n in ("line-width", "circle-radius", "circle-stroke-width"))

    def to_json(self) -> dict:
        out: dict = {"id": self.id, "type": self.type}
        for key, v in (("source", self.source), ("source-layer", self.source_layer), ("minzoom", self.min_zoom), ("maxzoom", self.max_zoom), ("filter", None if self.filter is True else self.filter)):
            if v is not None:
                out[key] = v
        for section in ("layout", "paint"):
            held = {n: v for n, v in self.properties.items() if PROPERTIES[self.type][n][0] == section}
            if section == "layout" and not self.visible:
                held["visibility"] = "none"
            if held:
                out[section] = held
        return out | ({"metadata": self.metadata} if self.metadata is not None else {})


@dataclass(frozen=True)
class Style:
    layers: tuple[Layer, ...]
    name: str = ""
    sources: dict = field(default_factory=dict)
    rest: dict = field(default_factory=dict)

    def to_json(self) -> str:
        return json.dumps({"version": 8, **({"name": self.name} if self.name else {}), **self.rest, "sources": self.sources, "layers": [x.to_json() for x in self.layers]}, indent=2)


def _want(ok: bool, path: str, what: str) -> None:
    if not ok:
        raise S.StyleError(f"{path}: {what}")


def _is_number(v) -> bool:
    return isinstance(v, (int, float)) and not isinstance(v, bool)


def _source(v, path: str) -> None:
    _want(isinstance(v, dict), path, "a source is an object")
    for key, x in v.items():
        p = f"{path}.{key}"
        if key == "type" and x != "vector" or key == "scheme" and x != "xyz" or key not in ("type", "scheme", "url", "attribution", "minzoom", "maxzoom", "tiles", "bounds"):
            raise S.UnsupportedStyle(f"{p}: {x!r} is not supported")
        if key in ("url", "attribution"):
            _want(isinstance(x, str), p, "expected a string")
        elif key in ("minzoom", "maxzoom"):
            _want(_is_number(x) and x == int(x) and 0 <= x < 256, p, "expected a zoom level")
        elif key == "tiles":
            _want(isinstance(x, list) and all(isinstance(t, str) for t in x), p, "expected an array of strings")
        elif key == "bounds":
            _want(isinstance(x, list) and len(x) == 4 and all(map(_is_number, x)), p, "expected four numbers")
    _want("url" in v or bool(v.get("tiles")), path, "a vector source needs url or tiles")


def _property(kind: str, name: str, v, path: str):
    """A property's JSON, checked by compiling it; a text-field {name} is the attribute of that name."""
    if name == "text-field" and isinstance(v, str) and ("{" in v or "}" in v):
        key = v[1:-1]
        if not (v.startswith("{") and v.endswith("}") and key) or "{" in key or "}" in key:
            raise S.UnsupportedStyle(f"{path}: text-field {v!r} is not supported")
        v = ["get", key]
    _, of, default, among = PROPERTIES[kind][name]
    try:
        S.property_column(v, F.lit(None).cast("map<string,string>"), F.lit(0.0), default, of, among)
    except S.StyleError as e:
        raise type(e)(f"{path}: {e}") from None
    return v


def _layer(v, path: str) -> Layer:
    _want(isinstance(v, dict), path, "a layer is an object")
    for key in ("id", "type"):
        _want(key in v, f"{path}.{key}", "missing")
    for key in v:
        if key not in LAYER_KEYS:
            raise S.UnsupportedStyle(f"{path}.{key}: the layer property is not supported")
    for key in ("id", "type", "source", "source-layer"):
        _want(isinstance(v.get(key, ""), str), f"{path}.{key}", "expected a string")
    for key in ("minzoom", "maxzoom"):
        _want(_is_number(v.get(key, 0)), f"{path}.{key}", "expected a number")
    if v["type"] not in PROPERTIES:
        known = v["type"] in UNSUPPORTED_TYPES
        raise (S.UnsupportedStyle if known else S.StyleError)(f"{path}.type: the layer type {v['type']} is not supported")
    visible, properties = True, {}
    for section in ("layout", "paint"):
        held = v.get(section, {})
        _want(isinstance(held, dict), f"{path}.{section}", "expected an object")
        for name, x in held.items():
            p = f"{path}.{section}.{name}"
            if section == "layout" and name == "visibility":
                _want(x in ("visible", "none"), p, "expected visible or none")
                visible = x == "visible"
            elif PROPERTIES[v["type"]].get(name, (None,))[0] != section:
                raise S.UnsupportedStyle(f"{p}: the property is not supported")
            else:
                properties[name] = _property(v["type"], name, x, p)
    if v["type"] != "background":
        for key in ("source", "source-layer"):
            _want(key in v, f"{path}.{key}", "missing")
    keep = True
    if "filter" in v:
        try:
            keep = S.plain_filter(v["filter"])
            S.compile_expr(keep, F.lit(None).cast("map<string,string>"), F.lit(0.0))
        except S.StyleError as e:
            raise type(e)(f"{path}.filter: {e}") from None
    return Layer(v["id"], v["type"], v.get("source"), v.get("source-layer"), v.get("minzoom"), v.get("maxzoom"), keep, visible, properties, v.get("metadata"))


def parse(document: str | dict) -> Style:
    """The style of a JSON document; a StyleError names the place of what isn't valid or not supported."""
    if isinstance(document, str):
        try:
            document = json.loads(document)
        except ValueError as e:
            raise S.StyleError(f"not JSON: {e}") from None
    _want(isinstance(document, dict), "style", "a style is an object")
    _want("version" in document, "version", "missing")
    name, sources, layers, rest = "", {}, [], {}
    for key, v in document.items():
        if key == "version":
            _want(v == 8 and not isinstance(v, bool), key, "only version 8 is supported")
        elif key == "name":
            _want(isinstance(v, str), key, "expected a string")
            name = v
        elif key == "sources":
            _want(isinstance(v, dict), key, "expected an object")
            for source, x in v.items():
                _source(x, f"sources.{source}")
            sources = v
        elif key == "layers":
            _want(isinstance(v, list), key, "expected an array")
            layers = [_layer(x, f"layers[{i}]") for i, x in enumerate(v)]
        elif key in ("glyphs", "metadata", "center", "zoom"):
            _want(key != "glyphs" or isinstance(v, str), key, "expected a string")
            _want(key != "zoom" or _is_number(v), key, "expected a number")
            _want(key != "center" or isinstance(v, list) and len(v) == 2 and all(map(_is_number, v)), key, "expected [lon, lat]")
            rest[key] = v
        elif key not in ("bearing", "pitch") or v != 0:
            raise S.UnsupportedStyle(f"{key}: the style property is not supported")
    seen = set()
    for i, x in enumerate(layers):
        _want(x.id not in seen, f"layers[{i}].id", f"the id {x.id} is there twice")
        seen.add(x.id)
        _want(x.source is None or x.source in sources, f"layers[{i}].source", f"unknown source {x.source}")
    return Style(tuple(layers), name, sources, rest)


def drawn(features: DataFrame, style: Style, zoom: Column) -> DataFrame:
    """`features` (layer, attrs map<string, string>, others) with layer_id, layer_rank, layer_type and paint, a row for each style layer that draws them.

    `zoom` is a Column of `features`. paint is a map of the layer's properties as text: colours as CSS, numbers in plain
    digits, arrays in brackets. Background layers draw no features.
    """
    zoom, attrs, rows = zoom.cast("double"), F.col("attrs"), []
    for rank, x in enumerate(style.layers):
        if x.type == "background":
            continue
        paint = []
        for name, (_, kind, _, _) in PROPERTIES[x.type].items():
            if name not in _OPACITY_OF.values():
                text = lambda v: S._text_of(S.Value({kind: v}, F.lit(False)))  # noqa: E731, B023
                value = x.resolved(name, attrs, zoom)
                paint += [F.lit(name), S.bound(value, text) if x.varies(name) else text(value)]
        row = F.struct(F.lit(x.id).alias("layer_id"), F.lit(rank).alias("layer_rank"), F.lit(x.type).alias("layer_type"), F.create_map(*paint).alias("paint"))
        rows.append(F.when((F.col("layer") == x.source_layer) & x.active(zoom) & S.filter_column(x.filter, attrs, zoom), row))
    if not rows:
        return features.limit(0).withColumns({"layer_id": F.lit(""), "layer_rank": F.lit(0), "layer_type": F.lit(""), "paint": F.create_map().cast("map<string,string>")})
    out = features.withColumn("_drawn", F.explode(F.filter(F.array(*rows), lambda r: r.isNotNull())))
    return out.select(*features.columns, "_drawn.*")
