"""CSS colours: read in Python where a style gives them, and as Columns where features do.

A colour is straight red, green, blue and alpha from 0 to 1; as a Column a struct of four doubles.
"""

from __future__ import annotations

import math
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

COLOR = "struct<r:double,g:double,b:double,a:double>"
TRANSPARENT = (0.0, 0.0, 0.0, 0.0)
BLACK = (0.0, 0.0, 0.0, 1.0)

# The named colours of CSS.
NAMED = {
    "aliceblue": "#f0f8ff", "antiquewhite": "#faebd7", "aqua": "#00ffff", "aquamarine": "#7fffd4", "azure": "#f0ffff", "beige": "#f5f5dc", "bisque": "#ffe4c4", "black": "#000000",
    "blanchedalmond": "#ffebcd", "blue": "#0000ff", "blueviolet": "#8a2be2", "brown": "#a52a2a", "burlywood": "#deb887", "cadetblue": "#5f9ea0", "chartreuse": "#7fff00", "chocolate": "#d2691e",
    "coral": "#ff7f50", "cornflowerblue": "#6495ed", "cornsilk": "#fff8dc", "crimson": "#dc143c", "cyan": "#00ffff", "darkblue": "#00008b", "darkcyan": "#008b8b", "darkgoldenrod": "#b8860b",
    "darkgray": "#a9a9a9", "darkgreen": "#006400", "darkgrey": "#a9a9a9", "darkkhaki": "#bdb76b", "darkmagenta": "#8b008b", "darkolivegreen": "#556b2f", "darkorange": "#ff8c00", "darkorchid": "#9932cc",
    "darkred": "#8b0000", "darksalmon": "#e9967a", "darkseagreen": "#8fbc8f", "darkslateblue": "#483d8b", "darkslategray": "#2f4f4f", "darkslategrey": "#2f4f4f", "darkturquoise": "#00ced1", "darkviolet": "#9400d3",
    "deeppink": "#ff1493", "deepskyblue": "#00bfff", "dimgray": "#696969", "dimgrey": "#696969", "dodgerblue": "#1e90ff", "firebrick": "#b22222", "floralwhite": "#fffaf0", "forestgreen": "#228b22",
    "fuchsia": "#ff00ff", "gainsboro": "#dcdcdc", "ghostwhite": "#f8f8ff", "gold": "#ffd700", "goldenrod": "#daa520", "gray": "#808080", "green": "#008000", "greenyellow": "#adff2f",
    "grey": "#808080", "honeydew": "#f0fff0", "hotpink": "#ff69b4", "indianred": "#cd5c5c", "indigo": "#4b0082", "ivory": "#fffff0", "khaki": "#f0e68c", "lavender": "#e6e6fa",
    "lavenderblush": "#fff0f5", "lawngreen": "#7cfc00", "lemonchiffon": "#fffacd", "lightblue": "#add8e6", "lightcoral": "#f08080", "lightcyan": "#e0ffff", "lightgoldenrodyellow": "#fafad2", "lightgray": "#d3d3d3",
    "lightgreen": "#90ee90", "lightgrey": "#d3d3d3", "lightpink": "#ffb6c1", "lightsalmon": "#ffa07a", "lightseagreen": "#20b2aa", "lightskyblue": "#87cefa", "lightslategray": "#778899", "lightslategrey": "#778899",
    "lightsteelblue": "#b0c4de", "lightyellow": "#ffffe0", "lime": "#00ff00", "limegreen": "#32cd32", "linen": "#faf0e6", "magenta": "#ff00ff", "maroon": "#800000", "mediumaquamarine": "#66cdaa",
    "mediumblue": "#0000cd", "mediumorchid": "#ba55d3", "mediumpurple": "#9370db", "mediumseagreen": "#3cb371", "mediumslateblue": "#7b68ee", "mediumspringgreen": "#00fa9a", "mediumturquoise": "#48d1cc", "mediumvioletred": "#c71585",
    "midnightblue": "#191970", "mintcream": "#f5fffa", "mistyrose": "#ffe4e1", "moccasin": "#ffe4b5", "navajowhite": "#ffdead", "navy": "#000080", "oldlace": "#fdf5e6", "olive": "#808000",
    "olivedrab": "#6b8e23", "orange": "#ffa500", "orangered": "#ff4500", "orchid": "#da70d6", "palegoldenrod": "#eee8aa", "palegreen": "#98fb98", "paleturquoise": "#afeeee", "palevioletred": "#db7093",
    "papayawhip": "#ffefd5", "peachpuff": "#ffdab9", "peru": "#cd853f", "pink": "#ffc0cb", "plum": "#dda0dd", "powderblue": "#b0e0e6", "purple": "#800080", "rebeccapurple": "#663399",
    "red": "#ff0000", "rosybrown": "#bc8f8f", "royalblue": "#4169e1", "saddlebrown": "#8b4513", "salmon": "#fa8072", "sandybrown": "#f4a460", "seagreen": "#2e8b57", "seashell": "#fff5ee",
    "sienna": "#a0522d", "silver": "#c0c0c0", "skyblue": "#87ceeb", "slateblue": "#6a5acd", "slategray": "#708090", "slategrey": "#708090", "snow": "#fffafa", "springgreen": "#00ff7f",
    "steelblue": "#4682b4", "tan": "#d2b48c", "teal": "#008080", "thistle": "#d8bfd8", "tomato": "#ff6347", "turquoise": "#40e0d0", "violet": "#ee82ee", "wheat": "#f5deb3",
    "white": "#ffffff", "whitesmoke": "#f5f5f5", "yellow": "#ffff00", "yellowgreen": "#9acd32",
}

_CALL = re.compile(r"(rgba?|hsla?|hwb)\(\s*(.*?)\s*\)")
_PART = re.compile(r"([+-]?(?:\d+\.?\d*|\.\d+)(?:e[+-]?\d+)?)(%|deg|rad|grad|turn)?")


def _hex(digits: str) -> tuple | None:
    if not re.fullmatch(r"[0-9a-f]{3,4}|[0-9a-f]{6}|[0-9a-f]{8}", digits):
        return None
    pairs = [c * 2 for c in digits] if len(digits) < 6 else [digits[i : i + 2] for i in range(0, len(digits), 2)]
    channels = [int(p, 16) / 255 for p in pairs]
    return tuple(channels + [1.0])[:4]


def _of_hue(h: float, s: float, v: float) -> tuple[float, float, float]:
    """Red, green and blue of hue in turns, saturation and lightness."""

    def channel(n: float) -> float:
        k = (n + h * 12) % 12
        return v - s * min(v, 1 - v) * max(-1.0, min(k - 3, 9 - k, 1.0))

    return channel(0), channel(8), channel(4)


def parse(text: str) -> tuple[float, float, float, float]:
    """The colour that CSS text names; channels are whole 255ths. A ValueError for anything else."""
    low = text.strip().lower()
    found = TRANSPARENT if low == "transparent" else _hex(low[1:]) if low.startswith("#") else _hex(NAMED[low][1:]) if low in NAMED else _called(low)
    if found is None:
        raise ValueError(f"no colour: {text!r}")
    clamp = lambda v: min(max(v, 0.0), 1.0)
    r, g, b = (math.floor(clamp(v) * 255 + 0.5) / 255 for v in found[:3])
    return r, g, b, clamp(found[3])


def _called(low: str) -> tuple | None:
    call = _CALL.fullmatch(low)
    if not call:
        return None
    body, _, alpha = call[2].partition("/")
    commas = "," in body
    if commas and alpha:
        return None
    words = [w.strip() for w in body.split(",")] if commas else body.split()
    if commas and len(words) == 4:
        alpha = words.pop()
    parts = [_PART.fullmatch(w) for w in words]
    last = _PART.fullmatch(alpha.strip()) if alpha.strip() else None
    if len(parts) != 3 or not all(parts) or (alpha.strip() and not last):
        return None
    a = 1.0 if last is None else float(last[1]) / (100 if last[2] == "%" else 1)
    numbers = [(float(p[1]), p[2]) for p in parts]
    if call[1].startswith("rgb"):
        if any(u not in (None, "%") for _, u in numbers):
            return None
        return (*(v / (100 if u == "%" else 255) for v, u in numbers), a)
    turns = {None: 360, "deg": 360, "rad": 2 * math.pi, "grad": 400, "turn": 1}
    if numbers[0][1] not in turns or any(u != "%" for _, u in numbers[1:]):
        return None
    h = numbers[0][0] / turns[numbers[0][1]] % 1
    x, y = (min(max(v / 100, 0.0), 1.0) for v, _ in numbers[1:])
    if call[1] != "hwb":
        return (*_of_hue(h, x, y), a)
    if x + y >= 1:
        return (*(x / (x + y),) * 3, a)
    return (*(c * (1 - x - y) + x for c in _of_hue(h, 1.0, 0.5)), a)


def literal(color: tuple) -> Column:
    return F.struct(*[F.lit(float(v)).alias(n) for n, v in zip("rgba", color)])


def parsed(text: Column) -> Column:
    """Colours of a text Column by Arrow batches; null where the text names none."""

    def one(t):
        try:
            return dict(zip("rgba", parse(t)))
        except ValueError:
            return None

    def run(texts: pd.Series) -> pd.DataFrame:
        known = {t: one(t) for t in texts.dropna().unique()}
        return pd.DataFrame([known.get(t) or dict.fromkeys("rgba") for t in texts], columns=list("rgba"), dtype="float64")

    made = F.pandas_udf(run, COLOR, functionType=F.PandasUDFType.SCALAR)(text)
    return F.when(made["a"].isNotNull() & ~F.isnan(made["a"]), made)


def eighths(channel: Column) -> Column:
    """0 to 255, halves up."""
    return F.floor(F.greatest(F.least(channel, F.lit(1.0)), F.lit(0.0)) * 255 + 0.5).cast("int")


def css(color: Column, number) -> Column:
    """#rrggbb where it is opaque, else rgba(r,g,b,a); `number` formats the alpha."""
    r, g, b, a = (eighths(color[c]) for c in "rgba")
    opaque = F.format_string("#%02x%02x%02x", r, g, b)
    return F.when(color.isNotNull(), F.when(a == 255, opaque).otherwise(F.concat(F.lit("rgba("), r, F.lit(","), g, F.lit(","), b, F.lit(","), number(color["a"]), F.lit(")"))))


def css_of(color: tuple) -> str:
    r, g, b, a = (math.floor(min(max(v, 0.0), 1.0) * 255 + 0.5) for v in color)
    return f"#{r:02x}{g:02x}{b:02x}" if a == 255 else f"rgba({r},{g},{b},{color[3]:g})"


def with_opacity(color: Column, opacity: Column) -> Column:
    a = F.greatest(F.least(color["a"] * opacity, F.lit(1.0)), F.lit(0.0))
    return F.when(color.isNotNull(), F.struct(color["r"].alias("r"), color["g"].alias("g"), color["b"].alias("b"), a.alias("a")))


def premultiplied(color: Column) -> Column:
    return F.struct(*[(color[c] * color["a"]).alias(c) for c in "rgb"], color["a"].alias("a"))


def between(low: Column, high: Column, at: Column) -> Column:
    """The colour `at` of the way from one to another, in premultiplied space; fully transparent where no alpha is left."""
    a, b = premultiplied(low), premultiplied(high)
    mixed = {c: a[c] + (b[c] - a[c]) * at for c in "rgba"}
    straight = F.struct(*[(mixed[c] / mixed["a"]).alias(c) for c in "rgb"], mixed["a"].alias("a"))
    return F.when(mixed["a"] <= 0, literal(TRANSPARENT)).otherwise(straight)
