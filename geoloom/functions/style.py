"""Style expressions compiled to Columns.

An expression is JSON: `["op", args...]`. A value has a Column for each kind that it may have, of which one at most is
not null in a row; a null value has none. An error is a flag beside them: it is neither null nor a value, passes through
operators, and makes a filter false and a property its default. Attributes are a map<string, string> column.

Filters have a grammar of their own, which takes the older forms (`["==", key, value]`, `["in", key, ...]`, `none`) too;
`plain_filter` turns them into expressions. In expressions strings are literals.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import colors

NUMBER, STRING, BOOL, COLOR, NUMBERS, STRINGS = "number", "string", "boolean", "color", "array of numbers", "array of strings"
TYPES = {NUMBER: "double", STRING: "string", BOOL: "boolean", COLOR: colors.COLOR, NUMBERS: "array<double>", STRINGS: "array<string>"}
COMPARISONS = ("==", "!=", "<", "<=", ">", ">=")
OPERATORS = {"literal", "zoom", "get", "has", "!has", *COMPARISONS, "!", "all", "any", "in", "!in", "match", "case", "coalesce", "interpolate", "step", "to-string", "to-number"}
# Operators of the style specification that are known and not supported.
UNSUPPORTED = {
    "array", "boolean", "collator", "format", "image", "number", "number-format", "object", "string", "to-boolean", "to-color", "typeof", "feature-state", "geometry-type", "id", "line-progress", "properties",
    "accumulated", "heatmap-density", "elevation", "let", "var", "concat", "downcase", "upcase", "is-supported-script", "resolved-locale", "rgb", "rgba", "to-rgba", "e", "ln2", "pi", "ln", "log10", "log2",
    "sin", "cos", "tan", "asin", "acos", "atan", "min", "max", "round", "abs", "ceil", "floor", "distance", "sqrt", "+", "-", "*", "/", "%", "^", "within", "at", "index-of", "length", "slice", "interpolate-hcl", "interpolate-lab",
}
#: Deepest nesting.
DEPTH = 256


class StyleError(ValueError):
    """An expression that isn't valid."""


class UnsupportedStyle(StyleError):
    """A form that the style specification knows and this engine doesn't."""


_ABSENT = object()


@dataclass
class Value:
    parts: dict[str, Column]
    error: Column
    constant: object = _ABSENT

    def part(self, kind: str) -> Column:
        return self.parts[kind] if kind in self.parts else F.lit(None).cast(TYPES[kind])

    def is_null(self) -> Column:
        return reduce(lambda a, b: a & b, (c.isNull() for c in self.parts.values()), F.lit(True))



def _value(kind: str, column: Column, *of: Value) -> Value:
    return Value({kind: column}, reduce(lambda a, b: a | b, (v.error for v in of), F.lit(False)))


def _failed() -> Value:
    return Value({}, F.lit(True))


def _check_literal(x, depth: int = 0) -> None:
    if depth > DEPTH:
        raise StyleError("the expression is nested too deep")
    if isinstance(x, list):
        for y in x:
            _check_literal(y, depth + 1)
    elif not (x is None or isinstance(x, (bool, int, float, str))):
        raise StyleError(f"no literal: {x!r}")


def _literal(x, depth: int = 0, as_color: bool = False) -> Value:
    _check_literal(x, depth)
    if as_color:
        if not isinstance(x, str):
            raise StyleError(f"no colour: {x!r}")
        try:
            return Value({COLOR: colors.literal(colors.parse(x))}, F.lit(False), x)
        except ValueError as e:
            raise StyleError(str(e)) from None
    if x is None:
        parts = {}
    elif isinstance(x, bool):
        parts = {BOOL: F.lit(x)}
    elif isinstance(x, (int, float)):
        parts = {NUMBER: F.lit(float(x))}
    elif isinstance(x, str):
        parts = {STRING: F.lit(x)}
    elif x and all(isinstance(y, str) for y in x):
        parts = {STRINGS: F.array(*[F.lit(y) for y in x])}
    elif all(isinstance(y, (int, float)) and not isinstance(y, bool) for y in x):
        parts = {NUMBERS: F.array(*[F.lit(float(y)) for y in x]).cast("array<double>")}
    else:
        parts = {}  # a mixed array is looked at as a constant only
    return Value(parts, F.lit(False), x)


def _truth(v: Value) -> tuple[Column, Column]:
    """(value, error): anything but a bool is an error."""
    held = v.part(BOOL)
    return F.coalesce(held, F.lit(False)), v.error | held.isNull()


def _same(a: Value, b: Value) -> Column:
    out = a.is_null() & b.is_null()
    for kind in a.parts.keys() & b.parts.keys():
        x, y = a.parts[kind], b.parts[kind]
        equal = (x == y) & ~F.isnan(x) if kind == NUMBER else x == y
        out = out | F.coalesce(equal, F.lit(False))
    return out


def number_text(n: Column) -> Column:
    """A number in its shortest digits without exponent; whole numbers without a point."""
    text = n.cast("string")
    plain = F.regexp_replace(F.replace(text, F.lit("Infinity"), F.lit("inf")), r"(?:(\.[0-9]*[1-9])|\.)0*$", "$1")
    power = F.regexp_extract(text, "E(-?[0-9]+)$", 1).try_cast("int")
    digits = F.regexp_replace(text, r"^-|E.*$|\.0(?=E)|\.", "")
    above = F.regexp_replace(F.concat(F.rpad(digits, power + 1, "0"), F.lit("."), F.substring(digits, power + 2, F.length(digits))), r"\.$", "")
    below = F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)
    moved = F.concat(F.regexp_extract(text, "^-", 0), F.when(power < 0, below).otherwise(above))
    return F.when(text.contains("E"), moved).otherwise(plain)


def bound(value: Column, form) -> Column:
    """`form` of a value that is computed once, however often `form` names it."""
    return F.get(F.transform(F.array(value), form), F.lit(0))


def _quoted(s: str) -> str:
    return '"' + s.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\r", "\\r").replace("\t", "\\t") + '"'


def _text_of_constant(x) -> str:
    if isinstance(x, list):
        return "[" + ",".join(_quoted(y) if isinstance(y, str) else _text_of_constant(y) for y in x) + "]"
    if isinstance(x, bool):
        return str(x).lower()
    if x is None:
        return ""
    if isinstance(x, str):
        return x
    text = f"{float(x):.17g}"
    text = next(t for t in (f"{float(x):.{d}f}" for d in range(0, 340)) if float(t) == float(x)) if "e" in text or "." in text else text
    return text


def _text_of(v: Value) -> Column:
    if isinstance(v.constant, list):
        return F.lit(_text_of_constant(v.constant))
    joined = lambda items: F.concat(F.lit("["), F.array_join(items, ","), F.lit("]"))
    quoted = lambda s: F.concat(F.lit('"'), F.replace(F.replace(s, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    forms = {
        NUMBER: number_text, STRING: lambda c: c, BOOL: lambda c: c.cast("string"), COLOR: lambda c: colors.css(c, number_text),
        NUMBERS: lambda c: joined(F.transform(c, number_text)), STRINGS: lambda c: joined(F.transform(c, quoted)),
    }
    return F.coalesce(*[forms[k](c) for k, c in v.parts.items()], F.lit(""))


def _number_of(v: Value) -> tuple[Column, Column]:
    """to-number of a value: (number, whether it has none). Null and '' are 0, bools 0 or 1, text is trimmed; what isn't a finite number has none."""
    text = F.trim(v.part(STRING))
    plain = F.when(text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), text.try_cast("double"))
    of_text = F.when(text == "", F.lit(0.0)).otherwise(plain)
    number = v.part(NUMBER)
    out = F.coalesce(number, v.part(BOOL).cast("double"), of_text, F.when(v.is_null(), F.lit(0.0)))
    if isinstance(v.constant, list):
        out = F.lit(None).cast("double")
    return F.coalesce(out, F.lit(0.0)), out.isNull() | (number.isNull() & F.abs(out).isin(float("inf")))


def _choose(arms: list[tuple[Column, Value]], other: Value) -> Value:
    """The value of the first arm whose condition holds."""
    kinds = {k for v in [other, *(v for _, v in arms)] for k in v.parts}
    parts, error = {k: other.part(k) for k in kinds}, other.error
    for when, v in reversed(arms):
        parts = {k: F.when(when, v.part(k)).otherwise(c) for k, c in parts.items()}
        error = F.when(when, v.error).otherwise(error)
    return Value(parts, error)


def _arity(op: str, args: list, n: int) -> None:
    if len(args) != n:
        raise StyleError(f"{op} takes {n} arguments")


def compile_expr(e, attrs: Column, zoom: Column, depth: int = 0, as_color: bool = False) -> Value:
    """The value of an expression; with `as_color` its literal outcomes are colours."""
    if depth > DEPTH:
        raise StyleError("the expression is nested too deep")
    if not isinstance(e, list):
        return _literal(e, depth, as_color)
    if not e or not isinstance(e[0], str):
        raise StyleError("an expression begins with an operator's name")
    op, args = e[0], e[1:]
    if op not in OPERATORS:
        raise UnsupportedStyle(f"{op} is not supported")
    sub = lambda x: compile_expr(x, attrs, zoom, depth + 1)
    out = lambda x: compile_expr(x, attrs, zoom, depth + 1, as_color)
    if op == "literal":
        _arity(op, args, 1)
        return _literal(args[0], depth + 1, as_color)
    if op == "zoom":
        _arity(op, args, 0)
        return _value(NUMBER, zoom.cast("double"))
    if op in ("get", "has", "!has"):
        if len(args) == 2:
            raise UnsupportedStyle(f"{op} of an object is not supported")
        _arity(op, args, 1)
        key = sub(args[0])
        name = key.part(STRING)
        error = key.error | name.isNull()
        found = F.try_element_at(attrs, F.coalesce(name, F.lit("")))
        if op == "get":
            return Value({STRING: F.when(~error, found)}, error)
        there = F.coalesce(F.array_contains(F.map_keys(attrs), F.coalesce(name, F.lit(""))), F.lit(False))
        return Value({BOOL: there if op == "has" else ~there}, error)
    if op in COMPARISONS:
        if len(args) == 3:
            raise UnsupportedStyle(f"{op} with a collator is not supported")
        _arity(op, args, 2)
        a, b = map(sub, args)
        if op in ("==", "!="):
            same = _same(a, b)
            return _value(BOOL, same if op == "==" else ~same, a, b)
        test = lambda x, y: {"<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]
        x, y = a.part(NUMBER), b.part(NUMBER)
        held = F.coalesce(test(x, y) & ~F.isnan(x) & ~F.isnan(y), test(a.part(STRING), b.part(STRING)))
        return Value({BOOL: held}, a.error | b.error | held.isNull())
    if op == "!":
        _arity(op, args, 1)
        v, err = _truth(sub(args[0]))
        return Value({BOOL: ~v}, err)
    if op in ("all", "any"):
        stop = op == "any"  # the value that ends the evaluation
        value, error = F.lit(not stop), F.lit(False)
        for v, err in reversed([_truth(sub(x)) for x in args]):
            value = F.when(err, F.lit(False)).when(v == F.lit(stop), F.lit(stop)).otherwise(value)
            error = F.when(err, True).when(v == F.lit(stop), False).otherwise(error)
        return Value({BOOL: value}, error)
    if op in ("in", "!in"):
        _arity(op, args, 2)
        needle, hay = sub(args[0]), sub(args[1])
        if isinstance(hay.constant, list):
            held = reduce(lambda a, b: a | b, (_same(needle, _literal(x)) for x in hay.constant if not isinstance(x, list)), F.lit(False))
            bad = F.lit(False)
        else:
            member = [F.when(hay.parts[k].isNotNull(), F.coalesce(F.array_contains(hay.parts[k], needle.part(one)), F.lit(False))) for k, one in ((STRINGS, STRING), (NUMBERS, NUMBER)) if k in hay.parts]
            held = F.coalesce(*member, F.contains(hay.part(STRING), needle.part(STRING)))
            bad = held.isNull()
        return Value({BOOL: held if op == "in" else ~held}, needle.error | hay.error | bad)
    if op == "match":
        if len(args) < 4 or len(args) % 2:
            raise StyleError("match takes a value, labels with outcomes, and a default")
        v, arms, seen, kinds = sub(args[0]), [], [], set()
        for labels, outcome in zip(args[1:-1:2], args[2:-1:2]):
            labels = labels if isinstance(labels, list) else [labels]
            kinds |= {STRING if isinstance(x, str) else NUMBER if isinstance(x, (int, float)) and not isinstance(x, bool) else None for x in labels}
            if not labels or len(kinds) != 1 or None in kinds or any(x in seen for x in labels) or len(set(labels)) < len(labels):
                raise StyleError("labels are all strings or all numbers, each once")
            seen += labels
            (kind,) = kinds
            hit = v.part(kind).isin([float(x) if kind == NUMBER else x for x in labels])
            arms.append((F.coalesce(hit, F.lit(False)), out(outcome)))
        got = _choose(arms, out(args[-1]))
        return Value(got.parts, got.error | v.error)
    if op == "case":
        if len(args) < 3 or not len(args) % 2:
            raise StyleError("case takes conditions with outcomes, and a default")
        arms = []
        for condition, outcome in zip(args[:-1:2], args[1:-1:2]):
            v, err = _truth(sub(condition))
            arms += [(err, _failed()), (v, out(outcome))]
        return _choose(arms, out(args[-1]))
    if op == "coalesce":
        if not args:
            raise StyleError("coalesce takes a value at least")
        parts = [out(x) for x in args]
        return _choose([(p.error | ~p.is_null(), p) for p in parts], Value({}, F.lit(False)))  # null falls through, an error does not
    if op == "to-string":
        _arity(op, args, 1)
        v = sub(args[0])
        return _value(STRING, _text_of(v), v)
    if op == "to-number":
        if not args:
            raise StyleError("to-number takes a value at least")
        arms = []
        for v in map(sub, args):
            n, none = _number_of(v)
            arms += [(v.error, _failed()), (~none, _value(NUMBER, n))]
        return _choose(arms, _failed())
    if op == "step":
        if len(args) < 2 or len(args) % 2:
            raise StyleError("step takes a number, a base, and stops with outcomes")
        stops = _stops(args[2::2])
        x, base, outs = sub(args[0]), out(args[1]), [out(a) for a in args[3::2]]
        at, bad = _finite(x)
        got = _choose([(at >= F.lit(s), o) for s, o in reversed(list(zip(stops, outs)))], base)
        return Value(got.parts, got.error | bad)
    if len(args) < 4 or len(args) % 2 or not isinstance(args[0], list):
        raise StyleError("interpolate takes a curve, a number, and stops with outcomes")
    return _interpolated(args, sub, out)


def _stops(given: list) -> list[float]:
    if any(isinstance(s, bool) or not isinstance(s, (int, float)) for s in given) or any(a >= b for a, b in zip(given, given[1:])):
        raise StyleError("stops are rising numbers")
    return [float(s) for s in given]


def _finite(x: Value) -> tuple[Column, Column]:
    """(number, error) of an input that must be a finite number."""
    n = x.part(NUMBER)
    good = n.isNotNull() & ~F.isnan(n) & (F.abs(n) < float("inf"))
    return F.when(good, n), x.error | ~good


def _interpolated(args: list, sub, out) -> Value:
    kind = args[0][0] if args[0] else None
    if kind not in ("linear", "exponential"):
        raise (UnsupportedStyle if isinstance(kind, str) else StyleError)(f"no curve: {args[0]!r}")
    base = args[0][1] if kind == "exponential" and len(args[0]) == 2 else 1.0 if args[0] == ["linear"] else None
    if isinstance(base, bool) or not isinstance(base, (int, float)) or not 0 < base < float("inf"):
        raise StyleError("a curve is linear or exponential with a base above 0")
    stops, outs = _stops(args[2::2]), [out(a) for a in args[3::2]]
    x, bad = _finite(sub(args[1]))

    def as_color(v: Value) -> Column | None:
        if isinstance(v.constant, str) and COLOR not in v.parts:
            try:
                return colors.literal(colors.parse(v.constant))
            except ValueError:
                return None
        made = [v.parts[COLOR]] if COLOR in v.parts else []
        if STRING in v.parts:
            made.append(colors.parsed(v.parts[STRING]))
        return F.coalesce(*made) if made else None

    arms = [(x <= F.lit(stops[0]), outs[0])]
    for s0, s1, o0, o1 in zip(stops, stops[1:], outs, outs[1:]):
        if abs(base - 1.0) > 2.220446049250313e-16:
            at = (F.pow(F.lit(float(base)), x - s0) - 1) / F.lit(_power_less_one(base, s1 - s0))
            at = F.when(F.isnan(at) | (F.abs(at) == float("inf")), F.pow(F.lit(float(base)), x - s1)).otherwise(at)
        else:
            at = (x - s0) / (s1 - s0)
        at = F.greatest(F.least(at, F.lit(1.0)), F.lit(0.0))
        n0, n1 = o0.part(NUMBER), o1.part(NUMBER)
        parts = {NUMBER: n0 + (n1 - n0) * at} if NUMBER in o0.parts and NUMBER in o1.parts else {}
        c0, c1 = as_color(o0), as_color(o1)
        if c0 is not None and c1 is not None:
            parts[COLOR] = F.when(c0.isNotNull() & c1.isNotNull(), colors.between(c0, c1, at))
        mixed = Value(parts, F.lit(False))
        arms.append((x < F.lit(s1), Value(parts, o0.error | o1.error | mixed.is_null())))
    got = _choose(arms, outs[-1])
    return Value(got.parts, got.error | bad)


def _power_less_one(base: float, span: float) -> float:
    try:
        return float(base) ** span - 1
    except OverflowError:
        return float("inf")


def plain_filter(e, depth: int = 0):
    """A filter as an expression: the older forms are rewritten, the rest stays."""
    if depth > DEPTH:
        raise StyleError("the filter is nested too deep")
    if not isinstance(e, list) or not e or not isinstance(e[0], str):
        return e
    op, args = e[0], e[1:]

    def key(x) -> str:
        if not isinstance(x, str):
            raise StyleError("a filter names a property")
        if x.startswith("$"):
            raise UnsupportedStyle(f"the filter key {x} is not supported")
        return x

    def scalar(x):
        if isinstance(x, (list, dict)):
            raise StyleError("values of older filters are strings, numbers, booleans or null")
        return x

    if op in ("all", "any"):
        return [op, *(plain_filter(a, depth + 1) for a in args)]
    if op == "none":
        return ["!", ["any", *(plain_filter(a, depth + 1) for a in args)]]
    if op in ("has", "!has") and len(args) == 1 and isinstance(args[0], str):
        return ["has", key(args[0])] if op == "has" else ["!", ["has", key(args[0])]]
    if op in ("in", "!in"):
        if op == "in" and len(args) >= 2 and (not isinstance(args[0], str) or isinstance(args[1], list)):
            return e
        name, labels = key(args[0] if args else None), []
        for x in args[1:]:
            if not any(x == y and type(x) is type(y) for y in labels):
                labels.append(scalar(x))
        numbers = all(isinstance(x, (int, float)) and not isinstance(x, bool) for x in labels)
        if not labels:
            test = False
        elif numbers or all(isinstance(x, str) for x in labels):
            test = ["match", ["get", name], labels, True, False]
        else:
            test = ["in", ["get", name], ["literal", labels]]
        return test if op == "in" else ["!", test]
    if op in COMPARISONS and len(args) == 2 and not any(isinstance(a, list) for a in args):
        return [op, ["get", key(args[0])], scalar(args[1])]
    return e


def _below(e):
    """The parts of an expression that are evaluated."""
    if isinstance(e, list) and e and isinstance(e[0], str) and e[0] != "literal":
        args = e[1:]
        if e[0] == "match":
            yield from (args[0], *args[2:-1:2], args[-1])
        elif e[0] in ("interpolate", "step"):
            yield from (args[1], *args[3::2]) if e[0] == "interpolate" else (args[0], args[1], *args[3::2])
        else:
            yield from args


def depends_on(e, operators: tuple[str, ...]) -> bool:
    return isinstance(e, list) and bool(e) and (e[0] in operators or any(depends_on(x, operators) for x in _below(e)))


def depends_on_feature(e) -> bool:
    return depends_on(e, ("get", "has", "!has"))


def depends_on_zoom(e) -> bool:
    return depends_on(e, ("zoom",))


def is_expression(e) -> bool:
    """Whether JSON is an array headed by an operator's name, be it supported or not."""
    return isinstance(e, list) and bool(e) and isinstance(e[0], str) and (e[0] in OPERATORS or e[0] in UNSUPPORTED)


def filter_column(e, attrs: Column, zoom: Column) -> Column:
    """Whether a filter holds; errors, and anything but true, are no match."""
    v, err = _truth(compile_expr(plain_filter(e), attrs, zoom))
    return v & ~err


def _typed(v: Value, kind: str) -> Column:
    """A value as a property of a kind takes it; null where it doesn't."""
    if kind == NUMBER:
        n = v.part(NUMBER)
        return F.when(~F.isnan(n) & (F.abs(n) < float("inf")), n)
    if kind == STRING:
        scalar = Value({k: c for k, c in v.parts.items() if k not in (NUMBERS, STRINGS)}, v.error)
        return F.when(~scalar.is_null(), _text_of(scalar))
    if kind == COLOR:
        return F.coalesce(v.part(COLOR), colors.parsed(v.parts[STRING])) if STRING in v.parts else v.part(COLOR)
    if kind == NUMBERS:
        given = v.part(NUMBERS)
        return F.when(F.forall(given, lambda n: ~F.isnan(n) & (F.abs(n) < float("inf"))), given)
    return v.part(kind)


def _constant(x, kind: str):
    """A property's constant, checked."""
    number = lambda y: isinstance(y, (int, float)) and not isinstance(y, bool)
    good = {
        NUMBER: number(x), STRING: isinstance(x, str), BOOL: isinstance(x, bool), COLOR: isinstance(x, str), NUMBERS: isinstance(x, list) and all(map(number, x)),
        STRINGS: isinstance(x, list) and all(isinstance(y, str) for y in x),
    }[kind]
    if not good:
        raise StyleError(f"expected {kind}, found {x!r}")


def _default(x, kind: str) -> Column:
    if kind == COLOR:
        return colors.literal(x if isinstance(x, tuple) else colors.parse(x))
    return F.array(*[F.lit(y) for y in x]).cast(TYPES[kind]) if isinstance(x, (list, tuple)) else F.lit(x).cast(TYPES[kind])


def kind_of(default) -> str:
    if isinstance(default, (list, tuple)):
        return STRINGS if default and isinstance(default[0], str) else NUMBERS
    return BOOL if isinstance(default, bool) else NUMBER if isinstance(default, (int, float)) else STRING


def property_column(e, attrs: Column, zoom: Column, default, kind: str | None = None, among: tuple[str, ...] = ()) -> Column:
    """A property's value, of `kind` (that of the default if not given); null, errors and values of another kind give the default.

    Strings take any scalar as text, colours take text that names one, and `among` names the words that are allowed.
    """
    kind = kind or kind_of(default)
    if is_expression(e):
        v = compile_expr(e, attrs, zoom, as_color=kind == COLOR)
        made = F.when(~v.error, v.part(STRING) if among else _typed(v, kind))
    else:
        _constant(e, kind)
        if among and e not in among:
            raise StyleError(f"expected one of {among}, found {e!r}")
        made = _literal(e, as_color=kind == COLOR).part(kind)
    if among:
        made = F.when(made.isin(*among), made)
    return F.coalesce(made, _default(default, kind))
