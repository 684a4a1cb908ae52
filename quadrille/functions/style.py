"""The style grammar: single, classified, ruled and heat descriptors, and rules as predicates."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Operators as they arrive in descriptors, tested in this order.
OPERATORS = ("!=", "%3E=", "%3C=", ">=", "<=", "=", "%3E", "%3C", ">", "<")
PLAIN = {"%3E=": ">=", "%3C=": "<=", "%3E": ">", "%3C": "<"}
# Border colours and their shares of the 256 entries.
GRADIENTS = {
    "Jet": ([(28, 64, 255), (50, 118, 253), (83, 237, 254), (148, 222, 44), (241, 192, 2), (231, 111, 43), (255, 0, 0)], [0.1, 0.2, 0.2, 0.2, 0.2, 0.1]),
    "Blues": ([(247, 251, 255), (222, 235, 247), (198, 219, 239), (158, 202, 225), (107, 174, 214), (66, 146, 198), (33, 113, 181), (8, 81, 456), (8, 48, 107)], [0.1, 0.1, 0.1, 0.2, 0.2, 0.1, 0.1, 0.1]),
    "Reds": ([(255, 245, 240), (254, 224, 210), (252, 187, 161), (252, 146, 114), (251, 106, 74), (239, 59, 44), (203, 24, 29), (165, 15, 21), (103, 0, 13)], [0.1, 0.1, 0.1, 0.2, 0.2, 0.1, 0.1, 0.1]),
    "YlorRd": ([(255, 255, 178), (254, 204, 92), (253, 141, 60), (240, 59, 32), (189, 0, 38)], [0.25, 0.25, 0.25, 0.25]),
    "Magma": ([(0, 0, 4), (30, 12, 69), (81, 14, 108), (128, 31, 108), (176, 49, 91), (217, 77, 61), (244, 121, 24), (252, 176, 20), (252, 255, 164)], [0.1, 0.1, 0.1, 0.2, 0.2, 0.1, 0.1, 0.1]),
}
GREY = ([(250, 250, 250), (5, 5, 5)], [1.0])


@dataclass(frozen=True)
class Paint:
    r: int
    g: int
    b: int
    alpha: float
    width: float = 0.0


@dataclass(frozen=True)
class Rule:
    op: str
    value: str

    def matches(self, item: Column) -> Column:
        """Equality compares strings; order compares leading numbers, and text without one never matches."""
        if self.op in ("=", "!="):
            return item == F.lit(self.value) if self.op == "=" else item != F.lit(self.value)
        number = re.match(r"\s*[+-]?\d*\.?\d+", self.value)
        if not number:
            raise ValueError(f"rule needs a number: {self.value}")
        found, bound = leading_number(item), F.lit(float(number[0]))
        return F.coalesce({">": found > bound, "<": found < bound, ">=": found >= bound, "<=": found <= bound}[self.op], F.lit(False))


@dataclass(frozen=True)
class Style:
    kind: str  # single, classified, ruled, heat
    field: str | None = None
    paints: tuple[Paint, ...] = ()
    items: tuple[str, ...] = ()
    rules: tuple[Rule, ...] = ()
    fill: Paint | None = None
    gradient: str = ""
    radius: int = 0
    view: tuple[int, int, int, int] = (0, 0, 0, 0)


def leading_number(item: Column) -> Column:
    return F.regexp_extract(item, "^ *([+-]?[0-9]*[.]?[0-9]+)", 1).try_cast("double")


def parse_style(text: str) -> Style:
    """E.g. single-255,0,0,1,2; classified-code-int-1001,255,0,0,1,2; ruled-code-int->=5,0,0,255,1,0; heat-Jet-5-0,1,0,1."""
    kind, *parts = [x for x in text.split("-") if x]
    numbers = lambda xs: Paint(*map(int, xs[:3]), float(xs[3]), float(xs[4]) if len(xs) > 4 else 0.0)
    split = lambda x: [v for v in x.split(",") if v]
    if kind == "single":
        v = split(parts[0])
        return Style(kind, paints=(numbers(v),), fill=Paint(*map(int, v[5:8]), float(v[8])) if len(v) >= 9 else None)
    if kind == "classified":
        rows = [split(p) for p in parts[2:]]
        return Style(kind, parts[0], tuple(numbers(r[1:]) for r in rows), items=tuple(r[0] for r in rows))
    if kind == "ruled":
        rows = [split(p) for p in parts[2:]]
        rules = []
        for r in rows:
            op = next((o for o in OPERATORS if r[0].startswith(o)), None)
            if op is None:
                raise ValueError(f"no operator in rule {r[0]}")
            rules.append(Rule(PLAIN.get(op, op), r[0][len(op) :]))
        return Style(kind, parts[0], tuple(numbers(r[1:]) for r in rows), rules=tuple(rules))
    if kind == "heat":
        return Style(kind, gradient=parts[0], radius=int(parts[1]), view=tuple(int(v) for v in split(parts[2])))
    raise ValueError(f"unknown style {kind}")


def parse_fields(text: str) -> dict[str, str]:
    """'a-s,b-i' -> {'a': 'classify', 'b': 'continuous'}; 'null' -> {}."""
    if text in ("", "null"):
        return {}
    kinds = {"s": "classify", "i": "continuous", "d": "continuous"}
    return {n: kinds[k] for n, _, k in (f.rpartition("-") for f in text.split(","))}


def check_input(path: str, geometry: str, srs: str) -> None:
    if geometry not in ("point", "linestring", "polygon"):
        raise ValueError(f"unknown geometry {geometry}")
    if not path.endswith((".shp", ".csv", ".parquet")) or (path.endswith(".csv") and geometry != "point"):
        raise ValueError(f"{path} cannot hold {geometry} features")
    if str(srs) not in ("4326", "3857"):
        raise ValueError("srs must be 4326 or 3857")


def gradient(name: str) -> list[tuple[int, int, int]]:
    """256 colours, piecewise linear; a byte keeps the low 8 bits."""
    stops, shares = GRADIENTS.get(name, GREY)
    out: list[tuple[int, int, int]] = []
    for k, (a, b) in enumerate(zip(stops, stops[1:], strict=False)):
        n = 256 - len(out) if k == len(stops) - 2 else int(shares[k] * 256)
        out += [tuple(int(p + (q - p) / (n - 1) * i) & 255 for p, q in zip(a, b, strict=True)) for i in range(n)]
    return out
