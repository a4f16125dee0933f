"""Geography as WKT text: points by SQL, other shapes by vectorised geometry.

Lengths, areas and distances are on a sphere of the mean earth radius, in metres.
"""

from __future__ import annotations

import math
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

RADIUS = 6_371_010.0
POINT = r"POINT\s*\(\s*(-?[0-9.eE+-]+)\s+(-?[0-9.eE+-]+)\s*\)"
NUMBER = re.compile(r"-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?")


def st_geogpoint(x, y) -> Column:
    text = lambda c: F.regexp_replace(c.cast("string"), r"\.0$", "")
    return F.concat(F.lit("POINT("), text(x), F.lit(" "), text(y), F.lit(")"))


def st_x(g) -> Column:
    return F.when(g.rlike(POINT), F.regexp_extract(g, POINT, 1).try_cast("double"))


def st_y(g) -> Column:
    return F.when(g.rlike(POINT), F.regexp_extract(g, POINT, 2).try_cast("double"))


def haversine(x1, y1, x2, y2) -> Column:
    a, b = F.radians(y1), F.radians(y2)
    h = F.pow(F.sin((b - a) / 2), F.lit(2)) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(x2 - x1) / 2), F.lit(2))
    return F.lit(2 * RADIUS) * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def st_distance(a, b) -> Column:
    return haversine(st_x(a), st_y(a), st_x(b), st_y(b))


# --- shapes ----------------------------------------------------------------


def parse(wkt: str | None) -> tuple[str, list[list[tuple[float, float]]]]:
    """Kind and rings (or lines, or points) of a geometry."""
    if not wkt or "EMPTY" in wkt:
        return "EMPTY", []
    kind = wkt.partition("(")[0].strip().upper()
    rings = []
    for ring in re.findall(r"\(([^()]*)\)", wkt):
        n = [float(x) for x in NUMBER.findall(ring)]
        rings.append(list(zip(n[::2], n[1::2])))
    return kind, rings


def _text(points) -> str:
    return ", ".join(f"{x:.12g} {y:.12g}" for x, y in points)


def _metres(p, q) -> float:
    a, b = math.radians(p[1]), math.radians(q[1])
    h = math.sin((b - a) / 2) ** 2 + math.cos(a) * math.cos(b) * math.sin(math.radians(q[0] - p[0]) / 2) ** 2
    return 2 * RADIUS * math.asin(min(1.0, math.sqrt(h)))


def length(wkt) -> float | None:
    if wkt is None:
        return None
    kind, rings = parse(wkt)
    return sum(_metres(p, q) for r in rings for p, q in zip(r, r[1:])) if "LINE" in kind or "POLYGON" in kind else 0.0


def area(wkt) -> float | None:
    """Spherical excess of the outer ring less that of the holes."""
    if wkt is None:
        return None
    kind, rings = parse(wkt)
    if "POLYGON" not in kind:
        return 0.0
    if kind == "MULTIPOLYGON":  # each polygon with its own holes
        return sum(area("POLYGON" + part) for part in re.findall(r"\(\([^()]*\)(?:\s*,\s*\([^()]*\))*\)", wkt))

    def ring_area(r):
        total = sum(math.radians(q[0] - p[0]) * (2 + math.sin(math.radians(p[1])) + math.sin(math.radians(q[1]))) for p, q in zip(r, r[1:]))
        return abs(total * RADIUS * RADIUS / 2)

    return ring_area(rings[0]) - sum(map(ring_area, rings[1:]))


def centroid(wkt) -> str | None:
    kind, rings = parse(wkt)
    points = [p for r in rings for p in r]
    if not points:
        return None
    if "POLYGON" in kind:
        r, a, cx, cy = rings[0], 0.0, 0.0, 0.0
        for p, q in zip(r, r[1:]):
            cross = p[0] * q[1] - q[0] * p[1]
            a, cx, cy = a + cross, cx + (p[0] + q[0]) * cross, cy + (p[1] + q[1]) * cross
        if a:
            return f"POINT({cx / (3 * a):.12g} {cy / (3 * a):.12g})"
    if "LINE" in kind:
        total = sum(math.dist(p, q) for p, q in zip(points, points[1:])) or 1.0
        x = sum((p[0] + q[0]) / 2 * math.dist(p, q) for p, q in zip(points, points[1:])) / total
        y = sum((p[1] + q[1]) / 2 * math.dist(p, q) for p, q in zip(points, points[1:])) / total
        return f"POINT({x:.12g} {y:.12g})"
    return f"POINT({sum(p[0] for p in points) / len(points):.12g} {sum(p[1] for p in points) / len(points):.12g})"


def hull(points) -> list[tuple[float, float]]:
    points = sorted(set(points))
    if len(points) < 3:
        return points

    def half(ps):
        out = []
        for p in ps:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out[:-1]

    return half(points) + half(points[::-1])


def convexhull(wkt) -> str | None:
    _, rings = parse(wkt)
    found = hull([p for r in rings for p in r])
    if not found:
        return None
    if len(found) == 1:
        return f"POINT({_text(found)})"
    if len(found) == 2:
        return f"LINESTRING({_text(found)})"
    return f"POLYGON(({_text([*found, found[0]])}))"


def isclosed(wkt) -> bool | None:
    if wkt is None:
        return None
    kind, rings = parse(wkt)
    if kind == "EMPTY":
        return False
    return "LINE" not in kind or all(r[0] == r[-1] for r in rings)


def boundary(wkt) -> str | None:
    if wkt is None:
        return None
    kind, rings = parse(wkt)
    if "POLYGON" in kind:
        return f"LINESTRING({_text(rings[0])})" if len(rings) == 1 else "MULTILINESTRING(" + ", ".join(f"({_text(r)})" for r in rings) + ")"
    if "LINE" in kind and not isclosed(wkt):
        return f"MULTIPOINT({_text([rings[0][0], rings[-1][-1]])})"
    return "GEOMETRYCOLLECTION EMPTY"


def buffer(radius: float, segments: float = 8.0):
    """A polygon around the convex hull of a shape's points, ``segments`` to a quarter circle."""

    def run(wkt) -> str | None:
        _, rings = parse(wkt)
        points, steps = [], max(4, int(4 * segments))
        for x, y in (p for r in rings for p in r):
            for k in range(steps):
                t = 2 * math.pi * k / steps
                dy = math.degrees(radius * math.sin(t) / RADIUS)
                dx = math.degrees(radius * math.cos(t) / (RADIUS * max(1e-9, math.cos(math.radians(y)))))
                points.append((x + dx, y + dy))
        found = hull(points)
        return f"POLYGON(({_text([*found, found[0]])}))" if len(found) > 2 else None

    return run


def simplify(tolerance: float):
    """Lines and rings without points closer than ``tolerance`` metres to the line kept (Douglas-Peucker)."""

    def off(p, a, b) -> float:
        k = math.cos(math.radians(p[1]))
        ax, ay, bx, by = (a[0] - p[0]) * k, a[1] - p[1], (b[0] - p[0]) * k, b[1] - p[1]
        dx, dy = bx - ax, by - ay
        t = 0.0 if dx == dy == 0 else max(0.0, min(1.0, -(ax * dx + ay * dy) / (dx * dx + dy * dy)))
        return math.radians(math.hypot(ax + t * dx, ay + t * dy)) * RADIUS

    def thin(r):
        keep, todo = {0, len(r) - 1}, [(0, len(r) - 1)]
        while todo:
            i, j = todo.pop()
            far = max(((off(r[k], r[i], r[j]), k) for k in range(i + 1, j)), default=(0.0, 0))
            if far[0] > tolerance:
                keep.add(far[1])
                todo += [(i, far[1]), (far[1], j)]
        return [r[k] for k in sorted(keep)]

    def run(wkt) -> str | None:
        kind, rings = parse(wkt)
        if "POLYGON" in kind:
            return f"{kind}(" + ", ".join(f"({_text(thin(r))})" for r in rings) + ")"
        return f"{kind}({_text(thin(rings[0]))})" if "LINE" in kind else wkt

    return run


def _clip(subject, a, b, inside: bool):
    """Part of a ring on one side of the line a-b."""
    side = lambda p: (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])
    out = []
    for p, q in zip(subject, [*subject[1:], subject[0]]):
        sp, sq = side(p), side(q)
        if not inside:
            sp, sq = -sp, -sq
        if sp >= 0:
            out.append(p)
        if sp * sq < 0:
            t = sp / (sp - sq)
            out.append((p[0] + t * (q[0] - p[0]), p[1] + t * (q[1] - p[1])))
    return out


def _ccw(r):
    r = r[:-1] if len(r) > 1 and r[0] == r[-1] else r
    return r if sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(r, [*r[1:], r[0]])) >= 0 else r[::-1]


def intersection(a, b) -> str | None:
    """Points and convex polygons."""
    if a is None or b is None:
        return None
    (ka, ra), (kb, rb) = parse(a), parse(b)
    if "POLYGON" in ka and "POLYGON" in kb:
        out, cut = _ccw(ra[0]), _ccw(rb[0])
        for p, q in zip(cut, [*cut[1:], cut[0]]):
            out = _clip(out, p, q, True) if out else out
        return f"POLYGON(({_text([*out, out[0]])}))" if len(out) > 2 else "GEOMETRYCOLLECTION EMPTY"
    if ka == kb == "POINT":
        return a if ra == rb else "GEOMETRYCOLLECTION EMPTY"
    if "POINT" in (ka, kb):
        p, ring = (ra[0][0], _ccw(rb[0])) if ka == "POINT" else (rb[0][0], _ccw(ra[0]))
        inside = all((q[0] - o[0]) * (p[1] - o[1]) >= (q[1] - o[1]) * (p[0] - o[0]) for o, q in zip(ring, [*ring[1:], ring[0]]))
        return f"POINT({_text([p])})" if inside else "GEOMETRYCOLLECTION EMPTY"
    raise NotImplementedError(f"intersection of {ka} and {kb}")


def difference(a, b) -> str | None:
    """What of ``a`` lies outside the convex polygon (or point) ``b``."""
    if a is None or b is None:
        return None
    (ka, ra), (kb, rb) = parse(a), parse(b)
    if ka == "POINT":
        return a if intersection(a, b).endswith("EMPTY") else "GEOMETRYCOLLECTION EMPTY"
    if "POLYGON" in ka and "POLYGON" in kb:
        rest, cut, parts = _ccw(ra[0]), _ccw(rb[0]), []
        for p, q in zip(cut, [*cut[1:], cut[0]]):
            if not rest:
                break
            if len(piece := _clip(rest, p, q, False)) > 2 and area(f"POLYGON(({_text([*piece, piece[0]])}))") > 1e-6:
                parts.append(f"(({_text([*piece, piece[0]])}))")
            rest = _clip(rest, p, q, True)
        return "GEOMETRYCOLLECTION EMPTY" if not parts else f"POLYGON{parts[0]}" if len(parts) == 1 else f"MULTIPOLYGON({', '.join(parts)})"
    return a


def mapped(f, kind: str):
    """A function of one or two texts as an Arrow-batched column function."""

    def call(*cols) -> Column:
        if len(cols) == 1:

            @F.pandas_udf(kind)
            def one(a: pd.Series) -> pd.Series:
                return a.map(lambda x: None if x is None else f(x))

            return one(*cols)

        @F.pandas_udf(kind)
        def two(a: pd.Series, b: pd.Series) -> pd.Series:
            return pd.Series([f(x, y) for x, y in zip(a, b)])

        return two(*cols)

    return call


st_area, st_length = mapped(area, "double"), mapped(length, "double")
st_centroid, st_convexhull, st_boundary = mapped(centroid, "string"), mapped(convexhull, "string"), mapped(boundary, "string")
st_isclosed = mapped(isclosed, "boolean")
st_intersection, st_difference = mapped(intersection, "string"), mapped(difference, "string")


def st_buffer(g, radius: float, segments: float = 8.0) -> Column:
    return mapped(buffer(radius, segments), "string")(g)


def st_simplify(g, tolerance: float) -> Column:
    return mapped(simplify(tolerance), "string")(g)


def st_astext(g) -> Column:
    return g


def st_geogfromtext(text) -> Column:
    return F.trim(text)
