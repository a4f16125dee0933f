"""Series of shapes as WKT text."""

from __future__ import annotations

import pandas as pd

from ..functions import geo
from .frame import Series


class GeoSeries(Series):
    """A series whose geometry verbs need no accessor."""

    @classmethod
    def of(cls, series: Series) -> GeoSeries:
        return cls(series.rows, series.expr, series.name)

    @classmethod
    def from_wkt(cls, data, index=None, session=None) -> GeoSeries:
        return cls.of(data if isinstance(data, Series) else _local(pd.Series(list(data), index=index, name="geometry"), session))

    @classmethod
    def from_xy(cls, x, y, index=None, session=None) -> GeoSeries:
        if not isinstance(x, Series):
            frame = _local(pd.DataFrame({"x": list(x), "y": list(y)}, index=index), session)
            x, y = frame["x"], frame["y"]
        return cls(x.rows, geo.st_geogpoint(x.expr, y.expr), "geometry")

    def to_wkt(self) -> Series:
        return Series(self.rows, self.expr, self.name)

    def __getattr__(self, name):
        if name in ("x", "y", "length", "area", "boundary", "centroid", "convex_hull", "is_closed", "buffer", "simplify", "distance", "intersection", "difference"):
            return getattr(self.geo, name)
        raise AttributeError(name)


def _local(data, session):
    from ..sources.session import Session

    return (session or Session.active()).read_pandas(data)
