"""Accessors of series: str, dt, list, struct, geo, blob, plot."""

from __future__ import annotations


import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import datetimes, geo, strings
from .frame import DataFrame, Series, listed


class _Of:
    def __init__(self, data: Series):
        self._data = data

    def _new(self, expr, name="__same"):
        return self._data._new(expr, name)

    @property
    def _x(self):
        return self._data.expr


class StringMethods(_Of):
    def __getitem__(self, key):
        return self.slice(key.start, key.stop) if isinstance(key, slice) else self.get(key)

    def get(self, i):
        return self._new(F.get(self._x, i) if isinstance(self._data.dtype, T.ArrayType) else strings.get(self._x, i))

    def slice(self, start=None, stop=None):
        return self._new(strings.slice_(self._x, start, stop))

    def len(self):
        return self._new(F.size(self._x).cast("bigint") if isinstance(self._data.dtype, T.ArrayType) else strings.SIMPLE["len"](self._x))

    def find(self, sub, start=None, end=None):
        return self._new(strings.find(self._x, sub, start, end))

    def strip(self, to_strip=None):
        return self._new(strings.strip(self._x, to_strip))

    def lstrip(self, to_strip=None):
        return self._new(strings.lstrip(self._x, to_strip))

    def rstrip(self, to_strip=None):
        return self._new(strings.rstrip(self._x, to_strip))

    def repeat(self, repeats):
        return self._new(strings.repeat(self._x, repeats))

    def match(self, pat, case=True, flags=0):
        return self._new(strings.match(self._x, pat, case, flags))

    def fullmatch(self, pat, case=True, flags=0):
        return self._new(strings.fullmatch(self._x, pat, case, flags))

    def contains(self, pat, case=True, flags=0, *, regex=True):
        return self._new(strings.contains(self._x, pat, case, flags, regex))

    def extract(self, pat, flags=0):
        """A frame with a column for each group; named groups name theirs."""
        import re

        found = re.compile(pat)
        names = {k: n for n, k in found.groupindex.items()}
        java = re.sub(r"\(\?P<(\w+)>", r"(?<\1>", pat)
        return DataFrame(self._data.rows, [(names.get(k, k - 1), strings.extract(self._x, strings.flagged(java, True, flags), k)) for k in range(1, found.groups + 1)])

    def replace(self, pat, repl, case=True, flags=0, regex=False):
        return self._new(strings.replace(self._x, pat, repl, case, flags, regex))

    def startswith(self, pat):
        return self._new(strings.starts(self._x, pat))

    def endswith(self, pat):
        return self._new(strings.ends(self._x, pat))

    def split(self, pat=" ", regex=None):
        return self._new(strings.split(self._x, pat))

    def pad(self, width, side="left", fillchar=" "):
        return self._new(strings.pad(self._x, width, side, fillchar))

    def ljust(self, width, fillchar=" "):
        return self.pad(width, "right", fillchar)

    def rjust(self, width, fillchar=" "):
        return self.pad(width, "left", fillchar)

    def center(self, width, fillchar=" "):
        return self.pad(width, "both", fillchar)

    def zfill(self, width):
        return self._new(strings.zfill(self._x, width))

    def cat(self, others, join=None):
        me, o = self._data._with(others)
        return me._new(F.concat(me.expr, o.col))

    def join(self, sep):
        return self._new(F.array_join(self._x, sep))

    def to_blob(self, connection=None):
        return self._new(F.struct(self._x.alias("uri"), F.lit(None).cast("string").alias("version"), F.lit(connection).cast("string").alias("authorizer"), F.lit(None).cast("string").alias("details")))


for _n, _f in strings.SIMPLE.items():
    if _n != "len":
        setattr(StringMethods, _n, lambda self, f=_f: self._new(f(self._x)))


class DatetimeMethods(_Of):
    def __getattr__(self, part):
        if part.startswith("_"):
            raise AttributeError(part)
        if part in ("total_seconds", "day_name", "normalize"):
            return lambda: self._new(datetimes.PARTS[part](self._data.v))
        if part in datetimes.PARTS:
            return self._new(datetimes.PARTS[part](self._data.v))
        raise AttributeError(part)

    def strftime(self, date_format):
        return self._new(datetimes.strftime(self._data.v, date_format))

    def floor(self, freq):
        return self._new(datetimes.floor_dt(self._data.v, freq))

    def tz_localize(self, tz):
        return self._new(self._x.cast("timestamp" if tz else "timestamp_ntz"))

    @property
    def tz(self):
        return "UTC" if isinstance(self._data.dtype, T.TimestampType) else None

    @property
    def unit(self):
        return "us"

    def isocalendar(self):
        v = self._data.v
        return DataFrame(self._data.rows, [("year", datetimes.PARTS["iso_year"](v)), ("week", datetimes.PARTS["iso_week"](v)), ("day", datetimes.PARTS["iso_day"](v))])


class ListMethods(_Of):
    def len(self):
        return self._new(F.size(self._x).cast("bigint"))

    def __getitem__(self, key):
        from ..functions.nested import array_slice

        return self._new(array_slice(self._x, key.start or 0, key.stop) if isinstance(key, slice) else F.get(self._x, key))


class StructMethods(_Of):
    def field(self, name_or_index):
        name = self._data.dtype.fieldNames()[name_or_index] if isinstance(name_or_index, int) else name_or_index
        return self._new(self._x.getField(name), name)

    def explode(self):
        return DataFrame(self._data.rows, [(n, self._x.getField(n)) for n in self._data.dtype.fieldNames()])

    @property
    def dtypes(self):
        return pd.Series({f.name: f.dataType for f in self._data.dtype.fields})


class StructFrame:
    def __init__(self, frame: DataFrame):
        self._frame = frame

    def explode(self, column, *, separator="."):
        out = []
        for n, e in self._frame._columns:
            if n in listed(column):
                out += [(f"{n}{separator}{f}", e.getField(f)) for f in self._frame[n].dtype.fieldNames()]
            else:
                out.append((n, e))
        return self._frame._new(out)


class GeoMethods(_Of):
    """Points and shapes as WKT text."""

    x = property(lambda self: self._new(geo.st_x(self._x)))
    y = property(lambda self: self._new(geo.st_y(self._x)))
    length = property(lambda self: self._new(geo.st_length(self._x)))
    area = property(lambda self: self._new(geo.st_area(self._x)))
    boundary = property(lambda self: self._new(geo.st_boundary(self._x)))
    centroid = property(lambda self: self._new(geo.st_centroid(self._x)))
    convex_hull = property(lambda self: self._new(geo.st_convexhull(self._x)))
    is_closed = property(lambda self: self._new(geo.st_isclosed(self._x)))

    def to_wkt(self):
        return self._data

    def buffer(self, distance):
        return self._new(geo.st_buffer(self._x, distance))

    def simplify(self, tolerance, preserve_topology=True):
        return self._new(geo.st_simplify(self._x, tolerance))

    def _two(self, f, other):
        me, o = self._data._with(other)
        return me._new(f(me.expr, o.col))

    def distance(self, other):
        return self._two(geo.st_distance, other)

    def intersection(self, other):
        return self._two(geo.st_intersection, other)

    def difference(self, other):
        return self._two(geo.st_difference, other)


class BlobMethods(_Of):
    """References to files: struct of uri, version, authorizer, details; contents when read by ``from_glob_path``."""

    def uri(self):
        return self._new(self._x["uri"], "uri")

    def authorizer(self):
        return self._new(self._x["authorizer"], "authorizer")

    def version(self):
        return self._new(self._x["version"], "version")

    def metadata(self):
        return self._new(self._x["details"], "metadata")

    def size(self):
        return self._new(F.get_json_object(self._x["details"], "$.size").cast("bigint"), "size")

    def updated(self):
        return self._new(F.get_json_object(self._x["details"], "$.updated").cast("timestamp"), "updated")

    def content_type(self):
        known = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "pdf": "application/pdf", "txt": "text/plain", "csv": "text/csv", "json": "application/json", "html": "text/html", "wav": "audio/wav", "mp3": "audio/mpeg"}
        ext = F.lower(F.element_at(F.split(self._x["uri"], r"\."), -1))
        return self._new(F.coalesce(F.create_map(*(F.lit(v) for kv in known.items() for v in kv))[ext], F.lit("application/octet-stream")), "content_type")

    def content(self):
        """The bytes, read where the tasks run."""

        @F.pandas_udf("binary")
        def read(uris: pd.Series) -> pd.Series:
            def one(u):
                if u is None:
                    return None
                with open(u.removeprefix("file:").replace("///", "/"), "rb") as f:
                    return f.read()

            return uris.map(one)

        return self._new(read(self._x["uri"]), "content")

    def md5_hash(self):
        return self._new(F.md5(self.content().expr), "md5_hash")

    def read_url(self):
        return self.uri()

    write_url = read_url

    def get_runtime_json_str(self, mode="R", with_metadata=False):
        return self._new(F.to_json(self._x))

    def pdf_chunk(self, chunk_size=2000, overlap_size=200, **_):
        """Overlapping pieces of the text of each file (text files; PDFs need a parser from the caller)."""
        text = F.decode(self.content().expr, "UTF-8")
        starts = F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1)), F.lit(chunk_size - overlap_size))
        return self._new(F.transform(starts, lambda s: F.substring(text, s, F.lit(chunk_size))), "chunks")

    def transformed(self, func, kind="binary"):
        """A function over the bytes (image, audio or PDF libraries are the caller's)."""

        @F.pandas_udf(kind)
        def run(blobs: pd.Series) -> pd.Series:
            return blobs.map(lambda b: None if b is None else func(b))

        return self._new(run(self.content().expr))


class Plot:
    """Plots of a bounded sample of the rows, by matplotlib if it is there."""

    SAMPLE = 1000

    def __init__(self, data):
        self._data = data

    def _sample(self):
        return self._data.to_frame().peek(self.SAMPLE) if isinstance(self._data, Series) else self._data.peek(self.SAMPLE)

    def __call__(self, kind="line", **kwargs):
        return self._sample().plot(kind=kind, **kwargs)

    def __getattr__(self, kind):
        if kind.startswith("_"):
            raise AttributeError(kind)
        return lambda *a, **k: getattr(self._sample().plot, kind)(*a, **k)




