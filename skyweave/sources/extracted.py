"""Products of binary formats (HDF4, HDF5, NetCDF, PP), from their extracted datasets.

The libraries of these formats are not here. What one of them dumps is read in place of the file: a folder under the file's own name,
with two Parquet tables,

* values: one row a point or cell, one column a dataset, as stored; a dataset with further dimensions is an array
* attributes: (variable, key, value) as text; the file's own attributes have the variable ''

A product says which datasets are coordinates and how stored values and times are decoded. Each file is decoded by its own attributes:
all files' attributes are read at once, files whose attributes matter alike are one scan, and what a file says of itself as a whole, as
the time of a daily grid, is joined to its rows. So the jobs of a read grow with the kinds of files, not with their number.
"""

from __future__ import annotations

import calendar
import datetime as dt
import re
from collections.abc import Callable
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import FileFormatError, InvalidVariableError
from ..functions import decode
from ..functions.time import UNIT_DAYS, cf_time, julian_days, parse_datetime, seconds_since, to_days
from .products import Product, register

Attributes = dict[str, dict[str, str]]

#: Caliop's fills by the stored type, where a dataset has none of its own.
CALIOP_FILLS = {"Float_32": -9999.0, "Int_16": -9999.0, "Int_32": -9999.0, "UInt_8": -127.0}
#: The suffixes that choose an index of an EarthCARE dataset's further dimension.
EARTHCARE_SUFFIXES = ("_CLASSNUM_", "_AEROSOL_COMPONENTSNUM_", "_BANDNUM_", "_BACKGROUNDNUM_")
GRAVITY = 9.80665
#: Attributes that decoding may use. Others, as titles and histories, tell no two kinds of files apart.
USED = ("_fillvalue", "fillvalue", "missing_value", "missing", "missop", "valid_min", "valid_max", "valid_range", "scale_factor", "add_offset", "factor", "offset", "format", "units", "long_name", "standard_name", "bounds", "length", "dimension", "dimensions")
TAI_START = dt.datetime(1993, 1, 1)


def _number(a: dict[str, str], *keys: str) -> float | None:
    return next((float(a[k]) for k in keys if k in a), None)


def _pair(a: dict[str, str], key: str) -> tuple[float | None, float | None]:
    """A range written `a...b`, `a, b` or `a b`; none if it is not two numbers."""
    parts = [x for x in re.split(r"\.\.\.|[,\s]+", a.get(key, "").strip("[]() ")) if x]
    return (float(parts[0]), float(parts[1])) if len(parts) == 2 else (None, None)


def decode_cf(v: Column, a: dict[str, str]) -> Column:
    """Fill, valid_min, valid_max or valid_range of the stored values, then value * scale_factor + add_offset."""
    lo, hi = _pair(a, "valid_range")
    fills = [float(a[k]) for k in ("_FillValue", "missing_value") if k in a]
    v = decode.valid_range(decode.fill(v, *fills), _number(a, "valid_min") if lo is None else lo, _number(a, "valid_max") if hi is None else hi)
    return decode.scale_cf(v, _number(a, "scale_factor") or 1.0, _number(a, "add_offset") or 0.0)


def decode_modis(v: Column, a: dict[str, str]) -> Column:
    fills = [float(a["_FillValue"])] if "_FillValue" in a else []
    return decode.scale_modis(decode.valid_range(decode.fill(v, *fills), *_pair(a, "valid_range")), _number(a, "scale_factor") or 1.0, _number(a, "add_offset") or 0.0)


def decode_caliop(v: Column, a: dict[str, str]) -> Column:
    fill = _number(a, "fillvalue")
    fill = CALIOP_FILLS.get(a.get("format", ""), _number(a, "_FillValue")) if fill is None else fill
    return decode.scale_caliop(decode.valid_range(decode.fill(v, *([] if fill is None else [fill])), *_pair(a, "valid_range")), _number(a, "scale_factor") or 1.0, _number(a, "add_offset") or 0.0)


def decode_cloudsat(v: Column, a: dict[str, str]) -> Column:
    if "missing" in a:
        v = decode.missing_where(v, a.get("missop", "=="), float(a["missing"]))
    return decode.scale_cloudsat(decode.valid_range(v, *_pair(a, "valid_range")), _number(a, "factor") or 1.0, _number(a, "offset") or 0.0)


class Extracted(Product):
    """coords: {coordinate: datasets, the first of which that is there holds it}. Datasets that are arrays become a variable an index."""

    coords: dict[str, tuple[str, ...]] = {"longitude": ("longitude", "lon", "Longitude"), "latitude": ("latitude", "lat", "Latitude"), "altitude": ("altitude", "alt"), "air_pressure": ("air_pressure", "Pressure"), "time": ("time",)}
    decoded: Callable[[Column, dict[str, str]], Column] = staticmethod(decode_cf)
    #: Which index of a coordinate's array holds it.
    coordinate_index = 0
    #: Whether rows are cells of a grid.
    gridded = False

    def attributes(self, spark, path: str) -> Attributes:
        return next(iter(self.all_attributes(spark, [path]).values()), {})

    def all_attributes(self, spark, paths: list[str]) -> dict[str, Attributes]:
        """By folder, in one job: the attributes that decoding uses, and files' own."""
        table = spark.read.schema("variable string, key string, value string").parquet(*[f"{p}/attributes" for p in paths])
        table = table.select("*", F.regexp_replace("_metadata.file_path", "/attributes/[^/]*$", "").alias("folder"))
        out: dict[str, Attributes] = {}
        for r in table.where(F.lower("key").isin(*USED) | (F.coalesce("variable", F.lit("")) == "")).collect():  # files' metadata
            out.setdefault(r.folder, {}).setdefault(r.variable or "", {})[r.key] = r.value
        return out

    def time(self, v: Column, a: Attributes, name: str) -> Column:
        return cf_time(v, a.get(name, {})["units"]) if "since" in a.get(name, {}).get("units", "") else v

    def more(self, df: DataFrame, a: Attributes) -> dict[str, Column]:
        """Coordinates that are made, not read. Of a file's own attributes it sees none: see whole()."""
        return {}

    def whole(self, own: dict[str, str]) -> dict[str, float]:
        """Coordinates that hold for a whole file, from its own attributes."""
        return {}

    def named(self, own: dict[str, str], names: list[str]) -> dict[str, tuple[str, ...]]:
        """Datasets that hold coordinates, of those that there are, by the file's own attributes."""
        return self.coords

    def decisive(self, own: dict[str, str]) -> tuple:
        """What of a file's own attributes named() looks at; files that differ in it are scans of their own."""
        return ()

    def chosen(self, names: list[str], a: Attributes) -> list[str]:
        """Datasets that are variables."""
        return names

    def scan(self, spark, paths):
        every = self.all_attributes(spark, paths)
        # Folders without attributes are not among those: their files have none.
        plain = lambda p: re.sub(r"^\w+:/*", "/", p).rstrip("/")
        seen = {plain(unquote(f)) for f in every}
        bare = [p for p in paths if "*" not in p and plain(p) not in seen and not any(f.endswith("/" + p.rstrip("/")) for f in seen)]
        kinds: dict[tuple, list[str]] = {}
        for folder, a in every.items():
            rest = tuple(sorted((v, k, x) for v, own in a.items() if v for k, x in own.items()))
            kinds.setdefault((rest, tuple(sorted(self.whole(a.get("", {})))), self.decisive(a.get("", {}))), []).append(folder)
        out = None
        for (rest, names, decisive), folders in kinds.items():
            a: Attributes = {}
            for v, k, x in rest:
                a.setdefault(v, {})[k] = x
            df = spark.read.option("mergeSchema", len(folders) > 1).parquet(*[f"{unquote(f)}/values" for f in folders])
            if names:
                # A row a file, beside many of its values.
                rows = [(f, *[self.whole(every[f].get("", {}))[n] for n in names]) for f in folders]
                file = spark.createDataFrame(rows, "_folder string, " + ", ".join(f"`_w_{n}` double" for n in names))
                df = df.withColumn("_folder", F.regexp_replace("_metadata.file_path", "/values/[^/]*$", "")).join(F.broadcast(file), "_folder").drop("_folder")
            one = self.cells(df, a, {n: F.col(f"_w_{n}") for n in names}, dict(decisive))
            out = one if out is None else out.unionByName(one, allowMissingColumns=True)
        for p in bare:
            one = self.cells(spark.read.parquet(f"{p}/values"), {}, {}, {})
            out = one if out is None else out.unionByName(one, allowMissingColumns=True)
        return out

    def cells(self, df: DataFrame, a: Attributes, whole: dict[str, Column], own: dict[str, str]) -> DataFrame:
        """Decoded rows of files that share the attributes `a`; whole: what holds for a file, as columns of df named _w_<coordinate>; own:
        files' own attributes that are decisive."""
        types, found, used = dict(df.dtypes), {}, set()
        for c, names in self.named(own, df.columns).items():
            name = next((n for n in names if n in types), None)
            if name is not None:
                x = F.col(f"`{name}`")
                x = self.decoded((F.try_element_at(x, F.lit(self.coordinate_index + 1)) if types[name].startswith("array") else x).cast("double"), a.get(name, {}))
                found[c] = self.time(x, a, name) if c == "time" else x
                used.add(name)
                # Bounds are an array of two for each value of the coordinate, under the name that it gives.
                if self.gridded and (b := a.get(name, {}).get("bounds")) in types:
                    for i, end in enumerate(("lo", "hi")):
                        x = self.decoded(F.try_element_at(F.col(f"`{b}`"), F.lit(i + 1)).cast("double"), a.get(name, {}))
                        found[f"{c}_{end}"] = self.time(x, a, name) if c == "time" else x
                    used.add(b)
        found |= self.more(df, a) | {c: x for c, x in whole.items() if not c.startswith("_")}
        used |= {f"_w_{c}" for c in whole}
        if "latitude" not in found or "longitude" not in found:
            raise FileFormatError(f"no latitude and longitude among the datasets {df.columns}")
        if "_origin" in whole and (units := next((a.get(n, {}).get("units", "") for n in df.columns if n in used and n in self.named(own, df.columns).get("time", ())), "")) and "since" not in units:
            found["time"] = F.col("_w__origin") + found["time"] * F.lit(UNIT_DAYS[units.split()[0].lower().rstrip("s")])
        variables = []
        for n in self.chosen([n for n in df.columns if n not in used], a):
            variables += self.variable(n, F.col(f"`{n}`"), types[n], a.get(n, {}), df)
        return df.select(*[x.alias(c) for c, x in found.items()], *variables)

    def variable(self, name: str, v: Column, kind: str, a: dict[str, str], df: DataFrame) -> list[Column]:
        meta = {k: a[k] for k in ("units", "long_name", "standard_name") if k in a}
        if not kind.startswith("array"):
            return [self.decoded(v.cast("double"), a).alias(name, metadata=meta)]
        size = int(a.get("length", 0)) or (df.select(F.max(F.size(v))).first()[0] or 0)
        return [self.decoded(F.try_element_at(v, F.lit(i + 1)).cast("double"), a).alias(f"{name}_{i}", metadata=meta) for i in range(size)]


@register
class CloudSat(Extracted):
    """Time is TAI_start, seconds since 1993, and Profile_time after it."""

    name, signatures = "CloudSat", (r".*_CS_.*GRANULE.*\.hdf",)
    coords = {"longitude": ("Longitude",), "latitude": ("Latitude",), "altitude": ("Height",)}
    decoded = staticmethod(decode_cloudsat)

    def more(self, df, a):
        return {"time": seconds_since(F.col("TAI_start").cast("double") + F.col("Profile_time").cast("double"), TAI_START)}

    def chosen(self, names, a):
        return [n for n in names if n not in ("TAI_start", "Profile_time")]


@register
class ModisL2(Extracted):
    """Swaths of 5 km. A dataset of 1 km, whose `dimensions` say so, is an array of the 25 values in a point of 5 km, line by line; `_line`
    and `_pixel` then place the points of 5 km in the swath. It has a row for each value, with places between those of 5 km; outside the
    outermost of these there is no place, and no row."""

    name, signatures = "MODIS_L2", (r".*M[YO]D0[64]_L2.*\.hdf",)
    coords = {"longitude": ("Longitude",), "latitude": ("Latitude",), "time": ("Scan_Start_Time",)}
    decoded = staticmethod(decode_modis)
    times = 5

    def time(self, v, a, name):
        return seconds_since(v, TAI_START)

    def fine(self, a: Attributes, names: list[str]) -> list[str]:
        return [n for n in names if "1km" in a.get(n, {}).get("dimensions", "")]

    def chosen(self, names, a):
        return [n for n in names if n not in ("_line", "_pixel", "_file")]

    def cells(self, df, a, whole, own):
        if not self.fine(a, df.columns):
            return super().cells(df, a, whole, own)
        if not {"_line", "_pixel"} <= set(df.columns):
            raise FileFormatError("datasets of 1 km need _line and _pixel, which place their points")
        # A file's folder, as it may be several parts.
        return super().cells(df.withColumn("_file", F.regexp_replace("_metadata.file_path", "/values/[^/]*$", "")), a, whole, own)

    def variable(self, name, v, kind, a, df):
        if "1km" not in a.get("dimensions", ""):
            return super().variable(name, v, kind, a, df)
        place = [F.col(c).alias(c) for c in ("_file", "_line", "_pixel")]
        meta = {k: a[k] for k in ("units", "long_name", "standard_name") if k in a}
        values = F.transform(v, lambda x: self.decoded(x.cast("double"), a))
        return [F.struct(*place, values.alias("values")).alias(name, metadata=meta | {"fine": "1km"})]

    def spread(self, df):
        fine = [f.name for f in df.schema.fields if (f.metadata or {}).get("fine") == "1km"]
        if not fine:
            return df
        meta = {n: {k: v for k, v in df.schema[n].metadata.items() if k != "fine"} for n in fine}
        out = df.withColumns({c: F.col(fine[0])[c] for c in ("_file", "_line", "_pixel")})
        out = decode.densify_swath(out, "_line", "_pixel", ["latitude", "longitude"], self.times, ["_file"])
        k = F.col("sub_row") * self.times + F.col("sub_column")
        out = out.withColumns({n: F.get(F.col(n)["values"], k) for n in fine}).drop("_file", "_line", "_pixel", "sub_row", "sub_column")
        for n, m in meta.items():
            out = out.withMetadata(n, m)
        return out


@register
class ModisL3(Extracted):
    """A daily, 8-daily or monthly grid; its time is the middle of the range in the file's metadata."""

    gridded = True
    name, signatures = "MODIS_L3", (r".*(MYD08_D3|MOD08_D3|MYD08_M3|MOD08_M3|MOD08_E3).*\.hdf",)
    coords = {"longitude": ("XDim",), "latitude": ("YDim",)}
    decoded = staticmethod(decode_modis)

    def whole(self, own):
        ends = [to_days(parse_datetime(f"{own[f'RANGE{k}DATE']} {own[f'RANGE{k}TIME']}".split(".")[0]).min()) for k in ("BEGINNING", "ENDING")]
        return {"time": ends[0] + (ends[1] - ends[0]) / 2}


class Caliop(Extracted):
    """Lidar profiles; times are seconds since 1993."""

    coords = {"longitude": ("Longitude",), "latitude": ("Latitude",), "altitude": ("Lidar_Data_Altitudes",), "air_pressure": ("Pressure",), "time": ("Profile_Time",)}
    decoded = staticmethod(decode_caliop)
    #: Datasets of mixed resolution, whose first slice counts.
    mixed = ("Atmospheric_Volume_Description", "CAD_Score", "Extinction_QC_Flag_1064", "Extinction_QC_Flag_532")

    def time(self, v, a, name):
        return seconds_since(v, TAI_START)

    def variable(self, name, v, kind, a, df):
        if name in self.mixed and kind.startswith("array"):
            return [self.decoded(F.try_element_at(v, F.lit(1)).cast("double"), a).alias(name)]
        return super().variable(name, v, kind, a, df)


@register
class CaliopL1(Caliop):
    name, signatures = "Caliop_L1", (r"CAL_LID_L1.*hdf",)


@register
class CaliopL2(Caliop):
    """Of the three shots of a coordinate the middle one counts."""

    name, signatures, coordinate_index = "Caliop_L2", (r"CAL_LID_L2_05kmAPro.*hdf",), 1


@register
class CaliopL2NoPressure(CaliopL2):
    name, priority = "Caliop_L2_NO_PRESSURE", 0
    coords = {k: v for k, v in Caliop.coords.items() if k != "air_pressure"}


@register
class CloudCciL2(Extracted):
    name, signatures = "Cloud_CCI_L2", (r".*ESACCI-L2_CLOUD.*",)

    def time(self, v, a, name):
        return julian_days(v)


@register
class AerosolCciL2(Extracted):
    name, signatures = "Aerosol_CCI_L2", (r".*ESACCI-L2P_AEROSOL.*",)

    def time(self, v, a, name):
        return seconds_since(v, dt.datetime(1970, 1, 1))


def coverage_time(text: str) -> float:
    """YYYYMMDDThhmmssZ as days; day 44 stands for the last of its month."""
    m = re.fullmatch(r"(\d{4})(\d\d)(\d\d)T(\d\d)(\d\d)(\d\d)Z", text)
    if not m:
        raise FileFormatError(f"not a time of coverage: {text!r}")
    y, mo, d, *clock = map(int, m.groups())
    return to_days(dt.datetime(y, mo, calendar.monthrange(y, mo)[1] if d == 44 else d, *clock))


class CciL3(Extracted):
    """A grid whose time is the middle of its coverage."""

    gridded = True

    def whole(self, own):
        first, last = (coverage_time(own[f"time_coverage_{k}"]) for k in ("start", "end"))
        return {"time": (first + last) / 2, "time_lo": first, "time_hi": last}


@register
class CloudCciL3(CciL3):
    name, signatures = "Cloud_CCI_L3", (r".*ESACCI-L3[CU]_CLOUD.*nc",)


@register
class AerosolCciL3(CciL3):
    name, signatures = "Aerosol_CCI_L3", (r".*ESACCI-L3C_AEROSOL.*nc",)


@register
class NcarRaf(Extracted):
    """Flights, ships and fixed stations. A file's own attributes name its coordinates:

    * Time_Coordinate with Latitude_Coordinate, Longitude_Coordinate and, if heights vary, Vertical_Coordinate (else altitude is 0)
    * Time_Coordinate with Station_Lat, Station_Lon and, perhaps, Station_Altitude (else 0), which hold for the whole file
    * Coordinates, the names of longitude, latitude, altitude and time

    Files without any of these have datasets of usual names. Air pressure is PSXC or else PRE. Times whose units have no "since" count
    from Time_Stamp_Info. A variable may have one dimension beside time (its `dimensions`, the last of which is that): it is an array, and
    has a row for each of its values, with the dataset of that dimension as a further column.
    """

    name, signatures, priority = "NCAR_NetCDF_RAF", (r".*\.nc",), 20
    coords = {"longitude": ("LONC", "LON", "longitude", "Longitude", "lon"), "latitude": ("LATC", "LAT", "latitude", "Latitude", "lat"), "altitude": ("GGALT", "ALT", "altitude", "Altitude"), "air_pressure": ("PSXC", "PSX", "PRE", "pressure", "air_pressure"), "time": ("Time", "time")}
    #: Attributes that name one coordinate, and the order of those in Coordinates.
    naming = {"time": "time_coordinate", "latitude": "latitude_coordinate", "longitude": "longitude_coordinate", "altitude": "vertical_coordinate"}
    best = ("longitude", "latitude", "altitude", "time")
    pressures = ("PSXC", "PRE")

    def errors(self, spark, path):
        try:
            own = {k.lower(): v for k, v in self.attributes(spark, path).get("", {}).items()}
        except Exception as x:  # not an extracted file
            return [f"{path}: {type(x).__name__}"]
        return [] if "gassp_version" in own or "RAF" in own.get("conventions", "") else [f"{path}: neither GASSP_Version nor a RAF convention"]

    def decisive(self, own):
        low = {k.lower(): v for k, v in own.items()}
        # That there is a station's place decides, not where it is.
        return tuple((k, low[k] if k != "station_lat" else "") for k in sorted((*self.naming.values(), "coordinates", "station_lat")) if k in low)

    def named(self, own, names):
        if "time_coordinate" in own:
            fixed = "latitude_coordinate" not in own
            if fixed and "station_lat" not in own:
                raise InvalidVariableError("no attribute says the latitude: neither Latitude_Coordinate nor Station_Lat")
            asked = {c: own.get(k) for c, k in self.naming.items() if not fixed or c == "time"}
            if not fixed and asked["longitude"] is None:
                raise InvalidVariableError("no attribute Longitude_Coordinate beside that of latitude")
        elif "coordinates" in own:
            if len(found := own["coordinates"].split()) != len(self.best):
                raise InvalidVariableError(f"Coordinates should name {' '.join(self.best)}, not {own['coordinates']!r}")
            asked = dict(zip(self.best, found))
        else:
            return self.coords
        if lacking := [n for n in asked.values() if n is not None and n not in names]:
            raise InvalidVariableError(f"no datasets of the coordinates {lacking}")
        return {c: (n,) for c, n in asked.items() if n is not None} | {"air_pressure": self.pressures}

    def whole(self, own):
        own, out = {k.lower(): v for k, v in own.items()}, {}
        if "latitude_coordinate" not in own and ("time_coordinate" in own or "coordinates" not in own):
            for c, key in (("latitude", "station_lat"), ("longitude", "station_lon"), ("altitude", "station_altitude")):
                if m := re.match(r"\s*([-+]?\d*\.?\d+)\s*([NSEW]?)", own.get(key, "")):
                    out[c] = float(m[1]) * (-1 if m[2] in ("S", "W") else 1)
                elif c != "altitude" and "station_lat" in own:
                    raise InvalidVariableError(f"a fixed station, but {key} is {own.get(key)!r}")
        if "time_coordinate" in own and "vertical_coordinate" not in own:
            out.setdefault("altitude", 0.0)  # ships, and stations that do not say
        if "time_stamp_info" in own:
            out["_origin"] = to_days(parse_datetime(own["time_stamp_info"].strip()).min())
        return out

    def chosen(self, names, a):
        held = {x.get("auxiliary") for x in a.values()}
        return [n for n in names if n not in held]

    def variable(self, name, v, kind, a, df):
        if not kind.startswith("array") or not a.get("auxiliary"):
            return super().variable(name, v, kind, a, df)
        held = F.col(f"`{a['auxiliary']}`")
        value = lambda x, i: F.struct(F.try_element_at(held, i + 1).cast("double").alias("at"), self.decoded(x.cast("double"), a).alias("value"))
        return [F.transform(v, value).alias(name, metadata={"auxiliary": a["auxiliary"]} | {k: a[k] for k in ("units", "long_name", "standard_name") if k in a})]

    def cells(self, df, a, whole, own):
        dims = {n: a.get(n, {}).get("dimensions", "").split() for n, t in df.dtypes if t.startswith("array")}
        for n, d in dims.items():
            if len(d) > 2:
                raise InvalidVariableError(f"{n} has dimensions {d}; one beside time is all that can be read")
            if len(d) == 2:
                # The dataset of the dimension's own name, or the first that has it alone.
                held = next((m for m in (d[1], *df.columns) if dims.get(m) == [d[1]]), None)
                a = a | {n: a[n] | ({} if held is None else {"auxiliary": held})}
        return super().cells(df, a, whole, own)

    def spread(self, df):
        held = {f.name: f.metadata["auxiliary"] for f in df.schema.fields if "auxiliary" in (f.metadata or {})}
        if len(set(held.values())) > 1:
            raise InvalidVariableError(f"variables along several dimensions: {held}")
        if not held:
            return df
        first, meta = next(iter(held)), {n: {k: v for k, v in df.schema[n].metadata.items() if k != "auxiliary"} for n in held}
        out = df.withColumn("_k", F.explode(F.transform(first, lambda _, i: i)))
        out = out.withColumn(held[first], F.get(first, F.col("_k"))["at"])
        out = out.withColumns({n: F.get(n, F.col("_k"))["value"] for n in held}).drop("_k")
        for n, m in meta.items():
            out = out.withMetadata(n, m)
        return out


@register
class NetcdfGridded(Extracted):
    """Any other grid. Altitude comes from geopotential or its height, if there is no other; air pressure in hPa or Pa as stored."""

    gridded = True

    name, signatures, priority = "NetCDF_Gridded", (r".*\.nc",), 1

    def more(self, df, a):
        if "altitude" in df.columns or "alt" in df.columns:
            return {}
        if "geopotential" in df.columns:
            return {"altitude": self.decoded(F.col("geopotential").cast("double"), a.get("geopotential", {})) / GRAVITY}
        return {"altitude": self.decoded(F.col("geopotential_height").cast("double"), a.get("geopotential_height", {}))} if "geopotential_height" in df.columns else {}


class HadGem(NetcdfGridded):
    """Time may be called t; hybrid heights are a + b * orography, in metres."""

    priority = 10
    coords = Extracted.coords | {"time": ("time", "t")}

    def more(self, df, a):
        if {"a", "b", "orog"} <= set(df.columns):
            return {"altitude": F.col("a").cast("double") + F.col("b").cast("double") * F.col("orog").cast("double")}
        return super().more(df, a)

    def chosen(self, names, a):
        return [n for n in names if n not in ("a", "b", "orog")]


@register
class HadGemConvsh(HadGem):
    name, signatures = "HadGEM_CONVSH", (r"[a-z]{6}[\._][pamd]{2}[0-9]{4,6}.*\.nc",)


@register
class HadGemPp(HadGem):
    name, signatures = "HadGEM_PP", (r".*\.pp",)


@register
class EarthCare(Extracted):
    """Datasets with a further dimension are variables by index: <name>_BANDNUM_3 and the like, and <name> for index 0."""

    name, signatures = "EarthCARE_MSI_ATL", (r".*(ATL_CTH_2A|ATL_EBD_2A|ATL_FM__2A|ATL_ICE_2A|ATL_TC__2A|ATL_AER_2A|ATL_ALD_2A|MSI_AOT_2A|MSI_COP_2A|MSI_CM__2A|MSI_RGR_1C|ATL_NOM_1B).*.h5",)
    coords = {"longitude": ("longitude", "ellipsoid_longitude"), "latitude": ("latitude", "ellipsoid_latitude"), "altitude": ("height",), "time": ("time",)}

    def time(self, v, a, name):
        return super().time(v, a, name) if "since" in a.get(name, {}).get("units", "") else seconds_since(v, dt.datetime(2000, 1, 1))

    def variable(self, name, v, kind, a, df):
        if not kind.startswith("array"):
            return super().variable(name, v, kind, a, df)
        suffix = a.get("dimension", "BAND").upper()
        if f"_{suffix}NUM_" not in EARTHCARE_SUFFIXES:
            raise InvalidVariableError(f"{name}: no suffix for dimension {suffix!r}")
        size = int(a.get("length", 0)) or (df.select(F.max(F.size(v))).first()[0] or 0)
        at = lambda i: self.decoded(F.try_element_at(v, F.lit(i + 1)).cast("double"), a)
        return [at(0).alias(name), *[at(i).alias(f"{name}_{suffix}NUM_{i}") for i in range(size)]]
