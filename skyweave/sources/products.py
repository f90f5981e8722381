"""Product registry and the readers of text and Parquet products.

Binary formats (NetCDF, HDF, PP) need libraries that are not here; a reader of one is a Product whose scan is a Python data
source or a table made beforehand, registered like the ones below.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ClassNotFoundError, FileFormatError, InvalidVariableError, ProductPluginError
from ..functions.decode import fill, ingest
from ..functions.names import coordinates, select_variables
from ..functions.time import std_time


class Product:
    """A kind of file. signatures: patterns that a file's name must match whole, in either case; the highest priority is asked first."""

    name = ""
    signatures: tuple[str, ...] = ()
    priority = 10

    def errors(self, spark: SparkSession, path: str) -> list[str]:
        """Why a file that matches is not of this kind after all."""
        return []

    def scan(self, spark: SparkSession, paths: list[str]) -> DataFrame:
        raise NotImplementedError

    def spread(self, df: DataFrame) -> DataFrame:
        """The chosen variables with a row for each point that they have beside the file's own."""
        return df

    def matches(self, path: str) -> bool:
        base = path.rstrip("/").rsplit("/", 1)[-1]
        return any(re.fullmatch(s, base, re.I) for s in self.signatures)


class OwnParquet(Product):
    """What save() wrote, or any table with coordinate columns."""

    name, signatures, priority = "parquet", (r".*\.parquet",), 100

    def scan(self, spark, paths):
        return spark.read.parquet(*paths)


class Hyperpoints(Product):
    """Comma-separated latitude, longitude, altitude, time, value, without a header."""

    name, signatures = "ASCII_Hyperpoints", (r".*\.txt",)

    def scan(self, spark, paths):
        df = spark.read.schema("latitude double, longitude double, altitude double, _time string, value double").option("ignoreLeadingWhiteSpace", True).csv(paths)
        # A time is a number of days, or a date.
        days = F.coalesce(F.col("_time").try_cast("double"), std_time(F.try_to_timestamp("_time")))
        return df.select("latitude", "longitude", "altitude", days.alias("time"), "value")


class Aeronet(Product):
    """Station files, and cruises (Maritime Aerosol Network) at sea level: some lines of text, a header line, then rows with dates as
    dd:mm:yyyy or dd-mm-yyyy. Repeated names are numbered from 0; wavelengths of which only the first column is named are counted in
    the first row."""

    name, signatures, priority = "Aeronet", (r".*\.lev20", r".*\.lev15", r".*\.ONEILL_.*", r".*\.all", r"All_Sites_Times.*dat"), 20
    #: What stands for a missing value.
    missing = ("N/A", "-999", "-999.", "-999.0", "-999.000000", "-10000", "-10000.", "-10000.0")
    #: Characters that names lose.
    deleted = r"""~!@#$%^&*=+\|]}[{'; /?.>,<"""

    def scan(self, spark, paths):
        out = None
        for p in paths:
            one = self._file(spark, p)
            out = one if out is None else out.unionByName(one, allowMissingColumns=True)
        return out

    def _file(self, spark, path):
        head = [r.value for r in spark.read.text(path).limit(12).collect()]
        at = next((i for i, line in enumerate(head) if re.match(r"(AERONET_Site[^,]*,)?Date_?\(dd[:-]mm[:-]yy", line, re.I)), None)
        if at is None:
            raise FileFormatError(f"{path}: no line of column names in the first {len(head)}")
        names = [n.strip() for n in head[at].split(",")]
        first = head[at + 1].split(",") if at + 1 < len(head) else []
        if re.match(r"Exact_Wavelengths_for_Input_AOD", names[-1], re.I) and len(first) >= len(names) - 1:
            names += names[-1:] * (int(float(first[len(names) - 2])) - 1)
        names = [f"{n}{names[:i].count(n)}" if names.count(n) > 1 else n for i, n in enumerate(names)]
        names = [n.translate({ord(c): None for c in self.deleted}) for n in names]
        place = {k.lower(): float(v) for k, v in re.findall(r"(long|lat|elev)\w*\s*=\s*([-+.\d]+)", ",".join(head[:at]), re.I)}
        if "Maritime Aerosol Network" in head[0]:
            place["elev"] = 0.0
        raw = spark.read.text(path).where(F.col("value").rlike(r"^([^,]*,)?\d{1,2}[:-]\d{1,2}[:-]\d{4},"))
        cells = F.split("value", ",")
        get = lambda i: F.trim(F.try_element_at(cells, F.lit(i + 1)))
        value = lambda i: F.when(~get(i).isin(*self.missing), get(i)).try_cast("double")
        find = lambda pattern: next((i for i, n in enumerate(names) if re.match(pattern, n, re.I)), None)
        day, clock = find(r"Date_?\(dd"), find(r"Time_?\(hh")
        when = F.try_to_timestamp(F.translate(F.concat_ws(" ", get(day), get(clock)), "-", ":"), F.lit("d:M:yyyy HH:mm:ss"))
        coords = {}
        for c, key, pattern in (("longitude", "long", r"(Site_)?Longitude"), ("latitude", "lat", r"(Site_)?Latitude"), ("altitude", "elev", r"(Site_)?Elevation")):
            coords[c] = F.lit(place[key]) if key in place else value(find(pattern)) if find(pattern) is not None else F.lit(None).cast("double")
        taken = {day, clock} | {find(p) for p in (r"(Site_)?Longitude", r"(Site_)?Latitude", r"(Site_)?Elevation")} | {i for i, n in enumerate(names) if re.match(r"AERONET_Site|Data_Quality|Last_Processing|Last_Date", n, re.I)}
        return raw.select(*[v.alias(c) for c, v in coords.items()], std_time(when).alias("time"), *[value(i).alias(n) for i, n in enumerate(names) if n and i not in taken])


class CsvPoints(Product):
    """Comma-separated values with a header that names the coordinates."""

    name, signatures = "csv", (r".*\.csv",)

    def scan(self, spark, paths):
        return spark.read.option("header", True).option("inferSchema", True).csv(paths)


PRODUCTS: dict[str, Product] = {}


def register(product: type[Product] | Product) -> type[Product] | Product:
    """Add a product, or replace the one of the same name. Also a class decorator."""
    p = product() if isinstance(product, type) else product
    if not p.name or not p.signatures:
        raise ProductPluginError("a product needs a name and signatures")
    PRODUCTS[p.name] = p
    return product


for _p in (OwnParquet, Hyperpoints, Aeronet, CsvPoints):
    register(_p)


def find_product(spark: SparkSession, path: str, product: str | None = None) -> Product:
    if product is not None:
        if product not in PRODUCTS:
            raise ClassNotFoundError(f"no product {product!r}; known: {sorted(PRODUCTS)}")
        return PRODUCTS[product]
    errors = []
    for p in sorted(PRODUCTS.values(), key=lambda p: -p.priority):
        if p.matches(path):
            if not (why := p.errors(spark, path)):
                return p
            errors += why
    if errors:
        raise FileFormatError(errors)
    raise ClassNotFoundError(f"no product for {path}")


def _paths(paths: str | Iterable[str]) -> list[str]:
    """A list or comma-separated text of paths, each once, in order; Spark expands wildcards."""
    return list(dict.fromkeys(p.strip() for p in (paths.split(",") if isinstance(paths, str) else paths)))


def read(spark: SparkSession, paths: str | Iterable[str], names: list[str] | str, *, product: str | None = None, aliases: list[str] | None = None, fills: tuple = ()) -> DataFrame:
    """Coordinates and the named variables (wildcards allowed) of files of one product, told by the first. Rows with a missing
    coordinate go; NaN and fill values are NULL."""
    found = _paths(paths)
    if not found:
        raise FileFormatError("no files")
    kind = find_product(spark, found[0], product)
    df = kind.scan(spark, found)
    out = kind.spread(select_variables(df, [names] if isinstance(names, str) else list(names), aliases))
    coords = coordinates(out)
    values = [c for c in out.columns if c not in coords]
    present = [c for c in coords if c != "altitude" or not _all_null(df, c)]
    out = ingest(out.select(*present, *values), present, values)
    return out.withColumns({v: fill(F.col(v), *fills) for v in values}) if fills else out


def _all_null(df: DataFrame, c: str) -> bool:
    """Whether a column is a NULL literal, seen in the plan's schema alone."""
    return dict(df.dtypes)[c] == "void"


def read_one(spark: SparkSession, paths: str | Iterable[str], name: str, **kw) -> DataFrame:
    """Exactly one variable."""
    df = read(spark, paths, [name], **kw)
    if len(df.columns) - len(coordinates(df)) != 1:
        raise InvalidVariableError(f"{name!r} means several variables")
    return df


def variables(spark: SparkSession, paths: str | Iterable[str], *, product: str | None = None, type: str | None = None) -> list[str]:
    """Names of the variables, of one Spark type if asked. A column with dimensions of its own (an array, map or struct) is none."""
    found = _paths(paths)
    df = find_product(spark, found[0], product).scan(spark, found)
    coords = coordinates(df)
    return [c for c, t in df.dtypes if c not in coords and not t.startswith(("array", "map", "struct")) and (type is None or t == type)]
