"""Analytics for point clouds and grids of observations, as lazy Spark DataFrames.

Point data is a DataFrame with coordinate columns (latitude, longitude, altitude, air_pressure, time) and variable
columns; gridded data is the same in long form, one row a cell. NULL is the only missing value.
"""

from .errors import *  # noqa: F403

__version__ = "0.1.0"
