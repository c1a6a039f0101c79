"""Imports every module that registers queries."""

from aqspark.plans import (  # noqa: F401
    accuracy,
    cleaning,
    dashboards,
    features,
    files,
    forecasts,
    health,
    hotspots,
    learning,
    marts,
    quality,
    streams,
    weather,
)
