"""taxonspark: assign categories to texts with keyword rules, nearest brands and descriptions, on Spark."""

from .params import DEFAULT_PARAMS, Params  # noqa: F401
