"""Column expressions."""

from gridspark.functions.columns import *  # noqa: F401,F403
