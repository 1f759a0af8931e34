"""skein: collective-motion analytics as Spark DataFrame jobs."""

from skein.schema import World

__all__ = ["World"]
