"""Sources, sinks, sessions and user-defined functions."""

from .functions import read_function, remote_function, udf
from .session import Session

__all__ = ["Session", "read_function", "remote_function", "udf"]
