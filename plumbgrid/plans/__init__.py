"""Every registered query."""

from . import (  # noqa: F401
    geometry,
    groups,
    live,
    meeting,
    moving,
    nearby,
    neighbours,
    spread,
    surfaces,
)
from .registry import QUERIES, SQL  # noqa: F401
