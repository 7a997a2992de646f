"""Every query by its inventory id, and the SQL that checks it."""

from . import registry  # noqa: F401
from .registry import oracles, queries  # noqa: F401
