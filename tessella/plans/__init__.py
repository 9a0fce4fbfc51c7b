"""Plans of the library, registered as queries."""

from . import analysis, formats, genomics, inference, models, relational  # noqa: F401
from .registry import ORACLE_SQL, QUERIES  # noqa: F401
