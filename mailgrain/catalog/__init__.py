"""All registered queries."""

from .registry import ORACLES, QUERIES  # noqa: F401
from . import copies, decisions, evaluation, models, rules, signals, studies, text  # noqa: F401
