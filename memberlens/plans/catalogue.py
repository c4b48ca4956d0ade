"""All registered queries."""

from memberlens.plans import q_history, q_models, q_months, q_notes, q_quality, q_relational  # noqa: F401
from memberlens.plans.registry import ORACLES, QUERIES  # noqa: F401
