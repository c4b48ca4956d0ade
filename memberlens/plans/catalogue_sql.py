"""SQL of published tables, for checks that read them."""

from memberlens.plans import q_history  # noqa: F401
from memberlens.plans.registry import ORACLES


def member_day_sql(body: str) -> str:
    return f"WITH day_table AS ({ORACLES['k11_member_day_table']})\n{body}"
