"""Registered queries, one per operator of the inventory (see README)."""

from .registry import ORACLE, QUERIES, register  # noqa: F401
from . import q_numeric, q_tabular, q_text, q_image, q_memorize, q_plans, q_noise, q_grid, q_head, q_canary, q_variants  # noqa: F401,E402
