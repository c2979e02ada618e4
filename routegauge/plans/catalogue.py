"""Collects every registered plan."""

from routegauge.plans import features, models, routing, scoring, texts  # noqa: F401
from routegauge.plans.registry import PLANS, Plan


def all_plans() -> dict[str, Plan]:
    return PLANS
