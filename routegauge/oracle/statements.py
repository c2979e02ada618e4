"""All checking statements, one per registered query that SQL can express."""

from routegauge.oracle import derived  # noqa: F401
from routegauge.oracle.builder import build
from routegauge.oracle.features import FEATURES
from routegauge.oracle.models import MODELS
from routegauge.oracle.routing import ROUTING
from routegauge.oracle.scoring import SCORING
from routegauge.oracle.texts import TEXTS

_BODIES = {**SCORING, **ROUTING, **FEATURES, **TEXTS, **MODELS}


def statements() -> dict[str, str]:
    return {name: build(body) for name, body in _BODIES.items()}
