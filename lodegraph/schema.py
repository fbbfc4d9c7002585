"""The closed vocabulary of the graph: node and edge types, their allowed pairs, and the constants of its scores."""

from __future__ import annotations

NODE_TYPES = ("Company", "Person", "Organization", "Product", "Event")
SYMMETRIC = ("PARTNERS_WITH", "COMPETES_WITH")

#: Edge type, its category, the types it may start from and those it may end at.
EDGE_MATRIX = [
    ("OWNS_STAKE_IN", "ownership", ("Company", "Person", "Organization"), ("Company", "Organization")),
    ("IS_EXECUTIVE_OF", "ownership", ("Person",), ("Company", "Organization")),
    ("SUPPLIES_TO", "trade", ("Company",), ("Company",)),
    ("PARTNERS_WITH", "trade", ("Company", "Organization"), ("Company", "Organization")),
    ("ACQUIRES", "trade", ("Company",), ("Company",)),
    ("SUES", "risk", ("Company", "Person", "Organization"), ("Company", "Person", "Organization")),
    ("COMPETES_WITH", "risk", ("Company", "Product"), ("Company", "Product")),
    ("REGULATES", "risk", ("Organization",), ("Company", "Product")),
    ("DEVELOPS", "product", ("Company",), ("Product",)),
    ("DEPENDS_ON", "product", ("Company", "Product"), ("Product",)),
    ("HAS_EVENT", "event", ("Company", "Product"), ("Event",)),
    ("IMPACTS", "event", ("Event",), ("Company", "Product")),
]
EDGE_RULES = [(e, category, a, b) for e, category, sources, targets in EDGE_MATRIX for a in sources for b in targets]

#: Fixed values of the scores.
GRACE, EXPIRED, STALE, UNKNOWN = 1.5, 0.3, 0.6, 0.7
DEFAULT_CONFIDENCE, WRONG_TYPE_PENALTY = 0.7, 0.5
HIDDEN_VERDICTS = ("unfounded", "insufficient")
HOP_SUPPLY, HOP_DEMAND, HUB_HALF, MIN_SCORE = 0.55, 0.35, 40.0, 0.05
RRF_K = 60
MIN_SHARED, MIN_LIFT = 2, 10.0
