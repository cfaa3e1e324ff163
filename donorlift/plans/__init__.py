"""Named queries over the driver tables; importing this package fills the
registry."""

from donorlift.plans import q_clean, q_encode, q_eval, q_giving, q_models, q_ops, q_profile, q_profit, q_search  # noqa: F401
from donorlift.plans.registry import REGISTRY  # noqa: F401
