"""All registered queries. Importing the family modules fills the registry."""

from tactus.plans import q_frames, q_groups, q_io, q_matching, q_models, q_sequences  # noqa: F401
from tactus.plans.registry import ORACLES, QUERIES  # noqa: F401
