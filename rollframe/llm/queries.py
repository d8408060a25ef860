"""All queries of the subpackage, gathered from their modules."""

from rollframe.llm import decontaminate, divergence, language, licenses, lines, manifest, near, packing, quality, secrets, substring, topk, toxicity  # noqa: F401
from rollframe.llm.common import ORACLES, QUERIES  # noqa: F401
