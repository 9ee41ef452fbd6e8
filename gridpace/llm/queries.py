"""All registered queries of the subpackage, with their SQL."""

from gridpace.llm import anchors, bagminhash, bisectors, decontaminate, langid, mixing, postings, quality, ring, suffixes, tokencount, urlrep, whitening  # noqa: F401  registers on import
from gridpace.llm.common import ORACLES, QUERIES  # noqa: F401
