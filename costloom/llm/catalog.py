"""Imports every operator module so that its query is registered."""

from costloom.llm import (  # noqa: F401
    collocations,
    decontaminate,
    langid,
    linehash,
    media,
    mixing,
    onebit,
    pii,
    prefixes,
    quality,
    sharding,
    simhash,
    toxicity,
)
from costloom.llm.registry import ORACLES, QUERIES  # noqa: F401
