"""The registered queries of the catalogue operators."""

from mediagrain.plans import credits, documents, linkage, lyrics, payloads, quality, relational, reports, shaping, streams, textual

MODULES = (relational, textual, quality, reports, linkage, documents, streams, shaping, credits, lyrics, payloads)


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.Q.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.SQL.items()}
