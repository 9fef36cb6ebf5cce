"""All registered queries and their reference SQL."""

from tidewatch.plans import audit, correlate, detect, ingest, roundtrip, texts

MODULES = (detect, correlate, audit, ingest, texts, roundtrip)
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLES = {k: v for m in MODULES for k, v in m.ORACLES.items()}
