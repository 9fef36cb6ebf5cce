"""Security-event analytics as Spark jobs: normalise, score, correlate, enrich, assess, audit."""
