"""What the driver's contract registers from this subpackage and from the pipeline."""

import corpus_pipeline
from verdigris.llm import oracles, queries

QUERIES = queries.QUERIES | {"pipeline": corpus_pipeline.run}
ORACLES = oracles.ORACLES | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
