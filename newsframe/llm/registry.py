"""All queries of the subpackage, with the pipeline at the repository's top."""

import corpus_pipeline
from newsframe.llm.queries import QUERIES
from newsframe.llm.sql import ORACLES

LLM_QUERIES = {**QUERIES, "pipeline": corpus_pipeline.run}
LLM_ORACLES = dict(ORACLES)
