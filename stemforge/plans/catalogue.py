"""All queries of the core and their SQL."""

from stemforge.plans import core, problems

QUERIES = {**core.QUERIES, **problems.QUERIES}
ORACLE = {**core.ORACLE, **problems.ORACLE}
FLAGSHIP = core.c4_overlap_chunks
