"""All queries of this package and their SQL."""

from stemforge.llm import problems

QUERIES = {**problems.QUERIES}
ORACLE = {**problems.ORACLE}
