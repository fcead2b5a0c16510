"""Sentinels and tolerances shared by the operators."""

UNASSIGNED = 0
NOISE = -1
INT_MAX = 2_147_483_647

#: Rows a table may have at most before a plan stops broadcasting it and shuffles instead.
BROADCAST_ROWS = 500_000
