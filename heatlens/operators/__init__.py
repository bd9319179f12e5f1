"""DataFrame operators. An access table has the columns ``key``, ``arrival``
(unique integers in arrival order) and, where slices follow the clock, ``ts``."""
