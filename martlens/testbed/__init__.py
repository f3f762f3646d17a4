"""The operators bound to the test tables, each with a reference SQL."""
