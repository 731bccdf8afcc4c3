"""kilnwork: a library of DataFrame operators for mining large record sets with PySpark."""
