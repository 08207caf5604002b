"""Column functions: built-in expressions wherever Spark has them, Arrow UDFs where it has not."""
