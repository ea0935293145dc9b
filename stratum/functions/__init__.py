"""Column functions: configured arithmetic, rounding, lenient numbers and dates."""
