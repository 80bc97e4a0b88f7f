"""Scalar Column factories: numbers, labels, periods, money units, text rules and boxes."""
