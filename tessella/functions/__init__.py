"""Column functions over a long panel: columns date, symbol, t (dense date ordinal). Missing is NULL, never NaN."""
