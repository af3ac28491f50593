"""Dataflow operators: DataFrame in, DataFrame out, no actions unless said otherwise."""
