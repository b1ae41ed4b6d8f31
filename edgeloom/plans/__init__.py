"""Composed evaluations: sweeps over variants, summaries, figure frames."""
