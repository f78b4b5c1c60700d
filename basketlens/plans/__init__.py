"""Whole plans: feature engineering, the end-to-end pipeline, registered queries."""
