"""Headway: public-transport schedule analytics on Spark."""
