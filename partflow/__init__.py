"""Spare-parts inventory and purchase-document analytics on Spark."""
