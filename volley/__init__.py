"""Spike-train and multichannel-signal analytics as Spark DataFrame operators."""
