"""Spark-native analytics of batches of electrochemical impedance spectra."""
