"""Runnable jobs over the library: screening of new spectra, and leakage-safe splits of labelled texts."""
