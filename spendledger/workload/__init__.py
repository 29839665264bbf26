"""The operators and reports run over the driver's tables, with an independent SQL answer each."""
