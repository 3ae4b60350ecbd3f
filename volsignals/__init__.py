"""Volume-anomaly analytics over daily price/volume bars, as Spark DataFrame operators.

``functions``  column expressions (exact rounding, fixed-point means, text parsing)
``sources``    CSV and vendor readers, cleaning, test tables derived from the driver data
``operators``  DataFrame -> DataFrame building blocks (windows, joins, upserts, exit rules)
``plans``      whole queries put together from the operators
``streaming``  Structured Streaming forms of the ingest and of the position ratchet
"""

from volsignals.params import Params

__all__ = ["Params"]
