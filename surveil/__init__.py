"""surveil — a Spark-native trade-surveillance engine.

FIX-shaped order / execution / cancel events go through a bronze -> silver -> gold
medallion of DataFrame transforms, five rule detectors score every gold window and
emit alerts with deterministic ids, severities and digests, and the rest of the
library (audit chain, labels, ML scoring, streaming) is built from the same
DataFrame / SQL / Structured Streaming primitives.

Every public operator is ``DataFrame -> DataFrame`` and lazy; nothing is collected
on the driver except model fitting and scalar counts.
"""

__version__ = "0.1.0"
