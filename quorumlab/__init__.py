"""Federated-update robustness analytics as Spark jobs.

DataFrame in, DataFrame out.  The corpus, the client updates, the predictions
and the run history are tables; every operator is a plan over them.
"""

__version__ = "0.1.0"
