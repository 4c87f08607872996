"""Puts the repository on the path of the tests and of the workers that Spark starts."""

import os
import sys

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, HERE)
os.environ["PYTHONPATH"] = ":".join(filter(None, [HERE, os.environ.get("PYTHONPATH", "")]))
