"""Executors have no copy of the package: what runs there must load in a bare interpreter."""

import importlib
import os
import pkgutil
import subprocess
import sys
import tempfile

from pyspark import cloudpickle

import assayer.llm

LOAD = """
import pickle, sys
functions = pickle.load(open(sys.argv[1], "rb"))
import numpy as np
text = np.frombuffer(b"one two  three", np.uint8)
found = functions["tokens.words"](text, np.array([0, len(text)]))
assert len(found) == 3 and len(functions["tokens.ngrams"](found.hash, 2)) == 2
assert len(functions["language.counts"](text, np.array([0, len(text)]))[0])
assert not [m for m in sys.modules if m.split(".")[0] == "assayer"], "the package was imported"
"""


def test_functions_load_without_the_package():
    functions = {}
    for info in pkgutil.iter_modules(assayer.llm.__path__):
        if info.name in ("queries", "oracles"):
            continue
        module = importlib.import_module(f"assayer.llm.{info.name}")
        for name, value in vars(module).items():
            if callable(value) and getattr(value, "__module__", "") == module.__name__:
                functions[f"{info.name}.{name}"] = value
    uses_session = {k for k, f in functions.items() if "materialize" in getattr(getattr(f, "__code__", None), "co_names", ())}
    functions = {k: f for k, f in functions.items() if k not in uses_session}  # these run on the driver
    driver = [k for k, f in functions.items() if b"assayer.session" in cloudpickle.dumps(f)]
    functions = {k: f for k, f in functions.items() if k not in driver}
    with tempfile.NamedTemporaryFile(suffix=".pkl", delete=False) as file:
        file.write(cloudpickle.dumps(functions))
    environment = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", LOAD, file.name], cwd="/", env=environment, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    assert len(functions) > 60
