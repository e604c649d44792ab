import importlib
import io
import pickle
import pkgutil

import pytest
from pyspark import cloudpickle
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


class _Elsewhere(pickle.Unpickler):
    """Loads as an executor without this package does."""

    def find_class(self, module, name):
        if module.split(".")[0] == "serialis":
            raise ModuleNotFoundError(f"{module}.{name}")
        return super().find_class(module, name)


@pytest.fixture(scope="session")
def travels():
    """Asserts that all functions of a package's modules load where the package is absent."""

    def check(package):
        names = [m.name for m in pkgutil.walk_packages(package.__path__, package.__name__ + ".") if package.__name__ != "serialis" or ".llm" not in m.name]
        found = [f for n in names for f in vars(importlib.import_module(n)).values() if callable(f) and getattr(f, "__module__", None) == n]
        sent = 0
        for f in found:
            try:
                pickled = cloudpickle.dumps(f)
            except TypeError:  # A function of the driver, which no job can send.
                continue
            _Elsewhere(io.BytesIO(pickled)).load()
            sent += 1
        assert sent > 20

    return check
