"""Analytics over hierarchical document corpora and their knowledge graphs, on PySpark."""

__version__ = "0.2.0"


def info() -> dict[str, str]:
    """The version and what it runs on."""
    import platform

    import pyspark

    return {"lexigrid": __version__, "pyspark": pyspark.__version__, "python": platform.python_version()}
