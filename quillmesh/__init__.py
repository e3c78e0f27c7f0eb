"""quillmesh: content extraction and corpus preparation as ordinary PySpark DataFrame plans."""

from importlib.metadata import PackageNotFoundError, version

try:
    __version__ = version("quillmesh")
except PackageNotFoundError:  # run from its folder
    __version__ = "0.2.0"

__all__ = ["DETAIL", "EXIT", "Engine", "INPUTS", "Kind", "Provider", "RESULT", "Registry", "STAGES", "default_registry", "register_engine", "session", "__version__"]


def __getattr__(name: str):
    """The public names, imported when first asked for, so that the version needs no Spark."""
    from quillmesh import runtime
    from quillmesh.operators import detect, files, sinks
    from quillmesh.plans import pipeline

    places = {"EXIT": detect, "STAGES": sinks, "register_engine": files, "session": runtime}
    if name == "INPUTS":
        return pipeline.Engine.INPUTS
    if name in __all__:
        return getattr(places.get(name, pipeline), name)
    raise AttributeError(name)
