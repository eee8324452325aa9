"""Document-text analytics on Spark."""

from __future__ import annotations

__version__ = "0.1.0"

_WHERE = {
    "Pipeline": "plans.pipeline", "Models": "plans.pipeline", "detect": "plans.pipeline", "classify": "plans.pipeline", "recognize": "plans.pipeline",
    "Options": "options", "OptionError": "options", "LoadError": "sources.pixels", "decode": "sources.images", "read_files": "sources.images", "from_arrays": "sources.images", "from_pil": "sources.images", "read_images": "sources.images", "overlays": "sources.drawing", "page_elapse": "operators.results",
    "stream_lines": "streaming", "write_lines": "streaming", "to_json": "operators.layout", "to_markdown": "operators.layout", "register_functions": "functions.register", "register_engine": "sessions",
    "read_pictures": "sources.datasource", "write_pictures": "sources.datasource", "register_sources": "sources.datasource", "register_tables": "functions.tables", "line_crops": "sources.drawing",
    "ship": "sources.assets", "fetch_assets": "sources.assets", "Asset": "sources.assets", "AssetError": "sources.assets", "prepared_models": "plans.prepare", "prepared_font": "plans.prepare", "checked": "plans.pipeline",
}


def __getattr__(name: str):
    if name not in _WHERE:
        raise AttributeError(name)
    from importlib import import_module

    return getattr(import_module(f".{_WHERE[name]}", __name__), name)


def __dir__():
    return sorted([*globals(), *_WHERE])
