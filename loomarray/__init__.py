"""N-dimensional array analytics on Spark DataFrames.

Names are those of NumPy's API; `linalg`, `fft` and `random` are namespaces.  Names resolve on first
use, so importing the package costs nothing.
"""

from __future__ import annotations

import importlib

_OPS = "loomarray.operators."
_MODULES = {
    "linalg": _OPS + "linalg",
    "fft": _OPS + "fft",
    "random": _OPS + "random",
}
#: Subpackages and modules, which the import system finds.
_PARTS = {"cells", "dtypes", "functions", "llm", "operators", "plans", "sources", "streaming"}
#: Where top-level names live, in the order they are looked for.
_SEARCH = [_OPS + m for m in ("ufuncs", "reductions", "scans", "sorting", "shape", "indexing", "creation", "linalg", "polynomials", "formatting", "typing")]
#: Names that the modules have under another one.
_NAMED = {
    "ravel": (_OPS + "shape", "ravel_"),
    "Array": ("loomarray.cells", "Array"),
    "from_column": ("loomarray.cells", "from_column"),
    "from_columns": ("loomarray.cells", "from_columns"),
    "from_vectors": ("loomarray.cells", "from_vectors"),
    "asarray": ("loomarray.cells", "asarray"),
    "load": ("loomarray.sources.npy", "load_any"),
    "loadSync": ("loomarray.sources.npy", "load_any"),
    "save": ("loomarray.sources.npy", "save"),
    "saveSync": ("loomarray.sources.npy", "save"),
    "tofile": ("loomarray.sources.npy", "to_file"),
    "crc32": ("loomarray.sources.npy", "crc32"),
    "savez": ("loomarray.sources.npy", "savez"),
    "savez_compressed": ("loomarray.sources.npy", "savez_compressed"),
    "parseNpy": ("loomarray.sources.npy", "parse"),
    "parseNpyHeader": ("loomarray.sources.npy", "parse_header"),
    "parseNpyData": ("loomarray.sources.npy", "parse_data"),
    "parseDescriptor": ("loomarray.sources.npy", "parse_descriptor"),
    "serializeNpy": ("loomarray.sources.npy", "serialize"),
    **{n: ("loomarray.sources.npy", "parse_npz") for n in ("parseNpz", "parseNpzSync", "loadNpz", "loadNpzSync")},
    **{n: ("loomarray.sources.npy", "serialize_npz") for n in ("serializeNpz", "serializeNpzSync")},
    **{n: ("loomarray.sources.npy", "load") for n in ("loadNpy", "loadNpySync")},
    **{n: ("loomarray.sources.npy", "save") for n in ("saveNpy", "saveNpySync")},
    **{n: ("loomarray.sources.npy", "load_npz") for n in ("loadNpzFile", "loadNpzFileSync")},
    **{n: ("loomarray.sources.npy", "save_npz") for n in ("saveNpz", "saveNpzSync")},
    **{n: ("loomarray.sources.npy", "read_zip") for n in ("readZip", "readZipSync")},
    **{n: ("loomarray.sources.npy", "write_zip") for n in ("writeZip", "writeZipSync")},
    **{n: ("loomarray.sources.text", "loadtxt") for n in ("loadtxt", "loadtxtSync", "parseTxt")},
    **{n: ("loomarray.sources.text", "genfromtxt") for n in ("genfromtxt", "genfromtxtSync")},
    **{n: ("loomarray.sources.text", "fromregex") for n in ("fromregex", "fromregexSync")},
    **{n: ("loomarray.sources.text", "savetxt") for n in ("savetxt", "savetxtSync")},
    "serializeTxt": ("loomarray.sources.text", "to_text"),
    "item": ("loomarray.cells", "item"),
    "tolist": ("loomarray.cells", "tolist"),
    "tobytes": ("loomarray.cells", "tobytes"),
    "ndim": ("loomarray.cells", "ndim"),
    "shape": ("loomarray.cells", "shape"),
    "size": ("loomarray.cells", "size"),
    "byteswap": ("loomarray.cells", "byteswap"),
    "view": ("loomarray.cells", "view"),
}


def __getattr__(name: str):
    if name in _MODULES:
        return importlib.import_module(_MODULES[name])
    if name in _NAMED:
        module, own = _NAMED[name]
        return getattr(importlib.import_module(module), own)
    if not name.startswith("_") and name not in _PARTS:
        for m in _SEARCH:
            found = getattr(importlib.import_module(m), name, None)
            if callable(found):
                return found
    raise AttributeError(f"module 'loomarray' has no attribute {name!r}")
