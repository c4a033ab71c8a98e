"""Questions about element types, answered on the driver."""

from __future__ import annotations

import numpy as np

from loomarray.cells import Array


def _kind(x):
    return x.dtype if isinstance(x, Array) else x


def can_cast(from_, to, casting: str = "safe") -> bool:
    return np.can_cast(_kind(from_), _kind(to), casting)


def common_type(*arrays) -> np.dtype:
    return np.dtype(np.common_type(*(np.empty(0, _kind(a)) for a in arrays)))


def result_type(*args) -> np.dtype:
    return np.result_type(*map(_kind, args))


def min_scalar_type(x) -> np.dtype:
    return np.min_scalar_type(x)


def issubdtype(a, b) -> bool:
    return np.issubdtype(_kind(a), b)


#: Descriptions of type characters.
NAMES = {
    "?": "bool", "b": "signed char", "B": "unsigned char", "h": "short", "H": "unsigned short", "i": "integer", "I": "unsigned integer",
    "l": "long integer", "L": "unsigned long integer", "q": "long long integer", "Q": "unsigned long long integer", "f": "single precision",
    "d": "double precision", "F": "complex single precision", "D": "complex double precision", "e": "half precision",
}


def typename(kind) -> str:
    return NAMES.get(kind, NAMES.get(np.dtype(kind).char, str(kind)))


def mintypecode(typechars, typeset: str = "GDFgdf", default: str = "d") -> str:
    return np.mintypecode(typechars, typeset, default)
