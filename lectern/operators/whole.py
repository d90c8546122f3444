"""Products of matrices of small whole numbers, several times as fast as single precision.

Vectors of counts (the hash embedder's) fit a byte, and processors multiply
bytes at a multiple of the rate of floats. NumPy has no such product, so it is
run by onnxruntime where that is installed; callers keep their float product
for machines without it and for other vectors. Values up to :data:`LARGEST`
cannot overflow on any processor, so the products are exact.
"""

from __future__ import annotations

import functools

import numpy as np

LARGEST = 127                # two products of such values fit 16 bits, which older processors sum them in

_FLOAT, _UINT8, _INT8 = 1, 2, 3


def counts(mat: np.ndarray) -> bool:
    """Whether all values are whole numbers from 0 to :data:`LARGEST`."""
    return not mat.size or bool(mat.min() >= 0 and mat.max() <= LARGEST and np.array_equal(mat, np.rint(mat)))


def _number(n: int) -> bytes:
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def _field(at: int, value: int | str | bytes) -> bytes:
    """One field of a protocol buffer."""
    if isinstance(value, int):
        return _number(at << 3) + _number(value)
    value = value.encode() if isinstance(value, str) else value
    return _number(at << 3 | 2) + _number(len(value)) + value


def _array(name: str, kind: int, *dims: str) -> bytes:
    shape = b"".join(_field(1, _field(2, d)) for d in dims)
    return _field(1, name) + _field(2, _field(1, _field(1, kind) + _field(2, shape)))


def _graph() -> bytes:
    """An ONNX model of one node: ``y = (a @ b) * s * t``, bytes in, floats out."""
    node = b"".join(_field(1, x) for x in "abst") + _field(2, "y") + _field(4, "MatMulIntegerToFloat") + _field(7, "com.microsoft")
    graph = (_field(1, node) + _field(2, "product")
             + b"".join(_field(11, x) for x in (_array("a", _UINT8, "m", "w"), _array("b", _INT8, "w", "n"),
                                                _array("s", _FLOAT), _array("t", _FLOAT, "n")))
             + _field(12, _array("y", _FLOAT, "m", "n")))
    sets = _field(8, _field(2, 13)) + _field(8, _field(1, "com.microsoft") + _field(2, 1))
    return _field(1, 7) + _field(7, graph) + sets


@functools.cache
def _session():
    """The product of this process, on one thread; None where it is not installed or gives other results."""
    try:
        import onnxruntime
        options = onnxruntime.SessionOptions()
        options.intra_op_num_threads = options.inter_op_num_threads = 1
        options.log_severity_level = 3
        session = onnxruntime.InferenceSession(_graph(), options, providers=["CPUExecutionProvider"])
        a, b = np.full((33, 70), LARGEST, np.uint8), np.full((70, 17), LARGEST, np.int8)
        b[:, ::2] = -LARGEST
        right = np.array_equal(_run(session, a, b, np.full(17, 0.5, np.float32)), a.astype(np.float32) @ b.astype(np.float32) / 2)
        return session if right else None
    except Exception:                            # noqa: BLE001  not there or of another make: floats do the same work
        return None


def _run(session, a, b, scale):
    return session.run(None, {"a": a, "b": b, "s": np.array(1, np.float32), "t": scale})[0]


def available() -> bool:
    return _session() is not None


def scaled_product(a: np.ndarray, b: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """``(a @ b) * scale`` in single precision: ``a`` unsigned bytes up to :data:`LARGEST`, ``b``
    signed bytes, ``scale`` a float32 for each column of ``b``. Exact but for the last multiplication."""
    return _run(_session(), a, b, scale)
