"""Files: round trips, and what NumPy writes and reads."""

import io

import numpy as np
import pytest

import loomarray as la
from loomarray.cells import asarray, local

M = np.arange(12.0).reshape(3, 4) / 7


def test_npy(spark, tmp_path):
    path = str(tmp_path / "a.npy")
    la.save(path, M)
    assert (np.load(path) == M).all() and (la.load(path).numpy() == M).all()
    np.save(path, np.asfortranarray(M))
    assert (la.load(path).numpy() == M).all()
    for kind in ("int8", "uint8", "int64", "uint64", "float16", "float32", "complex64", "complex128", "bool"):
        x = np.array([1, 0, 3]).astype(kind)
        assert (np.load(io.BytesIO(la.serializeNpy(local(x)))) == x).all()
        assert (la.parseNpy(la.serializeNpy(local(x))).numpy() == x).all()
    with pytest.raises(TypeError):
        la.parseDescriptor("<U3")
    with pytest.raises(ValueError):
        la.parseNpyHeader(b"nothing of the kind")


def test_npz(spark, tmp_path):
    path = str(tmp_path / "a.npz")
    for save in (la.savez, la.savez_compressed):
        save(path, M, y=np.array([1 + 2j]))
        z = np.load(path)
        assert (z["arr_0"] == M).all() and z["y"][0] == 1 + 2j
        assert set(la.load(path)) == {"arr_0", "y"}


def test_text(spark, tmp_path):
    path = str(tmp_path / "a.txt")
    la.savetxt(path, M, header="a head")
    assert np.allclose(np.loadtxt(path), M) and np.allclose(la.loadtxt(path).numpy(), M)
    assert np.allclose(la.loadtxt(path, usecols=[1, -1], skiprows=2, unpack=True).numpy(), np.loadtxt(path, usecols=[1, -1], skiprows=2, unpack=True))
    got = la.genfromtxt(["1,2,NA", "4,,6 # why"], delimiter=",").numpy()
    assert np.array_equal(got, [[1, 2, np.nan], [4, np.nan, 6]], equal_nan=True)
    assert la.loadtxt(["1", "2"]).shape == (2,)
    assert (la.fromregex(["a 1 x 2", "a 3 x 4"], r"a (\d+) x (\d+)").numpy() == [[1, 2], [3, 4]]).all()
    assert (la.loadtxt(["1+2j 3", "(4-1j) 2j"], dtype=complex).numpy() == [[1 + 2j, 3], [4 - 1j, 2j]]).all()
    with pytest.raises(ValueError):
        la.loadtxt(["1 2", "3"])


def test_raw(spark, tmp_path):
    path = str(tmp_path / "raw")
    la.tofile(M, path)
    assert (la.fromfile(path).numpy() == M.ravel()).all()
    a = asarray(M)
    assert (la.byteswap(la.byteswap(a)).numpy() == M).all()
    assert (la.view(a, "int64").numpy() == M.view("int64")).all()
    assert la.crc32(b"abc") == 0x352441C2


def test_stepwise(spark):
    """Blocks smaller than the array."""
    from loomarray.sources import npy

    x = np.arange(1000.0)
    assert b"".join(npy.values(local(x), block=64)) == x.tobytes()


def test_npz_stays_off_the_driver(spark, tmp_path, monkeypatch):
    """Members are written and read by blocks: neither whole bytes nor a table on the driver; a file may replace itself."""
    from loomarray.sources import npy

    path, x = str(tmp_path / "a.npz"), np.arange(3 * npy.BLOCK // 2).reshape(-1, 2) / 3

    def never(*a, **k):
        raise AssertionError("whole on the driver")

    a = local(x)
    monkeypatch.setattr(npy, "local", never)
    monkeypatch.setattr(npy, "serialize", never)
    for compress in (False, True):
        la.saveNpz(path, {"x": a, "y": asarray(M)}, compress)
        z = np.load(path)
        assert (z["x"] == x).all() and (z["y"] == M).all()
        la.saveNpz(path, {"x": la.loadNpzFile(path)["x"] * 2.0}, compress)
        assert (la.loadNpzFile(path)["x"].numpy() == x * 2).all()
        assert not list(tmp_path.glob("*.part"))
    np.savez_compressed(path, f=np.asfortranarray(M), big=M.astype(">f4"), text=np.array(["a"]), none=np.zeros((0, 3)), one=np.float32(2.5))
    with pytest.raises(TypeError):
        la.loadNpzFile(path)
    got = la.loadNpzFile(path, True)
    assert set(got) == {"f", "big", "none", "one"}
    assert (got["f"].numpy() == M).all() and (got["big"].numpy() == M.astype("f4")).all()
    assert got["none"].shape == (0, 3) and got["none"].numpy().size == 0 and got["one"].item() == 2.5
    np.savez(path, f=np.asfortranarray(M))
    stored = la.loadNpzFile(path)["f"]
    assert (stored.numpy() == M).all()
    with open(path, "r+b") as f:
        f.seek(200)
        f.write(b"12345678")
    with pytest.raises(Exception, match="Bad CRC"):
        la.loadNpzFile(path)
    with pytest.raises(Exception, match="has changed"):
        stored.numpy()


def test_text_stays_off_the_driver(spark, monkeypatch):
    """A text is written and parsed in the cluster; its characters come when they are asked for, and are the same."""
    from loomarray.sources.text import Text

    def never(self):
        raise AssertionError("whole on the driver")

    around = {"header": "one\ntwo", "footer": "end"}
    with monkeypatch.context() as m:
        m.setattr(Text, "data", property(never))
        assert (la.parseTxt(la.serializeTxt(M).encode()).numpy() == M).all()
        assert (la.parseTxt(la.serializeTxt(M, delimiter=",", newline="\r\n", **around).encode("utf8"), delimiter=",", skiprows=1, max_rows=2).numpy() == M[:2]).all()
        assert (la.genfromtxt(la.serializeTxt(M, comments="", header="a b c d").encode(), skip_header=1, skip_footer=1).numpy() == M[:-1]).all()
    expected = io.StringIO()
    np.savetxt(expected, M, fmt="%.3f", **around)
    text = la.serializeTxt(M, fmt="%.3f", **around)
    assert str(text) == expected.getvalue() and text == expected.getvalue() and text[:5] == "# one" and len(text) == len(expected.getvalue())
    assert text.encode() == expected.getvalue().encode() and bytes(text.encode()) == bytes(memoryview(text.encode()))
    assert text.encode("utf-16") == expected.getvalue().encode("utf-16") and text.upper().encode() == expected.getvalue().upper().encode()
    for odd in ({"newline": " "}, {"delimiter": "\n"}, {"newline": ""}):  # rows are not lines here
        text = la.serializeTxt(M, **odd)
        assert np.array_equal(la.parseTxt(text.encode(), ndmin=2).numpy(), la.parseTxt(bytes(text.encode()), ndmin=2).numpy(), equal_nan=True)
