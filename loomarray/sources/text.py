"""Delimited and pattern text: Spark reads and parses the lines; only the first rows come to the driver."""

from __future__ import annotations

import re
from collections import UserString
from functools import cached_property

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomarray import dtypes as dt
from loomarray.cells import I, V, Array, asarray, numbered, session

#: Tokens that genfromtxt takes as missing.
MISSING = ("", "nan", "NaN", "NA", "N/A", "-")


def lines_of(source, encoding: str = "utf-8") -> DataFrame:
    """Lines with their order: of a path (a file, folder or pattern), or of text given as lines or bytes."""
    spark = session()
    if isinstance(source, Encoded):
        if (lines := source.text.lines) is not None:
            return lines
        source = bytes(source)
    if isinstance(source, (bytes, list, tuple)):
        text = source.decode(encoding).splitlines() if isinstance(source, bytes) else list(source)
        return spark.createDataFrame([(k, x) for k, x in enumerate(text)], "_k long, value string")
    return spark.read.text(source).withColumn("_k", F.monotonically_increasing_id())


def number(text: Column, d: np.dtype, missing=MISSING, filling=None) -> Column:
    """A token as a number; what can't be read is NaN (0 for whole numbers)."""
    t = F.trim(text)
    empty = filling if filling is not None else (np.nan if d.kind in "fc" else 0)
    if d.kind == "c":
        real = F.regexp_extract(t, r"^\(?([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)(?![\d.eE]*[jJ])", 1)
        imag = F.regexp_extract(t, r"([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)[jJ]\)?$", 1)
        return dt.cplx(F.coalesce(_double(real), F.lit(0.0)), F.coalesce(_double(imag), F.lit(0.0)), d)
    value = F.when(F.lower(t).isin("nan", "+nan", "-nan"), float("nan")).when(F.lower(t).isin("inf", "+inf", "infinity", "+infinity"), float("inf")).when(F.lower(t).isin("-inf", "-infinity"), float("-inf")).otherwise(_double(t))
    value = F.when(t.isin(*missing) | t.isNull(), F.lit(float(empty))).otherwise(value)
    return dt.cast(F.coalesce(value, F.lit(float(empty))), np.dtype("float64"), d)


def _double(t: Column) -> Column:
    return F.when(F.regexp_like(t, F.lit(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$")), t).otherwise(F.lit(None)).try_cast("double")


def _table(lines: DataFrame, split, d: np.dtype, usecols, ndmin: int, unpack: bool, skip: int, max_rows, convert) -> Array:
    rows, n = numbered(lines, "_k", name="_n")
    if skip or max_rows is not None:
        top = n if max_rows is None else min(n, skip + max_rows)
        rows, n = rows.where((F.col("_n") >= skip) & (F.col("_n") < top)).withColumn("_n", F.col("_n") - skip), max(0, top - skip)
    rows = rows.withColumn("_t", split(F.col("value")))
    low, high = rows.agg(F.min(F.size("_t")), F.max(F.size("_t"))).first()
    if low != high:
        raise ValueError("the number of columns changes from row to row")
    width = low or 0
    if usecols is not None:
        at = [c % width for c in np.atleast_1d(usecols).tolist()]
        rows, width = rows.withColumn("_t", F.array(*(F.get("_t", F.lit(c)) for c in at))), len(at)
    cells = rows.select("_n", F.posexplode("_t").alias("_c", "_x")).select((F.col("_n") * width + F.col("_c")).alias(I), convert(F.col("_x"), d).alias(V))
    out = Array.of(cells, (n, width), d)
    if width == 1 and ndmin < 2:
        out = out.reshaped((n,))
    elif n == 1 and ndmin < 2:
        out = out.reshaped((width,))
    if unpack and out.ndim > 1:
        from loomarray.operators.shape import transpose

        return transpose(out)
    return out


def _prepared(source, comments, skiprows: int) -> DataFrame:
    lines = lines_of(source)
    if skiprows:
        rows, _ = numbered(lines, "_k", name="_l")
        lines = rows.where(F.col("_l") >= skiprows)
    if comments:
        marks = [comments] if isinstance(comments, str) else list(comments)
        lines = lines.withColumn("value", F.regexp_replace("value", "(?:" + "|".join(map(re.escape, marks)) + ").*", ""))
    return lines.where(F.trim("value") != "")


def loadtxt(source, dtype=np.float64, comments="#", delimiter=None, skiprows: int = 0, usecols=None, unpack: bool = False, ndmin: int = 0, max_rows=None) -> Array:
    d = dt.dtype(dtype)
    split = (lambda v: F.split(F.trim(v), r"\s+")) if delimiter is None else (lambda v: F.split(v, re.escape(delimiter)))
    return _table(_prepared(source, comments, skiprows), split, d, usecols, ndmin, unpack, 0, max_rows, lambda x, t: number(x, t, ()))


def genfromtxt(source, dtype=np.float64, comments="#", delimiter=None, skip_header: int = 0, skip_footer: int = 0, missing_values=None, filling_values=None, usecols=None, unpack: bool = False, ndmin: int = 0, max_rows=None) -> Array:
    """As loadtxt, with missing tokens filled."""
    d = dt.dtype(dtype)
    missing = MISSING if missing_values is None else (*MISSING, *np.atleast_1d(missing_values).tolist())
    split = (lambda v: F.split(F.trim(v), r"\s+")) if delimiter is None else (lambda v: F.split(v, re.escape(delimiter)))
    lines = _prepared(source, comments, skip_header)
    if skip_footer:
        rows, n = numbered(lines, "_k", name="_f")
        lines = rows.where(F.col("_f") < n - skip_footer)
    return _table(lines, split, d, usecols, ndmin, unpack, 0, max_rows, lambda x, t: number(x, t, missing, filling_values))


def separated(source, d: np.dtype, count: int, sep: str) -> Array:
    """Values of a text with a separator (white space counts as one with any other), in order."""
    mark = sep.strip()
    tokens = F.split(F.col("value"), re.escape(mark) if mark else r"\s+")
    found = lines_of(source).select("_k", F.posexplode(tokens).alias("_j", "_x")).where(F.trim("_x") != "")
    rows, n = numbered(found, "_k", "_j", name="_n")
    kept = n if count < 0 else min(n, count)
    return Array.of(rows.where(F.col("_n") < kept).select(F.col("_n").alias(I), number(F.col("_x"), d).alias(V)), (kept,), d)


def fromregex(source, regexp: str, dtype=np.float64) -> Array:
    """A row for each match of a pattern, a column for each of its groups."""
    d = dt.dtype(dtype)
    groups = re.compile(regexp).groups
    found = lines_of(source).select("_k", F.posexplode(F.regexp_extract_all("value", F.lit(regexp), F.lit(0))).alias("_j", "_match"))
    rows, n = numbered(found, "_k", "_j", name="_n")
    width = max(1, groups)
    token = lambda g: F.regexp_extract("_match", regexp, g if groups else 0)
    cells = rows.select("_n", F.posexplode(F.array(*(token(g + 1) for g in range(width)))).alias("_c", "_x"))
    out = Array.of(cells.select((F.col("_n") * width + F.col("_c")).alias(I), number(F.col("_x"), d).alias(V)), (n, width), d)
    return out.reshaped((n,)) if width == 1 else out


def lines_for(a, fmt="%.18e", delimiter: str = " ") -> tuple[DataFrame, int]:
    """Lines (column value, ordered by _r) of a matrix."""
    a = asarray(a)
    a = a.reshaped((a.size, 1)) if a.ndim < 2 else a
    rows, width = a.shape
    form = fmt if isinstance(fmt, str) else list(fmt)
    d = a.dtype

    def cell(v, k):
        f = form if isinstance(form, str) else form[k]
        if d.kind == "c":
            return F.format_string("(" + f + "%s" + f + "j)", v["re"].cast("double"), F.when(v["im"] >= 0, "+").otherwise(""), v["im"].cast("double"))
        return F.format_string(f, v.cast("long") if f.rstrip()[-1] in "dixo" else v.cast("int").cast("double") if d.kind == "b" else v.cast("double"))

    cells = a.df.select(F.call_function("div", F.col(I), F.lit(width)).alias("_r"), (F.col(I) % width).alias("_c"), V)
    one = cell(F.col(V), 0) if isinstance(form, str) else None
    if one is None:
        one = F.lit(None).cast("string")
        for k in range(width):
            one = F.when(F.col("_c") == k, cell(F.col(V), k)).otherwise(one)
    df = cells.withColumn("_text", one).groupBy("_r").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_c", "_text"))), lambda s: s["_text"]), delimiter).alias("value"))
    return df, rows


class Text(UserString):
    """A string of lines that stay in the cluster until the driver asks for its characters (`data`).

    Encoded as UTF-8 and read as lines again, they don't pass through the driver.  What is made of it otherwise,
    as slices, is an ordinary string of its own.
    """

    _rows: DataFrame | None = None

    @classmethod
    def of(cls, rows: DataFrame, n: int, newline: str, head: str, foot: str, whole: bool) -> Text:
        """Of `n` rows (column value, ordered by _r), between `head` and `foot`; `whole`: no row has a line break in it."""
        out = cls.__new__(cls)
        out._rows, out._n, out._newline, out._head, out._foot, out._whole = rows, n, newline, head, foot, whole
        return out

    @cached_property
    def data(self) -> str:
        return self._head + "".join(r.value + self._newline for r in self._rows.orderBy("_r").toLocalIterator()) + self._foot

    @cached_property
    def lines(self) -> DataFrame | None:
        """Lines with their order, written once to the shared folder; none where rows are not lines."""
        if self._rows is None or not self._whole or self._newline.splitlines() != [""]:
            return None
        from loomarray.sources.npy import scratch

        spark = self._rows.sparkSession
        body, path = self._rows.select(F.col("_r").cast("long").alias("_k"), "value"), scratch(spark, "lines")
        body.write.mode("overwrite").parquet(path)
        lines = spark.read.schema(body.schema).parquet(path)
        head, foot = self._head.splitlines(), self._foot.splitlines()
        around = [*((k - len(head), x) for k, x in enumerate(head)), *((self._n + k, x) for k, x in enumerate(foot))]
        return lines.unionByName(spark.createDataFrame(around, "_k long, value string")) if around else lines

    def encode(self, encoding: str | None = "utf-8", errors: str | None = "strict"):
        utf8 = (encoding or "utf-8").lower().replace("_", "-") in ("utf-8", "utf8") and (errors or "strict") == "strict"
        return Encoded(self) if utf8 and self._rows is not None else super().encode(encoding, errors)


class Encoded:
    """A text's bytes, put together on the driver only where they are asked for: what takes a buffer takes them."""

    def __init__(self, text: Text):
        self.text = text

    @cached_property
    def data(self) -> bytes:
        return self.text.data.encode()

    def decode(self, encoding: str = "utf-8", errors: str = "strict"):
        return self.text if encoding.lower().replace("_", "-") in ("utf-8", "utf8") else self.data.decode(encoding, errors)

    def splitlines(self, keepends: bool = False) -> list[bytes]:
        return self.data.splitlines(keepends)

    def __bytes__(self) -> bytes:
        return self.data

    def __buffer__(self, flags: int) -> memoryview:
        return memoryview(self.data)

    def __len__(self) -> int:
        return len(self.data)

    def __getitem__(self, key):
        return self.data[key]

    def __add__(self, other) -> bytes:
        return self.data + bytes(other)

    def __eq__(self, other) -> bool:
        return self.data == (other.data if isinstance(other, Encoded) else other)

    def __hash__(self) -> int:
        return hash(self.data)


def to_text(a, fmt="%.18e", delimiter: str = " ", newline: str = "\n", header: str = "", footer: str = "", comments: str = "# ") -> Text:
    """All lines as one text, which comes to the driver when its characters are asked for."""
    rows, n = lines_for(a, fmt, delimiter)
    mark = lambda t: "".join(comments + x + newline for x in t.split("\n")) if t else ""
    whole = all(len(f"_{x}_".splitlines()) == 1 for x in ([fmt, delimiter] if isinstance(fmt, str) else [*fmt, delimiter]))
    return Text.of(rows, n, newline, mark(header), mark(footer), whole)


def savetxt(path: str, a, fmt="%.18e", delimiter: str = " ", newline: str = "\n", header: str = "", footer: str = "", comments: str = "# ") -> None:
    """One file, line after line."""
    from loomarray.sources.npy import store

    df, _ = lines_for(a, fmt, delimiter)
    system, p = store(path)
    mark = lambda t: "".join(comments + x + newline for x in t.split("\n")).encode() if t else b""
    with system.open_output_stream(p) as f:
        f.write(mark(header))
        for r in df.orderBy("_r").toLocalIterator():
            f.write((r.value + newline).encode())
        f.write(mark(footer))
