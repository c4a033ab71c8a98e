"""Reductions, scans and shapes against NumPy."""

import warnings

import numpy as np
from numpy_checks import A, Bb, Cc, Ii, N, Checks, arrays

from loomarray.cells import Array, local  # noqa: F401
from loomarray.operators import reductions as r
from loomarray.operators import scans as s
from loomarray.operators import shape as h
from loomarray.operators import ufuncs as u

warnings.simplefilter("ignore")


def test_reductions_scans_shapes(spark):
    chk = Checks()
    a, nn, ii, cc, bb = arrays()
    for f in ('sum','prod','mean','max','min','ptp','argmax','argmin','var','std','median','all','any','count_nonzero','nansum','nanprod','nanmean','nanvar','nanstd','nanmax','nanmin','nanargmax','nanargmin','nanmedian'):
        for ax in (None,0,-1):
            chk((f,ax),lambda:getattr(r,f)(a,axis=ax),lambda:getattr(np,f)(A,axis=ax))
            chk((f,ax,'nan'),lambda:getattr(r,f)(nn,axis=ax),lambda:getattr(np,f)(N,axis=ax))
        chk((f,'int'),lambda:getattr(r,f)(ii,axis=1),lambda:getattr(np,f)(Ii,axis=1))
        if f not in ('ptp','median','nanmedian'): chk((f,'c'),lambda:getattr(r,f)(cc,axis=1),lambda:getattr(np,f)(Cc,axis=1))
    chk('sum tuple',lambda:r.sum(a,axis=(0,2),keepdims=True),A.sum((0,2),keepdims=True))
    chk('sum where',lambda:r.sum(a,axis=1,where=bb,initial=2),A.sum(1,where=Bb,initial=2))
    chk('max where',lambda:r.max(a,axis=1,where=bb,initial=-100),A.max(1,where=Bb,initial=-100))
    chk('quantile',lambda:r.quantile(a,[.1,.5,.77],axis=1),np.quantile(A,[.1,.5,.77],axis=1))
    chk('percentile',lambda:r.percentile(a,30),np.percentile(A,30))
    chk('nanquantile',lambda:r.nanquantile(nn,[.2,.6],axis=0),np.nanquantile(N,[.2,.6],axis=0))
    chk('nanpercentile',lambda:r.nanpercentile(nn,20),np.nanpercentile(N,20))
    r.GATHERED=4
    chk('quantile sorted',lambda:r.quantile(a,[.1,.5]),np.quantile(A,[.1,.5]));
    chk('average',lambda:r.average(a,axis=1,weights=[1,2,3.]),np.average(A,axis=1,weights=[1,2,3.]))
    chk('aoa',lambda:r.apply_over_axes(r.sum,a,[0,2]),np.apply_over_axes(np.sum,A,[0,2]))
    for ax in (None,0,1,2):
        for f in ('cumsum','cumprod'): chk((f,ax),lambda:getattr(s,f)(a,axis=ax),getattr(np,f)(A,axis=ax))
    chk('cumsum chunk',lambda:s.cumsum(a,chunk=3),np.cumsum(A))
    chk('cumprod chunk',lambda:s.cumprod(a,chunk=5),np.cumprod(A))
    chk('cumsum c',lambda:s.cumsum(cc,axis=0),np.cumsum(Cc,0))
    chk('cumprod i',lambda:s.cumprod(ii,axis=1),np.cumprod(Ii,1))
    chk('nancumsum',lambda:s.nancumsum(nn),np.nancumsum(N))
    chk('nancumprod',lambda:s.nancumprod(nn,axis=1),np.nancumprod(N,1))
    chk('diff',lambda:s.diff(a,axis=1),np.diff(A,axis=1))
    chk('diff2',lambda:s.diff(a,2),np.diff(A,2))
    chk('diff b',lambda:s.diff(bb),np.diff(Bb))
    chk('ediff1d',lambda:s.ediff1d(a,to_end=[9.],to_begin=1.),np.ediff1d(A,to_end=[9.],to_begin=1.))
    old=s.CHUNK
    s.shifted.__defaults__=(3,)
    chk('diff chunk',lambda:s.diff(h.ravel_(a)),np.diff(A.ravel()))
    chk('grad chunk',lambda:s.gradient(h.ravel_(a)),np.gradient(A.ravel()))
    s.shifted.__defaults__=(old,)
    chk('gradient',lambda:s.gradient(a),np.gradient(A))
    chk('gradient x',lambda:s.gradient(a,np.array([0,1,3.,3.5]),axis=2),np.gradient(A,np.array([0,1,3.,3.5]),axis=2))
    chk('trap',lambda:s.trapezoid(a,axis=1),np.trapezoid(A,axis=1))
    chk('trap x',lambda:s.trapezoid(a,x=[0,1,3.,3.5]),np.trapezoid(A,x=[0,1,3.,3.5]))
    x=np.array([1,2,-3,4.5,2])
    y=np.array([0.5,-1,2.])
    for m in ('full','same','valid'):
        chk(('conv',m),lambda:s.convolve(x,y,m),np.convolve(x,y,m))
        chk(('corr',m),lambda:s.correlate(x,y,m),np.correlate(x,y,m))
        chk(('corr swap',m),lambda:s.correlate(y,x,m),np.correlate(y,x,m))
        chk(('conv swap',m),lambda:s.convolve(y,x,m),np.convolve(y,x,m))
    chk('unwrap',lambda:u.unwrap(np.array([0,1,3.,7.,6.,-2,0.5])),np.unwrap(np.array([0,1,3.,7.,6.,-2,0.5])))
    chk('interp',lambda:u.interp([-1,0,.5,1,2.2,3,9.],[0,1,2,3.],[1,4,2,8.]),np.interp([-1,0,.5,1,2.2,3,9.],[0,1,2,3.],[1,4,2,8.]))
    chk('packbits',lambda:u.packbits(bb,axis=1),np.packbits(Bb,axis=1))
    chk('unpack',lambda:u.unpackbits(np.array([[3,250],[7,1]],np.uint8),axis=1,count=13),np.unpackbits(np.array([[3,250],[7,1]],np.uint8),axis=1,count=13))
    chk('clip',lambda:u.clip(a,-1,5),np.clip(A,-1,5))
    chk('nan_to_num',lambda:u.nan_to_num(nn),np.nan_to_num(N))
    chk('around',lambda:u.around(a,-1),np.around(A,-1))
    chk('frexp',lambda:u.frexp(a),np.frexp(A))
    chk('modf',lambda:u.modf(a),np.modf(A))
    chk('divmod',lambda:u.divmod(a,3.),np.divmod(A,3.))
    chk('isclose',lambda:u.isclose(a,a+1e-9),np.isclose(A,A+1e-9))
    chk('bcast',lambda:a*np.array([[1.],[2],[3]])+np.array([1,2,3,4.]),A*np.array([[1.],[2],[3]])+np.array([1,2,3,4.]))
    chk('bcast2',lambda:local(np.arange(3.).reshape(3,1))+local(np.arange(4.).reshape(1,4)),np.arange(3.).reshape(3,1)+np.arange(4.))
    chk('same frame',lambda:(a+1)*(a-2),(A+1)*(A-2))
    chk('transpose',lambda:h.transpose(a),A.T)
    chk('swap',lambda:h.swapaxes(a,0,2),A.swapaxes(0,2))
    chk('moveaxis',lambda:h.moveaxis(a,0,-1),np.moveaxis(A,0,-1))
    chk('rollaxis',lambda:h.rollaxis(a,2),np.rollaxis(A,2))
    chk('concat',lambda:h.concatenate([a,a+1],1),np.concatenate([A,A+1],1))
    chk('stack',lambda:h.stack([a,a],-1),np.stack([A,A],-1))
    chk('hstack',lambda:h.hstack([a,a]),np.hstack([A,A]))
    chk('dstack',lambda:h.dstack([ii,ii]),np.dstack([Ii,Ii]))
    chk('colstack',lambda:h.column_stack([np.arange(3.),np.ones((3,2))]),np.column_stack([np.arange(3.),np.ones((3,2))]))
    chk('block',lambda:h.block([[np.ones((2,2)),np.zeros((2,1))],[np.ones((1,3))]]),np.block([[np.ones((2,2)),np.zeros((2,1))],[np.ones((1,3))]]))
    chk('array_split',lambda:h.array_split(a,3,axis=2),np.array_split(A,3,axis=2))
    chk('split',lambda:h.split(a,[1,2],axis=1),np.split(A,[1,2],axis=1))
    chk('unstack',lambda:h.unstack(a,1),[A[:,k] for k in range(3)])
    chk('tile',lambda:h.tile(ii,(2,1,2)),np.tile(Ii,(2,1,2)))
    chk('repeat',lambda:h.repeat(ii,2,axis=1),np.repeat(Ii,2,axis=1))
    chk('repeat l',lambda:h.repeat(ii,[0,2,1],axis=1),np.repeat(Ii,[0,2,1],axis=1))
    chk('flip',lambda:h.flip(a,(0,2)),np.flip(A,(0,2)))
    chk('rot90',lambda:h.rot90(ii,3),np.rot90(Ii,3))
    chk('roll',lambda:h.roll(a,(1,-2),(0,2)),np.roll(A,(1,-2),(0,2)))
    chk('roll n',lambda:h.roll(a,5),np.roll(A,5))
    chk('resize',lambda:h.resize(ii,(4,4)),np.resize(Ii,(4,4)))
    chk('append',lambda:h.append(ii,[[1,2,3]],0),np.append(Ii,[[1.,2,3]],0))
    chk('delete',lambda:h.delete(a,[0,2],2),np.delete(A,[0,2],2))
    chk('insert',lambda:h.insert(ii,[1,1,2],5,axis=1),np.insert(Ii,[1,1,2],5,axis=1))
    chk('insert s',lambda:h.insert(ii,1,[8,9],axis=1),np.insert(Ii,1,[8,9],axis=1))
    chk('bto',lambda:h.broadcast_to(ii,(2,2,3)),np.broadcast_to(Ii,(2,2,3)))
    for m in ('constant','edge','linear_ramp','maximum','mean','median','minimum','reflect','symmetric','wrap'): chk(('pad',m),lambda:h.pad(a,((1,0),(2,1),(0,3)) if m!='reflect' else ((1,0),(2,1),(0,3)),m),np.pad(A,((1,0),(2,1),(0,3)),m))
    chk.done()


def test_quantiles_of_infinite_values(spark, monkeypatch):
    """One rule on both sides of the size from which quantiles go by ranges."""
    chk = Checks()
    for values in ([1.0, np.inf, np.inf, np.inf, 2.0], [-np.inf, 3.0, 4.0, -np.inf], [np.inf] * 4, [1.0, 2.0, np.nan], [5.0]):
        x = np.array(values)
        for size in (1 << 18, 0):
            monkeypatch.setattr(r, "GATHERED", size)
            chk((values, size), lambda: r.median(local(x)), np.median(x))
            chk((values, size, "q"), lambda: r.quantile(local(x), 0.5), np.median(x))
    chk.done()


def test_long_median_with_inf(spark):
    from loomarray.cells import generated
    from pyspark.sql import functions as F

    a = generated((400_001,), np.float64, lambda i: F.when(i % 4 == 0, i.cast("double")).otherwise(float("inf")))
    assert r.median(a).item() == np.inf


def test_nulls_of_a_column(spark):
    from loomarray.cells import from_column, from_columns
    from loomarray.operators import sorting as so

    df = spark.createDataFrame([(k, None if k % 3 else float(k), k if k != 4 else None, k) for k in range(10)], "k long, x double, n long, m long")
    x = from_column(df, "x", ["k"])
    expected = np.array([np.nan if k % 3 else float(k) for k in range(10)])
    assert np.array_equal(x.numpy(), expected, equal_nan=True)
    assert np.array_equal(so.sort(x).numpy(), np.sort(expected), equal_nan=True)
    assert np.isnan(r.sum(x).item()) and r.nansum(x).item() == np.nansum(expected)
    assert from_column(df, "m", ["k"]).numpy().tolist() == list(range(10))
    for make in (lambda: from_column(df, "n", ["k"]), lambda: from_columns(df, ["x", "n"], ["k"])):
        try:
            make()
        except ValueError as problem:
            assert "null" in str(problem)
        else:
            raise AssertionError("a null among whole numbers is no value")
    assert np.isnan(r.median(from_column(df.where("k > 99"), "x", ["k"])).item())


def test_frames_go_with_their_arrays(spark):
    import gc

    from loomarray.operators import linalg

    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    w, v = linalg.eigh(local(np.array([[[2.0, 1.0], [1.0, 3.0]]] * 3)))
    assert w.numpy().shape == (3, 2) and v.numpy().shape == (3, 2, 2)
    assert spark.sparkContext._jsc.getPersistentRDDs().size() > before
    del w, v
    gc.collect()
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before
