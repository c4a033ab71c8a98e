"""Linear algebra, polynomials, FFT, random arrays and text forms against NumPy."""

import warnings

import numpy as np
from numpy_checks import A, Cc, Ii, M, R, Checks, arrays

from loomarray.cells import Array, local  # noqa: F401
from loomarray.operators import fft as ff
from loomarray.operators import formatting as fo
from loomarray.operators import linalg as l
from loomarray.operators import polynomials as p
from loomarray.operators import random as rn
from loomarray.operators import shape as h
from loomarray.operators import sorting as so

warnings.simplefilter("ignore")


def test_linalg_fft_random(spark):
    chk = Checks()
    a, nn, ii, cc, bb = arrays()
    m=local(M)
    St=np.stack([M,M+np.eye(3)])
    stt=local(St)
    chk('cov',lambda:so.cov(np.array(A[0])),np.cov(A[0]))
    chk('corrcoef',lambda:so.corrcoef(R.reshape(5,100)),np.corrcoef(R.reshape(5,100)))
    chk('matmul',lambda:l.matmul(m,stt),M@St)
    chk('dot',lambda:l.dot(a,np.ones((4,2))),np.dot(A,np.ones((4,2))))
    chk('dot1',lambda:l.dot([1.,2],[3.,4]),np.dot([1.,2],[3.,4]))
    chk('inner',lambda:l.inner(a,np.ones((2,4))),np.inner(A,np.ones((2,4))))
    chk('outer',lambda:l.outer([1.,2],[3.,4,5]),np.outer([1.,2],[3.,4,5]))
    chk('vdot',lambda:l.vdot(cc,cc),np.vdot(Cc,Cc))
    chk('vecdot',lambda:l.vecdot(cc,cc),np.vecdot(Cc,Cc))
    chk('matvec',lambda:l.matvec(stt,[1.,2,3]),np.matvec(St,[1.,2,3]))
    chk('vecmat',lambda:l.vecmat([1.,2,3],stt),np.vecmat([1.,2,3],St))
    chk('tensordot',lambda:l.tensordot(a,a,([0,1],[0,1])),np.tensordot(A,A,([0,1],[0,1])))
    chk('einsum',lambda:l.einsum('ijk,ilk->jl',a,a),np.einsum('ijk,ilk->jl',A,A))
    chk('einsum tr',lambda:l.einsum('ii->i',m),np.einsum('ii->i',M))
    chk('einsum3',lambda:l.einsum('ij,jk,kl->il',m,m,m),np.einsum('ij,jk,kl->il',M,M,M))
    chk('einsum imp',lambda:l.einsum('ij,jk',m,m),np.einsum('ij,jk',M,M))
    chk('kron',lambda:l.kron(m,[[1.,2]]),np.kron(M,[[1.,2]]))
    chk('cross',lambda:l.cross(M,M[::-1].copy()),np.cross(M,M[::-1]))
    chk('trace',lambda:l.trace(a),np.trace(A))
    chk('diagonal',lambda:l.diagonal(a,1,1,2),np.diagonal(A,1,1,2))
    chk('matmul int',lambda:l.matmul(ii,ii.T),Ii@Ii.T)
    for f in ('det','inv','pinv','eigvalsh','svdvals','cond','matrix_rank','cholesky'): chk(f,lambda:getattr(l,f)(stt),getattr(np.linalg,f)(St))
    chk('slogdet',lambda:list(l.slogdet(stt)),list(np.linalg.slogdet(St)))
    chk('solve',lambda:l.solve(stt,np.ones((3,2))),np.linalg.solve(St,np.ones((3,2))))
    chk('solve v',lambda:l.solve(m,[1.,2,3]),np.linalg.solve(M,[1.,2,3]))
    chk('lstsq',lambda:l.lstsq(R[:20].reshape(10,2),R[20:30])[0],np.linalg.lstsq(R[:20].reshape(10,2),R[20:30])[0])
    chk('qr',lambda:[x for x in [l.matmul(*l.qr(R[:20].reshape(10,2)))]],[R[:20].reshape(10,2)])
    chk('eigh',lambda:l.eigh(m)[0],np.linalg.eigh(M)[0])
    chk('eig',lambda:so.sort(l.eig(m)[0]),np.sort(np.linalg.eig(M)[0]))
    chk('eigc',lambda:l.eigvals([[0.,1],[-1,0]]),np.linalg.eigvals([[0.,1],[-1,0]]))
    chk('svd',lambda:l.svd(m)[1],np.linalg.svd(M)[1])
    chk('mpow',lambda:l.matrix_power(m,5),np.linalg.matrix_power(M,5))
    chk('mpow-',lambda:l.matrix_power(m,-2),np.linalg.matrix_power(M,-2))
    chk('multi_dot',lambda:l.multi_dot([m,M[:,:2].copy(),np.ones(2)]),np.linalg.multi_dot([M,M[:,:2],np.ones(2)]))
    for o in (None,'fro',1,-1,2,-2,np.inf,'nuc'): chk(('norm',o),lambda:l.norm(m,o),np.linalg.norm(M,o))
    for o in (1,2,3,np.inf,0): chk(('vnorm',o),lambda:l.norm(a,o,axis=1),np.linalg.norm(A,o,axis=1))
    T4=np.random.default_rng(1).normal(size=(2,3,6))
    chk('tensorsolve',lambda:l.tensorsolve(T4,np.ones((2,3))),np.linalg.tensorsolve(T4,np.ones((2,3))))
    chk('tensorinv',lambda:l.tensorinv(T4),np.linalg.tensorinv(T4))
    chk('polyval',lambda:p.polyval([1,2.,3],a),np.polyval([1,2.,3],A))
    chk('polyfit',lambda:p.polyfit(np.arange(10.),R[:10],3),np.polyfit(np.arange(10.),R[:10],3))
    chk('roots',lambda:p.roots([1,-6,11,-6.]),np.roots([1,-6,11,-6.]))
    chk('polymul',lambda:p.polymul([1,2.],[3.,4]),np.polymul([1,2.],[3.,4]))
    chk('polydiv',lambda:list(p.polydiv([1,2.,3],[1.,4])),list(np.polydiv([1,2.,3],[1.,4])))
    for f in ('fft','ifft','rfft','irfft','hfft','ihfft','fft2','ifft2','fftn','ifftn','rfft2','irfft2','rfftn','irfftn'):
        src,S=(cc,Cc) if f in('irfft','hfft','irfft2','irfftn','ifft','ifft2','ifftn') else (a,A)
        chk(f,lambda:getattr(ff,f)(src),getattr(np.fft,f)(S))
    chk('fft n',lambda:ff.fft(a,6,1,'ortho'),np.fft.fft(A,6,1,'ortho'))
    chk('fft s',lambda:ff.fft(a,2,1),np.fft.fft(A,2,1))
    chk('fftfreq',lambda:ff.fftfreq(7,.5),np.fft.fftfreq(7,.5))
    chk('rfftfreq',lambda:ff.rfftfreq(8),np.fft.rfftfreq(8))
    chk('shift',lambda:ff.fftshift(a),np.fft.fftshift(A))
    chk('ishift',lambda:ff.ifftshift(a),np.fft.ifftshift(A))
    old_long, ff.LONG = ff.LONG, 8
    chk('4step',lambda:ff.fft(R[:60]),np.fft.fft(R[:60]))
    chk('4stepi',lambda:ff.ifft(R[:60]),np.fft.ifft(R[:60]))
    rn.seed(5)
    x=np.random.RandomState(5)
    chk('rand',lambda:rn.rand(3,2),x.rand(3,2))
    chk('normal',lambda:rn.normal(1,2,size=4),x.normal(1,2,4))
    chk('randint',lambda:rn.randint(0,9,5),x.randint(0,9,5))
    g=rn.default_rng(3)
    y=np.random.default_rng(3)
    chk('rng',lambda:g.random(5),y.random(5))
    chk('rng int',lambda:g.integers(0,9,6),y.integers(0,9,6))
    chk('perm',lambda:g.permutation(6),y.permutation(6))
    chk('choice',lambda:g.choice(10,4),y.choice(10,4))
    ff.LONG = old_long
    old_block, rn.BLOCK = rn.BLOCK, 1000
    chk('big',lambda:np.abs(g.normal(size=5000).numpy().mean())<.1,True)
    chk('big perm',lambda:np.sort(g.permutation(3000).numpy()),np.arange(3000))
    chk('big same',lambda:rn.default_rng(1).gamma(2.,size=3000),rn.default_rng(1).gamma(2.,size=3000).numpy())
    chk('dirichlet',lambda:g.dirichlet([1.,2,3],2000).numpy().sum(1),np.ones(2000))
    chk('repr',lambda:fo.array_repr(m)==repr(M),True)
    chk('long repr',lambda:fo.array_repr(local(np.arange(5000.).reshape(50,100)))==repr(np.arange(5000.).reshape(50,100)),True)
    chk('str',lambda:fo.array2string(ii)==np.array2string(Ii),True)

    rn.BLOCK = old_block
    chk.done()


def test_vectors_of_a_table_are_blocks(spark):
    """Rows that are there already, of any length up to the width, and rows that are not; packed and unpacked agree."""
    from loomarray.cells import from_vectors
    from loomarray.operators import dense

    rng = np.random.default_rng(8)
    rows = {k: rng.normal(size=12).tolist() for k in range(40) if k not in (3, 17)}
    rows[5], rows[6] = rows[5][:7], None
    df = spark.createDataFrame(list(rows.items()), "k long, x array<double>").repartition(3)
    a = from_vectors(df, "k", "x", 12)
    expected = np.zeros((40, 12))
    for k, x in rows.items():
        expected[k, : len(x or [])] = x or []
    assert a._vectors is not None
    chk = Checks()
    chk("cells", lambda: a, expected)
    chk("rows", lambda: dense.along(a, 1, np.cumsum, 12, np.float64), np.cumsum(expected, 1))
    chk("mapped", lambda: dense.along(a * 2.0, 1, np.cumsum, 12, np.float64), np.cumsum(expected * 2, 1))
    chk("parts of rows", lambda: dense.along(a.reshaped((40, 4, 3)), 2, np.sort, 3, np.float64), np.sort(expected.reshape(40, 4, 3)))
    chk("across rows", lambda: dense.along(a, 0, np.cumsum, 40, np.float64), np.cumsum(expected, 0))
    chk("wider than rows", lambda: dense.along(a.reshaped((20, 24)), 1, np.cumsum, 24, np.float64), np.cumsum(expected.reshape(20, 24), 1))
    chk("complex", lambda: dense.along(a.astype(np.complex128), 1, np.fft.fft, 12, np.complex128), np.fft.fft(expected))
    m = np.array([[2.0, 1.0], [1.0, 3.0]]) + np.arange(30)[:, None, None]
    chk("two results", lambda: l.eigh(local(m))[0], np.linalg.eigh(m)[0])
    chk("long", lambda: dense.along(local(rng.permutation(3000.0 * np.ones(3000)).reshape(2, 1500)), 1, np.cumsum, 1500, np.float64), np.cumsum(3000.0 * np.ones((2, 1500)), 1))
    chk.done()
    plan = dense.along(a, 1, np.cumsum, 12, np.float64).df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan.replace("Exchange RoundRobin", "")


def test_contractions_in_a_cheap_order(spark, monkeypatch):
    """Any operands and labels, by blocks and by joins, against NumPy; the order is the one that costs least."""
    from loomarray.operators import linalg

    rng = np.random.default_rng(2)
    size = dict(zip("abcdefi", (3, 4, 2, 5, 3, 6, 2), strict=True))
    cases = ("ab,bc,cd->ad", "ab,cb,cd->ad", "ab,bc,cd,de->ae", "abc,bcd->ad", "abc,dcb->da", "ab,ab,bc->c", "ab,bc->", "a,b,c->abc", "aab,bc,c->a", "ab,cd,bd->ac", "abi,bci,cd->adi", "ab,b,a->", "abc->ca", "ab,bc")
    chk = Checks()
    for most in (1, 1 << 40):
        monkeypatch.setattr(linalg, "BY_BLOCKS", most)
        for case in cases:
            terms = case.split("->")[0].split(",")
            xs = [rng.normal(size=[size[c] for c in t]) if len(set(t)) == len(t) else rng.normal(size=(3, 3, 4)) for t in terms]
            chk((case, most), lambda: linalg.einsum(case, *map(local, xs)), np.einsum(case, *xs))
        z = [rng.integers(-9, 9, (5, 4)) + 1j, rng.integers(-9, 9, (4, 6))]
        chk(("complex", most), lambda: linalg.einsum("ab,bc->ca", *map(local, z)), np.einsum("ab,bc->ca", *z))
        chk(("stretched", most), lambda: linalg.einsum("ab,ab,bc->ac", local(np.ones((3, 1))), local(np.ones((3, 4))), local(np.ones((4, 2)))), np.full((3, 2), 4.0))
    chk.done()
    assert linalg.contraction_order(["ij", "kj", "kl"], "il", {"i": 2000, "j": 64, "k": 2000, "l": 64}) == [(1, 2), (0, 1)]
