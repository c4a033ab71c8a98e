"""Creation, sorting, sets, statistics and indexing against NumPy."""

import warnings

import numpy as np
from numpy_checks import A, Bb, Cc, D, Ii, N, R, S, Checks, arrays

from loomarray.cells import Array, local  # noqa: F401
from loomarray.operators import creation as c
from loomarray.operators import indexing as ix
from loomarray.operators import scans as s
from loomarray.operators import sorting as so

warnings.simplefilter("ignore")


def test_creation_sorting_indexing(spark):
    chk = Checks()
    a, nn, ii, cc, bb = arrays()
    d=local(D)
    sd=local(S)
    chk('cumprod i',lambda:s.cumprod(ii,axis=1),np.cumprod(Ii,1))
    chk('full',lambda:c.full((2,3),7),np.full((2,3),7))
    chk('arange',lambda:c.arange(2,11,3),np.arange(2,11,3))
    chk('arange f',lambda:c.arange(0,1,.3),np.arange(0,1,.3))
    chk('linspace',lambda:c.linspace(1,3,7),np.linspace(1,3,7))
    chk('logspace',lambda:c.logspace(0,2,5),np.logspace(0,2,5))
    chk('geom',lambda:c.geomspace(1,256,9),np.geomspace(1,256,9))
    chk('eye',lambda:c.eye(3,4,1),np.eye(3,4,1))
    chk('tri',lambda:c.tri(3,4,1),np.tri(3,4,1))
    chk('tril',lambda:c.tril(a,1),np.tril(A,1))
    chk('triu',lambda:c.triu(ii),np.triu(Ii))
    chk('diagflat',lambda:c.diagflat(ii,-1),np.diagflat(Ii,-1))
    chk('vander',lambda:c.vander([1.,2,3],4),np.vander([1.,2,3],4))
    chk('fromfunction',lambda:c.fromfunction(lambda i,j:i*2+j,(3,3)),np.fromfunction(lambda i,j:i*2+j,(3,3)))
    chk('meshgrid',lambda:c.meshgrid([1.,2,3],[4.,5]),list(np.meshgrid([1.,2,3],[4.,5])))
    chk('frombuffer',lambda:c.frombuffer(D.tobytes()),D)
    chk('indices',lambda:ix.indices((2,3)),np.indices((2,3)))
    chk('sort',lambda:so.sort(sd),np.sort(S))
    chk('sort0',lambda:so.sort(sd,0),np.sort(S,0))
    chk('sortN',lambda:so.sort(sd,None),np.sort(S,None))
    chk('argsort',lambda:so.argsort(sd),np.argsort(S,kind='stable'))
    chk('argsort1',lambda:so.argsort(d),np.argsort(D,kind='stable'))
    chk('lexsort',lambda:so.lexsort((np.arange(8.)[::-1].copy(),D)),np.lexsort((np.arange(8)[::-1],D)))
    chk('sort_complex',lambda:so.sort_complex(cc.reshaped((12,))),np.sort_complex(Cc.ravel()))
    chk('nonzero',lambda:so.nonzero(ii),list(np.nonzero(Ii)))
    chk('argwhere',lambda:so.argwhere(bb),np.argwhere(Bb))
    chk('flatnonzero',lambda:so.flatnonzero(ii),np.flatnonzero(Ii))
    chk('where',lambda:so.where(bb,a,0.),np.where(Bb,A,0.))
    chk('extract',lambda:so.extract(bb,a),np.extract(Bb,A))
    chk('compress',lambda:so.compress([True,False,True],ii,1),np.compress([True,False,True],Ii,1))
    chk('compressN',lambda:so.compress([True,False,True],ii),np.compress([True,False,True],Ii))
    for sdn in ('left','right'): chk(('ss',sdn),lambda:so.searchsorted(np.sort(D),[3,0,9,2.5,1],sdn),np.searchsorted(np.sort(D),[3,0,9,2.5,1],sdn))
    for rt in (False,True):
        chk(('dig',rt),lambda:so.digitize(d,[0,1,3.],rt),np.digitize(D,[0,1,3.],rt))
        chk(('digd',rt),lambda:so.digitize(d,[3,1,0.],rt),np.digitize(D,[3,1,0.],rt))
    chk('unique',lambda:so.unique(sd,True,True,True)[:1],[np.unique(S)])
    U_=np.unique(D,True,True,True)
    chk('unique all',lambda:so.unique(d,True,True,True),list(U_))
    chk('union',lambda:so.union1d(d,[9.,1]),np.union1d(D,[9.,1]))
    chk('inter',lambda:so.intersect1d(d,[9.,1,3]),np.intersect1d(D,[9.,1,3]))
    chk('setdiff',lambda:so.setdiff1d(d,[9.,1,3]),np.setdiff1d(D,[9.,1,3]))
    chk('xor',lambda:so.setxor1d(d,[9.,1,3]),np.setxor1d(D,[9.,1,3]))
    chk('isin',lambda:so.isin(sd,[1,np.nan,5.]),np.isin(S,[1,np.nan,5.]))
    chk('isin inv',lambda:so.isin(sd,[1,np.nan,5.],invert=True),np.isin(S,[1,np.nan,5.],invert=True))
    chk('trim',lambda:so.trim_zeros([0,0,1.,0,2,0]),np.trim_zeros(np.array([0,0,1.,0,2,0])))
    chk('bincount',lambda:so.bincount(np.array([0,1,1,3,2,1,7])),np.bincount([0,1,1,3,2,1,7]))
    chk('bincount w',lambda:so.bincount(np.array([0,1,1,3]),[.5,1,2,3.],6),np.bincount([0,1,1,3],[.5,1,2,3.],6))
    for b in (10,'auto','fd','doane','scott','rice','sturges','sqrt',[-2,-1,0,3.]): chk(('hist',b),lambda:list(so.histogram(R,b)),list(np.histogram(R,b)))
    chk('stone',lambda:so.histogram_bin_edges(R[:60],'stone'),np.histogram_bin_edges(R[:60],'stone'))
    chk('hist dens',lambda:list(so.histogram(R,7,density=True)),list(np.histogram(R,7,density=True)))
    chk('hist w',lambda:list(so.histogram(R,7,weights=np.abs(R))),list(np.histogram(R,7,weights=np.abs(R))))
    chk('hist2',lambda:so.histogram2d(R[:250],R[250:],[4,5])[0],np.histogram2d(R[:250],R[250:],[4,5])[0].astype(int))
    chk('histdd',lambda:so.histogramdd(R[:450].reshape(150,3),3)[0],np.histogramdd(R[:450].reshape(150,3),3)[0].astype(int))
    chk('cov',lambda:so.cov(np.array(A[0])),np.cov(A[0]))
    chk('corrcoef',lambda:so.corrcoef(R.reshape(5,100)),np.corrcoef(R.reshape(5,100)))
    for it in ((slice(None),1),(0,slice(None,None,-1)),(Ellipsis,slice(3,0,-2)),(None,1,slice(1,3)),(1,2,3),(slice(0,0),)): chk(('get',it),lambda:a[it],A[it])
    chk('slice str',lambda:a.slice('0:2','-1','::2'),A[0:2,-1,::2])
    chk('bool get',lambda:a[bb],A[Bb])
    chk('bool get1',lambda:a[np.array([True,False])],A[np.array([True,False])])
    chk('vindex',lambda:a[[0,1],:,[1,2]],A[[0,1],:,[1,2]])
    chk('vindex2',lambda:a[:,[0,2],[1,3]],A[:,[0,2],[1,3]])
    chk('vindex3',lambda:a[[1],[[0],[2]]],A[[1],[[0],[2]]])
    chk('take',lambda:ix.take(a,[[0,-1],[1,1]],1),np.take(A,[[0,-1],[1,1]],1))
    chk('takeN',lambda:ix.take(a,[3,30],mode='wrap'),np.take(A,[3,30],mode='wrap'))
    P=A.copy()
    np.put(P,[1,5,-1],[9.,8])
    chk('put',lambda:ix.put(a,[1,5,-1],[9.,8]),P)
    T_=np.argsort(A,axis=1)
    chk('taa',lambda:ix.take_along_axis(a,T_,1),np.take_along_axis(A,T_,1))
    P2=A.copy()
    np.put_along_axis(P2,T_[:,:1],99.,1)
    chk('paa',lambda:ix.put_along_axis(a,T_[:,:1],99.,1),P2)
    chk('choose',lambda:ix.choose(np.array([0,1,1,0]),[[1.,2,3,4],[5.,6,7,8]]),np.choose([0,1,1,0],[[1.,2,3,4],[5.,6,7,8]]))
    chk('select',lambda:ix.select([a>5,a>0],[a,a*2],-1.),np.select([A>5,A>0],[A,A*2],-1.))
    P3=A.copy()
    np.place(P3,Bb,[1,2,3.])
    chk('place',lambda:ix.place(a,bb,[1,2,3.]),P3)
    P4=A.copy()
    np.putmask(P4,Bb,[1,2,3.])
    chk('putmask',lambda:ix.putmask(a,bb,[1,2,3.]),P4)
    P5=np.zeros((3,4))
    np.fill_diagonal(P5,[1,2.])
    chk('filldiag',lambda:ix.fill_diagonal(c.zeros((3,4)),[1,2.]),P5)
    chk('rmi',lambda:ix.ravel_multi_index(([1,0],[2,1]),(3,4)),np.ravel_multi_index(([1,0],[2,1]),(3,4)))
    chk('ui',lambda:ix.unravel_index([5,11],(3,4)),list(np.unravel_index([5,11],(3,4))))
    chk('tril_i',lambda:ix.tril_indices(4,1,3),list(np.tril_indices(4,1,3)))
    chk('triu_i',lambda:ix.triu_indices(4),list(np.triu_indices(4)))
    chk('mask_i',lambda:ix.mask_indices(3,c.triu),list(np.mask_indices(3,np.triu)))
    chk('ix_',lambda:ix.ix_([0,2],[True,False,True]),list(np.ix_([0,2],[True,False,True])))
    chk('aeq',lambda:ix.array_equal(nn,nn,True),True)
    chk('aaa',lambda:ix.apply_along_axis(np.sort,1,a),np.apply_along_axis(np.sort,1,A))
    chk('aaa0',lambda:ix.apply_along_axis(np.sum,0,a),np.apply_along_axis(np.sum,0,A))
    chk.done()
