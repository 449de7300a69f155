"""The four click models: how a page's clicks follow from attractiveness and examination.

PBM and UBM posteriors depend on one impression at a time, so training pages are first counted by
(query, document, examination cell, click): each EM round then reads that table, whose size is
that of the distinct cases, and never the log again.  CCM and DBN couple the ranks of a
page: their statistics are the dictionary of page lists with the numbers of its click patterns, and rounds work on blocks of
[cases, 10] numbers in NumPy, since their recursions nest two deep over ranks.  A block adds up its posteriors by query and
document before rows leave it.

In PBM and UBM a pair has at most two cases a cell (20, 110 or 200), so ``fit`` keeps them as arrays beside the pair's own parameter: a round
then maps each row to its new parameter, without a join or a shuffle, and each task adds one share for every cell that it met.

Parameters are a table (kind, query_id, doc_id, num, den): ``ATTRACT`` and ``SATISFY`` by query and document,
``PUBLIC`` with the cell's number in doc_id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickloom.config import RANKS
from clickloom.functions.clicks import CEILING, previous_clicks, slot, value
from clickloom.operators.lists import ATTRACT, PUBLIC, SATISFY, ListBlock, list_values, page_lists

PRIOR_NUM, PRIOR_DEN = 1.0, 2.0
THETA = "kind int, query_id int, doc_id int, num double, den double"
CARRIED = THETA + ", cells array<int>, n array<long>, n_cell array<long>"


class ClickModel:
    """Base of the models.  ``public`` is the number of public cells, ``kinds`` the private tables."""

    name = ""
    public_name = "examination"
    public = RANKS
    kinds = (ATTRACT,)
    carries = False  # whether rounds map a table of pairs that hold their cases

    def statistics(self, train: DataFrame) -> DataFrame:
        """What EM rounds read: the distinct cases of the training pages and their numbers."""
        raise NotImplementedError

    def posteriors(self, statistics: DataFrame, theta: DataFrame, public: list[float]) -> DataFrame:
        """E-step: (kind, query_id, doc_id, num, den) to be summed."""
        raise NotImplementedError

    def conditional(self, a: np.ndarray, s: np.ndarray, c: np.ndarray, g: np.ndarray) -> np.ndarray:
        """P(click flag | flags above) for [pages, 10] attractiveness, satisfaction and clicks; g holds public values."""
        raise NotImplementedError

    def full(self, a: np.ndarray, s: np.ndarray, c: np.ndarray, g: np.ndarray) -> np.ndarray:
        """P(click flag) without knowing other clicks."""
        raise NotImplementedError


def block(column: pa.Array, kind=float) -> np.ndarray:
    """An array column of ten numbers a row as [rows, 10]."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, RANKS)


def ranks(values: np.ndarray) -> pa.Array:
    """[rows, 10] as an array column."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * RANKS), pa.array(np.ascontiguousarray(values).ravel()))


class _Separable(ClickModel):
    """PBM and UBM: a click is attraction times examination of the cell."""

    carries = True

    def cells(self) -> Column:
        raise NotImplementedError

    def statistics(self, train: DataFrame) -> DataFrame:
        cases = self._cases(train)
        return cases.groupBy("query_id", "doc_id", "cell", "click").agg(F.count("*").alias("n"), F.sum("counts").alias("n_cell"))

    def _cases(self, train: DataFrame) -> DataFrame:
        rows = train.select("query_id", F.explode(F.arrays_zip("docs", "clicks", self.cells().alias("cells"))).alias("x"))
        return rows.select("query_id", F.col("x.docs").alias("doc_id"), F.col("x.cells").alias("cell"), F.col("x.clicks").alias("click"), F.lit(1).alias("counts"))

    def posteriors(self, statistics: DataFrame, theta: DataFrame, public: list[float]) -> DataFrame:
        known = theta.where(F.col("kind") == ATTRACT).select("query_id", "doc_id", value(F.col("num"), F.col("den")).alias("a"))
        g = F.get(F.array(*map(F.lit, public)), F.col("cell"))
        rows = statistics.join(known, ["query_id", "doc_id"], "left").select("*", F.coalesce("a", F.lit(0.5)).alias("x"), g.alias("g"))
        hit, miss = F.col("click") == 1, 1 - F.col("x") * F.col("g")
        of = lambda own: F.when(hit, 1.0).otherwise((own - F.col("x") * F.col("g")) / miss)
        entry = lambda kind, q, d, num, n: F.struct(
            F.lit(kind).alias("kind"), q.alias("query_id"), d.alias("doc_id"), (num * n).alias("num"), n.cast("double").alias("den")
        )
        private = entry(ATTRACT, F.col("query_id"), F.col("doc_id"), of(F.col("x")), F.col("n"))
        shared = entry(PUBLIC, F.lit(None).cast("int"), F.col("cell"), of(F.col("g")), F.col("n_cell"))
        return rows.select(F.explode(F.array(private, shared)).alias("p")).select("p.*")

    def carried(self, statistics: DataFrame, start: DataFrame | None = None) -> DataFrame:
        """A row for each pair: its parameter, that of ``start`` or the prior, and its cases, where ``cells`` holds twice the cell and the click."""
        code = (2 * F.col("cell") + F.col("click")).cast("int").alias("cells")
        pairs = statistics.groupBy("query_id", "doc_id").agg(F.collect_list(F.struct(code, "n", "n_cell")).alias("x"))
        if start is None:
            pairs = pairs.select("*", F.lit(PRIOR_NUM).alias("num"), F.lit(PRIOR_DEN).alias("den"))
        else:
            known = start.where(F.col("kind") == ATTRACT).select("query_id", "doc_id", "num", "den")
            pairs = pairs.join(known, ["query_id", "doc_id"], "left").na.fill({"num": PRIOR_NUM, "den": PRIOR_DEN})
        return pairs.select(F.lit(ATTRACT).alias("kind"), "query_id", "doc_id", "num", "den", "x.cells", "x.n", "x.n_cell")

    def advance(self, carried: DataFrame, public: list[float]) -> DataFrame:
        """E-step over ``carried``: the posteriors of each pair, summed, with its cases; and shares of the public cells, without cases, one a task and cell."""
        g = np.array(public)

        def e_step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            shares, schema = np.zeros((2, len(g))), None
            for batch in batches:
                schema, batch = batch.schema, batch.filter(pc.equal(batch["kind"], ATTRACT))
                code, n, n_cell = (batch[c].flatten().to_numpy(zero_copy_only=False) for c in ("cells", "n", "n_cell"))
                own = np.repeat(np.arange(batch.num_rows), pc.list_value_length(batch["cells"]).to_numpy(zero_copy_only=False))
                cell, hit = code >> 1, code & 1 == 1
                num, den = batch["num"].to_numpy(), batch["den"].to_numpy()
                a = np.fmin(np.divide(num, den, out=np.full_like(num, CEILING), where=den != 0), CEILING)[own]
                both = a * g[cell]
                of = lambda x: np.where(hit, 1.0, (x - both) / (1 - both))
                total = lambda at, x, size: np.bincount(at, weights=x, minlength=size)
                shares += total(cell, of(g[cell]) * n_cell, len(g)), total(cell, n_cell, len(g))
                sums = {"num": total(own, of(a) * n, batch.num_rows), "den": total(own, n, batch.num_rows)}
                yield pa.RecordBatch.from_arrays([pa.array(sums[f.name]) if f.name in sums else batch[f.name] for f in schema], names=schema.names)
            met = np.flatnonzero(shares[1])
            if len(met):
                cells = {"kind": np.full(len(met), PUBLIC, np.int32), "doc_id": met.astype(np.int32), "num": shares[0, met], "den": shares[1, met]}
                yield pa.RecordBatch.from_arrays([pa.array(cells[f.name]) if f.name in cells else pa.nulls(len(met), f.type) for f in schema], names=schema.names)

        return carried.mapInArrow(e_step, CARRIED)


class PBM(_Separable):
    """Position-based model: examination by rank."""

    name = "pbm"

    def cells(self) -> Column:
        return F.sequence(F.lit(0), F.lit(RANKS - 1))

    def conditional(self, a, s, c, g):
        p = a * g[:RANKS]
        return np.where(c == 1, p, 1 - p)

    full = conditional


class UBM(_Separable):
    """User browsing model: examination by rank and previous click.

    ``exact_slots`` keeps the cells apart that share a number; otherwise, if one page meets a number twice, the higher
    rank alone counts.  ``unset="prior"`` adds (1, 2) to a cell for each page that does not meet it.
    """

    name = "ubm"

    def __init__(self, exact_slots: bool = False, unset: str = "zero"):
        if unset not in ("zero", "prior"):
            raise ValueError("unset is zero or prior")
        self.exact_slots, self.unset = exact_slots, unset
        self.carries = unset == "zero"
        self.public = 100 if exact_slots else 55

    def cells(self) -> Column:
        return F.transform(previous_clicks(F.col("clicks")), lambda p, r: slot(r, p, self.exact_slots))

    def _cases(self, train: DataFrame) -> DataFrame:
        pages = train.select("query_id", "docs", "clicks", self.cells().alias("cells"))
        rows = pages.select("query_id", "cells", F.posexplode(F.arrays_zip("docs", "clicks", "cells")).alias("rank", "x"))
        later = F.exists(F.slice("cells", F.col("rank") + 2, RANKS), lambda k: k == F.col("x.cells"))
        return rows.select(
            "query_id", F.col("x.docs").alias("doc_id"), F.col("x.cells").alias("cell"), F.col("x.clicks").alias("click"), F.when(later, 0).otherwise(1).alias("counts")
        )

    def statistics(self, train: DataFrame) -> DataFrame:
        rows = super().statistics(train)
        if self.unset == "zero":
            return rows
        # rows without a click hold in n_cell how many pages don't meet a cell
        met = self._cases(train).groupBy("cell").agg(F.sum("counts").alias("met"))
        every = train.sparkSession.range(self.public).select(F.col("id").cast("int").alias("cell"))
        none = [F.lit(None).cast("int").alias(c) for c in ("query_id", "doc_id")]
        unmet = F.lit(train.count()) - F.coalesce("met", F.lit(0))
        return rows.unionByName(every.join(met, "cell", "left").select(*none, "cell", F.lit(None).cast("int").alias("click"), F.lit(0).cast("long").alias("n"), unmet.alias("n_cell")))

    def posteriors(self, statistics, theta, public):
        if self.unset == "zero":
            return super().posteriors(statistics, theta, public)
        times = lambda x: (F.col("n_cell") * x).cast("double")
        unmet = statistics.where("click is null").select(
            F.lit(PUBLIC).alias("kind"), "query_id", F.col("cell").alias("doc_id"), times(PRIOR_NUM).alias("num"), times(PRIOR_DEN).alias("den")
        )
        return super().posteriors(statistics.where("click is not null"), theta, public).unionByName(unmet)

    def _cell(self, rank: int, previous: int) -> int:
        return rank * 10 + previous if self.exact_slots else rank * (rank + 1) // 2 + previous

    def conditional(self, a, s, c, g):
        out, previous = np.empty_like(a), np.full(len(a), 9)
        for r in range(RANKS):
            table = np.array([g[self._cell(r, p)] if p < r or p == 9 else 0.0 for p in range(10)])
            p = a[:, r] * table[previous]
            out[:, r] = np.where(c[:, r] == 1, p, 1 - p)
            previous = np.where(c[:, r] == 1, r, previous)
        return out

    def full(self, a, s, c, g):
        total = np.zeros_like(a)
        for r in range(RANKS):
            for j in range(-1, r):
                prev = 9 if j < 0 else j
                between = np.ones(len(a))
                for k in range(j + 1, r):
                    between *= 1 - a[:, k] * g[self._cell(k, prev)]
                total[:, r] += (1.0 if j < 0 else total[:, j]) * between * a[:, r] * g[self._cell(r, prev)]
        return np.where(c == 1, total, 1 - total)


class _Cascade(ClickModel):
    """CCM and DBN: the user walks down the ranks and may stop after each.

    ``after(a, s, g)`` is the chance to go on after a click, ``stay(g)`` after none.
    """

    public_name = "continuation"

    def after(self, a, s, g):
        raise NotImplementedError

    def step(self, a, s, g):
        """Chance that the next rank is examined if this one is."""
        raise NotImplementedError

    def walk(self, a, s, c, g):
        """Conditional probabilities of the flags, and examination before each rank (11 columns)."""
        p, x = np.empty_like(a), np.ones((len(a), RANKS + 1))
        for r in range(RANKS):
            hit = c[:, r] == 1
            p[:, r] = np.where(hit, a[:, r] * x[:, r], 1 - a[:, r] * x[:, r])
            on = x[:, r] * g[0] * (1 - a[:, r]) / np.where(hit, 1.0, p[:, r])
            x[:, r + 1] = np.where(hit, self.after(a[:, r], s[:, r], g), on)
        return p, x

    def conditional(self, a, s, c, g):
        return self.walk(a, s, c, g)[0]

    def full(self, a, s, c, g):
        out, x = np.empty_like(a), np.ones(len(a))
        for r in range(RANKS):
            p = a[:, r] * x
            out[:, r] = np.where(c[:, r] == 1, p, 1 - p)
            x = x * self.step(a[:, r], s[:, r], g)
        return out

    def tails(self, a, s, c, g):
        """T[r]: probability of the flags below rank r when the user arrives at rank r + 1.

        Flags are those of ranks r + 1 to 9, parameters those of ranks from 0 on.
        """
        out = np.ones_like(a)
        for r in range(RANKS - 1):
            n = RANKS - 1 - r
            flags = np.zeros_like(c)
            flags[:, :n] = c[:, r + 1 :]
            out[:, r] = self.walk(a, s, flags, g)[0][:, :n].prod(axis=1)
        return out

    def entries(self, a, s, c, g):
        """Numerators and denominators: attractiveness [n, 10], satisfaction [n, 10] or None, public lists of [n]."""
        raise NotImplementedError

    def _forward(self, a, s, c, g):
        """Examination without looking at clicks, and the chance of a click from each rank on (11 columns)."""
        exam, car = np.ones((len(a), RANKS)), np.zeros((len(a), RANKS + 1))
        for r in range(RANKS - 1):
            exam[:, r + 1] = exam[:, r] * self.step(a[:, r], s[:, r], g)
        for r in reversed(range(RANKS)):
            car[:, r] = a[:, r] + (1 - a[:, r]) * g[0] * car[:, r + 1]
        return exam, car

    def statistics(self, train: DataFrame) -> DataFrame:
        return page_lists(train)

    def posteriors(self, statistics: DataFrame, theta: DataFrame, public: list[float]) -> DataFrame:
        g = np.array(public)

        def e_step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    yield self._summed(ListBlock(batch), g)

        found = list_values(statistics, theta).mapInArrow(e_step, THETA)
        return found.withColumn("query_id", F.when(F.col("kind") != PUBLIC, F.col("query_id")))

    def _summed(self, lists: ListBlock, g: np.ndarray) -> pa.RecordBatch:
        """Posteriors of a block of lists: a row for each kind and (query, document), and one for each public value."""
        sums, public = np.zeros((2 * len(self.kinds), *lists.a.shape)), np.zeros((self.public, 2))
        for own, row, starts, clicks, n in lists.chunks():
            attract, satisfy, shared = self.entries(lists.a[row], lists.s[row], clicks, g)
            for k, x in enumerate([*attract, *(satisfy or ())]):
                sums[k, own] = np.add.reduceat(x * n[:, None], starts, axis=0)
            public += [[float(x @ n) for x in pair] for pair in shared]
        keys, place = np.unique(((lists.query[:, None] << 32) + (lists.docs + (1 << 31))).ravel(), return_inverse=True)
        nums, dens = ([np.bincount(place, sums[2 * k + i].ravel(), len(keys)) for k in range(len(self.kinds))] for i in (0, 1))
        used = [den > 0 for den in dens]
        query, doc = keys >> 32, (keys & ((1 << 32) - 1)) - (1 << 31)
        joined = lambda parts, shared: np.concatenate([*parts, shared])
        columns = [
            joined([np.full(u.sum(), k) for k, u in zip(self.kinds, used)], np.full(self.public, PUBLIC)), joined([query[u] for u in used], np.zeros(self.public)),
            joined([doc[u] for u in used], np.arange(self.public)), joined([x[u] for x, u in zip(nums, used)], public[:, 0]), joined([x[u] for x, u in zip(dens, used)], public[:, 1]),
        ]
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array(x.astype(t.to_pandas_dtype())) for x, t in zip(columns, kinds)], names=["kind", "query_id", "doc_id", "num", "den"])


class CCM(_Cascade):
    """Click chain model: three continuation parameters."""

    name, public = "ccm", 3

    def after(self, a, s, g):
        return g[1] * (1 - a) + g[2] * a

    def step(self, a, s, g):
        return (1 - a) * g[0] + a * ((1 - a) * g[1] + a * g[2])

    def entries(self, a, s, c, g):
        exam, car = self._forward(a, s, c, g)
        hit = c == 1
        last = np.where(hit.any(axis=1), RANKS - 1 - hit[:, ::-1].argmax(axis=1), RANKS)[:, None]
        rank = np.arange(RANKS)[None, :]
        below = rank >= last
        num = hit.astype(float)
        den = 1.0 + hit
        num += np.where(~hit & below, (1 - exam) * a / (1 - exam * car[:, :RANKS]), 0.0)
        num += np.where(hit & (rank == last), a / (1 - (g[1] * (1 - a) + g[2] * a) * car[:, 1:]), 0.0)
        t, e = self.tails(a, s, c, g), below.astype(float)
        x = self.walk(a, s, c, g)[1][:, :RANKS]
        ratio = lambda n, d: np.divide(n, d, out=np.zeros_like(n), where=d != 0)
        on = g[0] * t * x
        d1 = on + (1 - g[0]) * x * e + (1 - x) * e
        d2 = (1 - a) * (g[1] * t + (1 - g[1]) * e) + a * (g[2] * t + (1 - g[2]) * e)
        pick = lambda m, v: np.where(m, v, 0.0).sum(axis=1)
        shared = [
            (pick(~hit, ratio(on, d1)), pick(~hit, ratio(on + (1 - g[0]) * x * e, d1))),
            (pick(hit, ratio((1 - a) * g[1] * t, d2)), pick(hit, ratio((1 - a) * (g[1] * t + (1 - g[1]) * e), d2))),
            (pick(hit, ratio(a * g[2] * t, d2)), pick(hit, ratio(a * (g[2] * t + (1 - g[2]) * e), d2))),
        ]
        return (num, den), None, shared


class DBN(_Cascade):
    """Dynamic Bayesian network: satisfaction by query and document, one continuation parameter.

    ``unset="prior"`` adds (1, 2) to satisfaction for each unclicked impression.
    """

    name, public, kinds = "dbn", 1, (ATTRACT, SATISFY)

    def __init__(self, unset: str = "zero"):
        if unset not in ("zero", "prior"):
            raise ValueError("unset is zero or prior")
        self.unset = unset

    def after(self, a, s, g):
        return g[0] * (1 - s)

    def step(self, a, s, g):
        return g[0] * (1 - a) + g[0] * a * (1 - s)

    def entries(self, a, s, c, g):
        exam, car = self._forward(a, s, c, g)
        hit = c == 1
        last = np.where(hit.any(axis=1), RANKS - 1 - hit[:, ::-1].argmax(axis=1), RANKS)[:, None]
        rank = np.arange(RANKS)[None, :]
        below = rank >= last
        num = hit + np.where(~hit & below, a * (1 - exam) / (1 - exam * car[:, :RANKS]), 0.0)
        sat_num = np.where(hit & (rank == last), s / (1 - (1 - s) * g[0] * car[:, 1:]), 0.0)
        sat_den = hit.astype(float)
        if self.unset == "prior":
            sat_num, sat_den = sat_num + PRIOR_NUM * ~hit, sat_den + PRIOR_DEN * ~hit
        t, e = self.tails(a, s, c, g), below.astype(float)
        x = self.walk(a, s, c, g)[1][:, :RANKS]
        on, off = g[0] * t * x, (1 - g[0]) * x * e
        d0 = on + off + (1 - x) * e
        go, stop = (1 - s) * g[0] * t, (1 - s) * (1 - g[0]) * e
        d1 = go + stop + s * e
        ratio = lambda n, d: np.divide(n, d, out=np.zeros_like(n), where=d != 0)
        gamma = np.where(hit, ratio(go, d1), ratio(on, d0)).sum(axis=1)
        total = np.where(hit, ratio(go + stop, d1), ratio(on + off, d0)).sum(axis=1)
        return (num, np.ones_like(a)), (sat_num, sat_den), [(gamma, total)]


def make_model(kind: str | int, **options) -> ClickModel:
    """A model by name or number (0 PBM, 1 CCM, 2 DBN, 3 UBM); others are refused."""
    models = {"pbm": PBM, "ccm": CCM, "dbn": DBN, "ubm": UBM, 0: PBM, 1: CCM, 2: DBN, 3: UBM}
    if kind not in models:
        raise ValueError(f"unknown model {kind!r}")
    return models[kind](**options)
