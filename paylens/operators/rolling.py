"""Rolling sums, spreads, maxima and distinct counts over ``(t - w, t]`` per key, by a segmented prefix scan.

Rows are range-partitioned by (key, time) once, sorted and checkpointed; a
partition is a slab.  Three kinds of keys follow from the slabs' first and last
keys alone:

* a key that lies inside one slab is computed there, many keys at once, from
  prefix sums over the sorted rows;
* a key that straddles slabs but is no larger than one goes to one group;
* a larger key is scanned in segments.  Every row sends, for each width w, an
  exit event to the slab that holds time + w.  Totals of entries and exits by
  slab give each slab's carry-in, and within a slab a rolling sum is the carry
  plus entries minus exits up to t.  The exit event of the maximum's width also
  holds the maximum of its own slab's later rows, so a frame's maximum is that,
  the maxima of the slabs between, and the slab's own running maximum.  Distinct
  counts are rows minus neighbouring pairs of one value in the frame; pairs
  across slabs come from one row per (key, value, slab).

No task holds more than a slab (rows of one key at one microsecond stay
together), and what reaches the driver are figures by slab.  Sums are exact
integers; a spread is ``n * sum(v^2) - sum(v)^2``, exact before it becomes a
double, so constant frames give exactly 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paylens.session import cut_lineage, ship_package

#: Rows of a slab; fewer where the table has not enough for all cores.
SLAB_ROWS = 1_000_000
_CHUNK_ROWS = 1 << 16


@dataclass(frozen=True)
class Rolling:
    """What to compute: ``(name, column, width in microseconds)``.

    Columns of ``sums`` and ``spreads`` are long (null counts as 0; a spread's
    fourth entry is the 0/1 column that counts its values), of ``maxima`` double
    (null: no value), of ``distinct`` string (null is a value of its own).
    """
    sums: tuple[tuple[str, str, int], ...] = ()
    spreads: tuple[tuple[str, str, int, str], ...] = ()
    maxima: tuple[tuple[str, str, int], ...] = ()
    distinct: tuple[tuple[str, str, int], ...] = ()

    @property
    def widths(self) -> list[int]:
        return sorted({x[2] for x in (*self.sums, *self.spreads, *self.maxima, *self.distinct)})

    @property
    def longs(self) -> list[str]:
        return list(dict.fromkeys([c for _, c, _ in self.sums] + [x for _, c, _, n in self.spreads for x in (c, n)]))

    @property
    def names(self) -> list[tuple[str, T.DataType]]:
        return [(n, T.LongType()) for n, *_ in self.sums] + [(n, T.DoubleType()) for n, *_ in self.spreads] \
            + [(n, T.DoubleType()) for n, *_ in self.maxima] + [(n, T.LongType()) for n, *_ in self.distinct]


def _long(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).combine_chunks().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def _double(table: pa.Table, name: str) -> np.ndarray:
    """Null as NaN."""
    return table.column(name).combine_chunks().cast(pa.float64()).to_numpy(zero_copy_only=False).astype(np.float64)


def _codes(column: pa.ChunkedArray) -> np.ndarray:
    """Equal values, null included, as equal numbers."""
    codes = column.combine_chunks().dictionary_encode().indices
    return codes.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)


def _upto(values: np.ndarray) -> np.ndarray:
    """Prefix sums, from 0."""
    out = np.zeros(len(values) + 1, values.dtype)
    if len(values):
        np.cumsum(values, out=out[1:])
    return out


class Rows:
    """Sorted rows of whole keys, or of one key's slab: places of the frames' ends."""

    def __init__(self, group: np.ndarray, ts: np.ndarray):
        self.group, self.ts, self.n = group, ts, len(ts)
        fresh = np.r_[True, (group[1:] != group[:-1]) | (ts[1:] != ts[:-1])] if self.n else np.zeros(0, bool)
        starts = np.flatnonzero(fresh)
        ends = np.r_[starts[1:], self.n]
        self.hi = np.repeat(ends, ends - starts) if self.n else np.zeros(0, np.int64)  # after the rows of equal time
        heads = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if self.n else np.zeros(0, np.int64)
        self.head = np.repeat(heads, np.diff(np.r_[heads, self.n])) if self.n else heads

    def lo(self, width: int) -> np.ndarray:
        """First row of each row's frame (t - width, t]."""
        if not self.n:
            return np.zeros(0, np.int64)
        span = int(self.ts.max() - self.ts.min()) + width + 2
        if (int(self.group.max()) + 2) * span < 1 << 62:
            at = self.group * span + (self.ts - self.ts.min()) + width
            return np.searchsorted(at, at - width, "right")
        out = np.empty(self.n, np.int64)
        heads = np.unique(self.head)
        for a, b in zip(heads, np.r_[heads[1:], self.n]):
            out[a:b] = a + np.searchsorted(self.ts[a:b], self.ts[a:b] - width, "right")
        return out

    def maximum(self, values: np.ndarray, width: int) -> np.ndarray:
        """Frame maxima (NaN: no value): running maxima within segments of one width, and those to the segments' ends."""
        if not self.n:
            return np.zeros(0)
        some = ~np.isnan(values)
        steps, rank = np.unique(np.where(some, values, -np.inf), return_inverse=True)
        rank = np.where(some, rank + 1, 0).astype(np.int64)
        size = len(steps) + 1
        cell = np.floor_divide(self.ts, width)
        segment = np.cumsum(np.r_[0, (self.group[1:] != self.group[:-1]) | (cell[1:] != cell[:-1])])
        forth = np.maximum.accumulate(segment * size + rank) % size
        back = (np.maximum.accumulate((segment[-1] - segment[::-1]) * size + rank[::-1]) % size)[::-1]
        lo = self.lo(width)
        begin = segment[np.minimum(lo, self.n - 1)]
        best = np.maximum(forth[self.hi - 1], np.where(begin < segment, back[np.minimum(lo, self.n - 1)], 0))
        return np.where(best > 0, np.r_[np.nan, steps][best], np.nan)

    def neighbours(self, codes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Whether the row before (after) it with the same value in its group lies nearer than ``width``."""
        order = np.lexsort((self.ts, codes, self.group))
        g, c, t = self.group[order], codes[order], self.ts[order]
        near = (g[1:] == g[:-1]) & (c[1:] == c[:-1]) & (t[1:] - t[:-1] < width)
        before, after = np.zeros(self.n, np.int64), np.zeros(self.n, np.int64)
        before[order[1:][near]] = 1
        after[order[:-1][near]] = 1
        return before, after


def _terms(table: pa.Table, rows: Rows, spec: Rolling) -> dict:
    """Entry and exit values of every prefix sum: (name, part) -> (entries, exits, width)."""
    long = {c: _long(table, c) for c in spec.longs}
    out = {(n, "sum"): (long[c], long[c], w) for n, c, w in spec.sums}
    for n, c, w, count in spec.spreads:
        square = long[c].astype(object) ** 2
        out |= {(n, "sum"): (long[c], long[c], w), (n, "square"): (square, square, w), (n, "n"): (long[count], long[count], w)}
    for n, c, w in spec.distinct:
        one = np.ones(rows.n, np.int64)
        out |= {(n, "rows"): (one, one, w), (n, "pairs"): (*rows.neighbours(_codes(table.column(c)), w), w)}
    return out


def _finish(found: dict, maxima: dict[str, np.ndarray], spec: Rolling) -> list[pa.Array]:
    """The result columns from the rolled terms."""
    out = [pa.array(found[n, "sum"]) for n, *_ in spec.sums]
    for n, *_ in spec.spreads:
        total = found[n, "sum"].astype(object)
        spread = found[n, "n"].astype(object) * found[n, "square"] - total * total
        out.append(pa.array(spread.astype(np.float64)))
    for n, *_ in spec.maxima:
        out.append(pa.array(maxima[n], mask=np.isnan(maxima[n])))
    return out + [pa.array(found[n, "rows"] - found[n, "pairs"]) for n, *_ in spec.distinct]


def _rolled(table: pa.Table, spec: Rolling) -> pa.Table:
    """Sorted rows of whole keys with the result columns."""
    rows = Rows(np.cumsum(np.r_[0, np.diff(_codes(table.column("_key"))) != 0])[:table.num_rows], _long(table, "_ts"))
    lows = {w: rows.lo(w) for w in spec.widths}
    found = {}
    for name, (entries, exits, w) in _terms(table, rows, spec).items():
        found[name] = _upto(entries)[rows.hi] - _upto(exits)[lows[w]]
    maxima = {n: rows.maximum(_double(table, c), w) for n, c, w in spec.maxima}
    for (n, _), column in zip(spec.names, _finish(found, maxima, spec)):
        table = table.append_column(n, column)
    return table


def _whole_keys(spec: Rolling, columns: list[str], other: frozenset[str]):
    """Sorted partitions to the results of the keys that lie inside them (``other`` keys are left out)."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def done(last: bool):
            nonlocal held, size
            table = pa.Table.from_batches(held)
            cut = table.num_rows
            if not last:
                codes = _codes(table.column("_key"))
                changes = np.flatnonzero(np.diff(codes))
                cut = int(changes[-1]) + 1 if len(changes) else 0
            rest = table.slice(cut)
            held, size = rest.to_batches(), rest.num_rows
            table = table.slice(0, cut)
            if other:
                table = table.filter(pc.invert(pc.is_in(table.column("_key"), pa.array(sorted(other)))))
            if table.num_rows:
                yield from _rolled(table, spec).select(columns).to_batches()

        limit = _CHUNK_ROWS
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= limit:
                yield from done(False)
                limit = max(_CHUNK_ROWS, 2 * size)
        if held:
            yield from done(True)
    return task


@dataclass(frozen=True)
class Slabs:
    """One large key's slabs in time order: their numbers and last times."""
    number: np.ndarray
    last: np.ndarray

    def holding(self, ts: np.ndarray) -> np.ndarray:
        """Place of the first slab that ends at or after each time (their number: none)."""
        return np.searchsorted(self.last, ts, "left")


def _exits(spec: Rolling, slabs: dict[str, Slabs], schema: pa.Schema):
    """Sorted partitions to the exit events of the large keys' rows: to which slab, when, and what leaves."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        large = pa.array(sorted(slabs))
        kept = (pa.Table.from_batches([b]) for b in batches)
        kept = [t for t in (t.filter(pc.is_in(t.column("_key"), large)) for t in kept) if t.num_rows]
        if not kept:
            return
        table = pa.concat_tables(kept).combine_chunks()
        codes = _codes(table.column("_key"))
        cuts = [0, *(np.flatnonzero(np.diff(codes)) + 1).tolist(), table.num_rows]
        for lo, hi in zip(cuts, cuts[1:]):
            part = table.slice(lo, hi - lo)
            key, slab = part.column("_key")[0].as_py(), part.column("_slab")[0].as_py()
            own = slabs[key]
            rows = Rows(np.zeros(hi - lo, np.int64), _long(part, "_ts"))
            pairs = {n: rows.neighbours(_codes(part.column(c)), w)[1] for n, c, w in spec.distinct}
            later = {n: _later(_double(part, c), rows.hi) for n, c, _ in spec.maxima}
            for w in spec.widths:
                at = own.holding(rows.ts + w)
                keep = np.flatnonzero(at < len(own.number))
                size = len(keep)
                none = pa.nulls(size, pa.float64())
                cols = [pa.array([key] * size, pa.string()), pa.array(own.number[at[keep]].astype(np.int32)), pa.array(rows.ts[keep] + w),
                        pa.array(np.full(size, w)), pa.array(np.full(size, slab, np.int32))]
                cols += [pa.array(_long(part, c)[keep]) for c in spec.longs]
                cols += [pa.array(pairs[n][keep] if x == w else np.zeros(size, np.int64)) for n, _, x in spec.distinct]
                cols += [pa.array(later[n][keep], mask=np.isnan(later[n][keep])) if x == w else none for n, _, x in spec.maxima]
                yield from pa.Table.from_arrays(cols, schema=schema).to_batches(max_chunksize=_CHUNK_ROWS)
    return task


def _later(values: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Maximum of the values from each place in ``after`` on (NaN: none)."""
    return np.r_[np.fmax.accumulate(values[::-1])[::-1], np.nan][after]


@dataclass(frozen=True)
class Carry:
    """What a slab of a large key starts with: rolled terms, and of each maximum the slab that the frame's
    start has reached (-1: none), the maximum of that slab's rows after it, and the slabs' maxima by place."""
    terms: dict
    reached: dict
    slab_maxima: dict


def _scan(spec: Rolling, columns: list[str], carries: dict[tuple[str, int], Carry], slabs: dict[str, Slabs]):
    """A slab's rows and the events sent to it (``_w`` null: a row; 0: a pair's entry) to the rows with the result columns."""
    def task(table: pa.Table) -> pa.Table:
        key, slab = table.column("_key")[0].as_py(), table.column("_slab")[0].as_py()
        carry, numbers = carries[key, slab], slabs[key].number
        place = int(np.searchsorted(numbers, slab))
        is_row = table.column("_w").is_null()
        own, events = table.filter(is_row), table.filter(pc.invert(is_row))
        own = own.take(pa.array(np.argsort(_long(own, "_ts"), kind="stable")))
        rows = Rows(np.zeros(own.num_rows, np.int64), _long(own, "_ts"))
        width, when = _long(events, "_w"), _long(events, "_ts")
        found = {}
        for name, (entries, _, w) in _terms(own, rows, spec).items():
            left = _event_values(events, name, spec)
            mine = np.flatnonzero(width == w)
            mine = mine[np.argsort(when[mine], kind="stable")]
            gone = _upto(left[mine])[np.searchsorted(when[mine], rows.ts, "right")]
            found[name] = carry.terms[name] + _upto(entries)[rows.hi] - gone
            if name[1] == "pairs":  # pairs whose earlier row lies in an earlier slab
                mine = np.flatnonzero(width == 0)
                mine = mine[np.argsort(when[mine], kind="stable")]
                found[name] = found[name] + _upto(_long(events, f"_pairs_{name[0]}")[mine])[np.searchsorted(when[mine], rows.ts, "right")]
        maxima = {}
        for n, c, w in spec.maxima:
            values = _double(own, c)
            local, running = rows.maximum(values, w), np.fmax.accumulate(values)[rows.hi - 1]
            source = _long(events, "_from")
            mine = np.flatnonzero((width == w) & (source >= 0) & (source != slab))
            mine = mine[np.argsort(when[mine], kind="stable")]
            last = np.searchsorted(when[mine], rows.ts, "right")
            first_place, first_later = carry.reached[n]
            reached = np.r_[first_place, np.searchsorted(numbers, source[mine])][last]
            later = np.r_[first_later, _double(events, f"_later_{n}")[mine]][last]
            between = carry.slab_maxima[n][:place]
            after = np.r_[np.fmax.accumulate(between[::-1])[::-1], np.nan] if place else np.array([np.nan])
            outer = np.fmax(later, after[np.minimum(reached + 1, place)])
            inside = rows.lo(w) > 0  # the frame starts in this slab
            maxima[n] = np.where(inside, local, np.fmax(outer, running))
        for (n, _), column in zip(spec.names, _finish(found, maxima, spec)):
            own = own.append_column(n, column)
        return own.select(columns)
    return task


def _event_values(events: pa.Table, name: tuple[str, str], spec: Rolling) -> np.ndarray:
    """What a term loses with each exit event."""
    n, part = name
    if part == "pairs":
        return _long(events, f"_pairs_{n}")
    if part == "rows":
        return (_long(events, "_from") >= 0).astype(np.int64)
    column = next(x for x in (*spec.sums, *spec.spreads) if x[0] == n)
    values = _long(events, column[3] if part == "n" else column[1])
    return values.astype(object) ** 2 if part == "square" else values


def _carries(spec: Rolling, slabs: dict[str, Slabs], entries: list, exits: list) -> dict[tuple[str, int], Carry]:
    """Carry-ins from the entries and exits by slab."""
    came = {(r["_key"], r["_slab"]): r for r in entries}
    left: dict = {}
    for r in exits:
        left.setdefault((r["_key"], r["_slab"]), {})[r["_w"]] = r
    out = {}
    for key, own in slabs.items():
        terms: dict = {}
        maxima = {n: np.array([came[key, s][f"_max_{n}"] if came[key, s][f"_max_{n}"] is not None else np.nan
                               for s in own.number.tolist()], float) for n, _, _ in spec.maxima}
        reached = {n: (-1, np.nan) for n, _, _ in spec.maxima}
        place = {int(s): k for k, s in enumerate(own.number)}
        for s in own.number.tolist():
            out[key, s] = Carry({k: _wrapped(terms.get(k, 0), k[1]) for k in _term_names(spec)}, dict(reached), maxima)
            e, x = came[key, s], left.get((key, s), {})
            none: dict = {}
            for n, c, w in spec.sums:
                terms[n, "sum"] = terms.get((n, "sum"), 0) + int(e[f"_sum_{c}"]) - int(x.get(w, none).get(f"_sum_{c}", 0))
            for n, c, w, count in spec.spreads:
                for part, field in (("sum", f"_sum_{c}"), ("square", f"_square_{c}"), ("n", f"_sum_{count}")):
                    terms[n, part] = terms.get((n, part), 0) + int(e[field]) - int(x.get(w, none).get(field, 0))
            for n, _, w in spec.distinct:
                terms[n, "rows"] = terms.get((n, "rows"), 0) + e["_rows"] - x.get(w, none).get("_rows", 0)
                terms[n, "pairs"] = terms.get((n, "pairs"), 0) + e[f"_pairs_{n}"] + x.get(0, none).get(f"_pairs_{n}", 0) \
                    - x.get(w, none).get(f"_pairs_{n}", 0)
            for n, _, w in spec.maxima:
                last = x.get(w, none).get(f"_last_{n}")
                if last is not None:
                    reached[n] = place[last["_from"]], np.nan if last["later"] is None else last["later"]
    return out


def _wrapped(total: int, part: str) -> int:
    """Totals of longs modulo 2^64: a frame's sum comes out right as long as it is a long itself."""
    return total if part == "square" else (total + (1 << 63)) % (1 << 64) - (1 << 63)


def _term_names(spec: Rolling) -> list[tuple[str, str]]:
    return [(n, "sum") for n, *_ in spec.sums] + [(n, p) for n, *_ in spec.spreads for p in ("sum", "square", "n")] \
        + [(n, p) for n, *_ in spec.distinct for p in ("rows", "pairs")]


def _square(c: str):
    value = F.coalesce(F.col(c), F.lit(0)).cast("decimal(19,0)")
    return value * value


def _large_keys(base: DataFrame, spec: Rolling, slabs: dict[str, Slabs], columns: list[str], out: T.StructType) -> DataFrame:
    """Results of the keys that are larger than a slab."""
    spark = base.sparkSession
    keys = F.broadcast(spark.createDataFrame([(k,) for k in slabs], "_key string"))  # fewer than slabs
    rows = base.join(keys, "_key", "leftsemi")
    fields = [("_key", "string"), ("_slab", "int"), ("_ts", "long"), ("_w", "long"), ("_from", "int")] \
        + [(c, "long") for c in spec.longs] + [(f"_pairs_{n}", "long") for n, *_ in spec.distinct] \
        + [(f"_later_{n}", "double") for n, *_ in spec.maxima]
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64()}
    ddl = ", ".join(f"{n} {t}" for n, t in fields)
    events = base.mapInArrow(_exits(spec, slabs, pa.schema([(n, kinds[t]) for n, t in fields])), ddl)

    # pairs of one value across slabs: one row per key, value and slab; an entry in the later row's slab, an exit w after the earlier row
    bounds = {k: (s.number, s.last) for k, s in slabs.items()}
    for n, c, w in spec.distinct:
        w_value = Window.partitionBy("_key", F.col(c)).orderBy("_slab")
        chain = rows.groupBy("_key", F.col(c), "_slab").agg(F.min("_ts").alias("first"), F.max("_ts").alias("last")) \
            .select("_key", "_slab", "first", F.lag("last").over(w_value).alias("before")).filter(F.col("first") - F.col("before") < w)
        empty = {f: F.lit(0).cast("long") for f in [*spec.longs, *(f"_pairs_{d}" for d, *_ in spec.distinct)]} \
            | {f"_later_{m}": F.lit(None).cast("double") for m, *_ in spec.maxima}
        one = empty | {f"_pairs_{n}": F.lit(1).cast("long")}
        entry = chain.select("_key", "_slab", F.col("first").alias("_ts"), F.lit(0).cast("long").alias("_w"),
                             F.lit(-1).alias("_from"), *[one[f].alias(f) for f, _ in fields[5:]])
        leave = chain.select("_key", (F.col("before") + w).alias("_ts")).mapInArrow(_placed(bounds), "_key string, _slab int, _ts long") \
            .select("_key", "_slab", "_ts", F.lit(w).cast("long").alias("_w"), F.lit(-1).alias("_from"),
                    *[one[f].alias(f) for f, _ in fields[5:]])
        events = events.union(entry).union(leave)
    events = cut_lineage(events)

    sums = [F.sum(F.coalesce(F.col(c), F.lit(0)).cast("decimal(19,0)")).alias(f"_sum_{c}") for c in spec.longs] + [F.sum(_square(c)).alias(f"_square_{c}") for c in {c for _, c, _, _ in spec.spreads}]
    counted = F.sum((F.col("_from") >= 0).cast("long")).alias("_rows")
    reached = F.when(F.col("_from") >= 0, F.struct("_ts", "_from"))
    last = [F.max_by(F.struct("_from", F.col(f"_later_{n}").alias("later")), reached).alias(f"_last_{n}") for n, *_ in spec.maxima]
    exits = events.groupBy("_key", "_slab", "_w").agg(
        *sums, counted, *[F.sum(f"_pairs_{n}").alias(f"_pairs_{n}") for n, *_ in spec.distinct], *last).collect()
    in_slab = rows.mapInArrow(_pair_counts(spec), "_key string, _slab int, " + ", ".join(f"_pairs_{n} long" for n, *_ in spec.distinct)) \
        if spec.distinct else None
    entries = rows.groupBy("_key", "_slab").agg(*sums, F.count(F.lit(1)).alias("_rows"),
                                                *[F.max(c).alias(f"_max_{n}") for n, c, _ in spec.maxima])
    if in_slab is not None:
        entries = entries.join(in_slab, ["_key", "_slab"])
    carries = _carries(spec, slabs, [r.asDict() for r in entries.collect()], [r.asDict() for r in exits])
    both = rows.withColumn("_w", F.lit(None).cast("long")).unionByName(events, allowMissingColumns=True)
    return both.groupBy("_key", "_slab").applyInArrow(_scan(spec, columns, carries, slabs), out)


def _placed(bounds: dict[str, tuple[np.ndarray, np.ndarray]]):
    """(key, time) to the slab that holds the time (none: dropped)."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, ts = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            codes = _codes(pa.chunked_array([batch.column(0)]))
            slab = np.full(len(ts), -1, np.int32)
            for code in np.unique(codes):
                at = np.flatnonzero(codes == code)
                number, last = bounds[keys[at[0]]]
                place = np.searchsorted(last, ts[at], "left")
                slab[at] = np.r_[number, -1][place]
            some = pa.array(slab >= 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(slab), batch.column(1)],
                                             names=["_key", "_slab", "_ts"]).filter(some)
    return task


def _pair_counts(spec: Rolling):
    """Sorted partitions to the number of near pairs within each key's slab."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [b for b in batches if b.num_rows]
        if not kept:
            return
        table = pa.Table.from_batches(kept)
        cuts = [0, *(np.flatnonzero(np.diff(_codes(table.column("_key")))) + 1).tolist(), table.num_rows]
        for lo, hi in zip(cuts, cuts[1:]):
            part = table.slice(lo, hi - lo)
            rows = Rows(np.zeros(hi - lo, np.int64), _long(part, "_ts"))
            yield pa.RecordBatch.from_pydict(
                {"_key": [part.column("_key")[0].as_py()], "_slab": pa.array([part.column("_slab")[0].as_py()], pa.int32())}
                | {f"_pairs_{n}": [int(rows.neighbours(_codes(part.column(c)), w)[0].sum())] for n, c, w in spec.distinct})
    return task


def rolling(df: DataFrame, spec: Rolling, key: str, ts: str, slab_rows: int | None = None,
            keep: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """``df`` with the columns of ``spec``, rows without a time left out; and ``df`` itself as it was shuffled (checkpointed).

    ``key`` names a string column (null is a key of its own), ``ts`` a long
    column of microseconds.  ``slab_rows``: rows of a slab, by default
    ``SLAB_ROWS`` or a core's share.  ``keep``: the columns of ``df`` in the first
    result (default: all); those that are only rolled need not come back from Python.
    """
    spark = df.sparkSession
    ship_package(spark)
    rows = df.count()
    size = slab_rows or SLAB_ROWS
    wide = 1 if slab_rows else min(rows, int(spark.conf.get("spark.sql.shuffle.partitions")))
    keyed = df.withColumn("_key", F.coalesce(F.concat(F.lit("="), F.col(key)), F.lit("-"))).withColumn("_ts", F.col(ts).cast("long"))
    base = cut_lineage(keyed.repartitionByRange(max(1, wide, -(-rows // size)), "_key", "_ts").sortWithinPartitions("_key", "_ts")
                       .withColumn("_slab", F.spark_partition_id()))
    timed = base.filter(F.col("_ts").isNotNull())

    edges = timed.groupBy("_slab").agg(F.min("_key").alias("a"), F.max("_key").alias("b")).collect()  # a row per slab
    seen: dict[str, int] = {}
    for r in edges:
        for k in {r.a, r.b}:
            seen[k] = seen.get(k, 0) + 1
    across = sorted(k for k, n in seen.items() if n > 1)
    kept = df.columns if keep is None else list(keep)
    columns = [*kept, *[n for n, _ in spec.names]]
    out = T.StructType([df.schema[c] for c in kept] + [T.StructField(n, t) for n, t in spec.names])
    read = dict.fromkeys([*kept, *spec.longs, *[c for _, c, _ in (*spec.maxima, *spec.distinct)], "_key", "_ts"])
    found = timed.select(*read).mapInArrow(_whole_keys(spec, columns, frozenset(across)), out)
    if across:
        cut = F.broadcast(spark.createDataFrame([(k,) for k in across], "_key string"))  # fewer than slabs
        pieces = timed.join(cut, "_key", "leftsemi").groupBy("_key", "_slab").agg(
            F.count(F.lit(1)).alias("n"), F.max("_ts").alias("last")).orderBy("_key", "_slab").collect()
        of: dict[str, list] = {}
        for r in pieces:
            of.setdefault(r["_key"], []).append(r)
        large = {k: Slabs(np.array([r["_slab"] for r in p]), np.array([r["last"] for r in p]))
                 for k, p in of.items() if sum(r["n"] for r in p) > size}
        small = [(k,) for k in of if k not in large]
        if small:
            group = timed.join(F.broadcast(spark.createDataFrame(small, "_key string")), "_key", "leftsemi").groupBy("_key")

            def whole(table: pa.Table) -> pa.Table:
                return _rolled(table.take(pa.array(np.argsort(_long(table, "_ts"), kind="stable"))), spec).select(columns)

            found = found.union(group.applyInArrow(whole, out))
        if large:
            found = found.union(_large_keys(timed, spec, large, columns, out))
    return found, base
