"""N-dimensional arrays as sparse cells: a row for each cell, a column for each dimension and
attribute, and versions by system time."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class Array:
    """cells: DataFrame; dims: name to (low, high), inclusive; extents: tile sizes."""

    cells: DataFrame
    dims: dict[str, tuple[int, int]]
    attrs: list[str]
    extents: dict[str, int] = field(default_factory=dict)

    def _with(self, cells: DataFrame, attrs: list[str] | None = None) -> Array:
        return Array(cells, self.dims, self.attrs if attrs is None else attrs, self.extents)

    def slice(self, bounds: dict[str, tuple], attrs: list[str] | None = None, limit: int | None = None) -> Array:
        """Cells within inclusive bounds; null ends are open."""
        df = self.cells
        for d, (lo, hi) in bounds.items():
            if d not in self.dims:
                raise ValueError(f"no such dimension: {d}")
            df = df if lo is None else df.filter(F.col(d) >= lo)
            df = df if hi is None else df.filter(F.col(d) <= hi)
        out = self._with(df).project(attrs) if attrs else self._with(df)
        return out if limit is None else out._with(out.cells.orderBy(*self.dims).limit(limit))

    def project(self, attrs: list[str]) -> Array:
        if missing := set(attrs) - set(self.attrs):
            raise ValueError(f"no such attributes: {sorted(missing)}")
        return self._with(self.cells.select(*self.dims, *attrs), attrs)

    def agg(self, attr: str, reducer: str, dim: str | None = None) -> DataFrame:
        """sum, count, min, max or mean, of all cells or along one dimension; nulls are skipped."""
        f = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max, "mean": F.avg}[reducer]
        return self.cells.groupBy(*([dim] if dim else [])).agg(f(attr).alias("value"))

    def elementwise(self, other: Array, op: str, attr: str) -> Array:
        """add, sub, mul or div of two arrays' cells: an outer join on coordinates; null where
        either has none, and where the divisor is 0."""
        a = self.cells.select(*self.dims, F.col(attr).alias("_a"))
        b = other.cells.select(*self.dims, F.col(attr).alias("_b"))
        x, y = F.col("_a"), F.col("_b")
        out = {"add": x + y, "sub": x - y, "mul": x * y, "div": F.try_divide(x, y)}[op]
        return self._with(a.join(b, list(self.dims), "full").select(*self.dims, out.alias(attr)), [attr])

    def check(self) -> Array:
        """An error, when it runs, if a cell lies outside a dimension's domain."""
        ok = F.lit(True)
        for d, (lo, hi) in self.dims.items():
            ok = F.when(~F.col(d).between(lo, hi), F.raise_error(F.concat(F.lit(f"{d} is out of its domain: "), F.col(d).cast("string"))).cast("boolean")).otherwise(ok)
        return self._with(self.cells.filter(ok))

    def put(self, cells: DataFrame) -> Array:
        """Cells that replace those of their coordinates."""
        old = self.cells.join(cells.select(*self.dims), list(self.dims), "left_anti")
        return self._with(old.unionByName(cells))

    def delete(self, coords: DataFrame) -> Array:
        return self._with(self.cells.join(coords, list(self.dims), "left_anti"))

    def tile(self) -> Column:
        """The tile of a cell: an array of tile numbers."""
        return F.array(*(F.floor((F.col(d) - lo) / self.extents.get(d, hi - lo + 1)).cast("long") for d, (lo, hi) in self.dims.items()))

    def rechunk(self, extents: dict[str, int]) -> Array:
        """Tiles of other sizes: cells of a tile go to one partition, in order."""
        out = Array(self.cells, self.dims, self.attrs, extents)
        return out._with(self.cells.withColumn("_tile", out.tile()).repartition("_tile").sortWithinPartitions("_tile", *self.dims).drop("_tile"))

    def as_of(self, system: str, at, valid: tuple[str, str] | None = None, valid_at=None) -> Array:
        """The newest version of each cell at or before a system time, maybe among those that
        are valid at a time (low <= at < high)."""
        from sparkloom.operators import dml

        df = self.cells if valid is None else dml.valid_at(self.cells, *valid, valid_at)
        return self._with(dml.as_of(df, list(self.dims), system, at))

    def compacted(self, system: str, before: int, deleted: str | None = None) -> Array:
        """Versions that no read as of ``before`` or later needs are left out: of each cell, all but the newest
        at or before it, and that one too if it is a deletion."""
        from pyspark.sql import Window

        old = F.col(system) <= before
        rank = F.row_number().over(Window.partitionBy(*self.dims, old.alias("_old")).orderBy(F.desc(system)))
        kept = ~old | (F.col("_at") == 1) & (F.lit(True) if deleted is None else ~F.coalesce(F.col(deleted), F.lit(False)))
        return self._with(self.cells.withColumn("_at", rank).filter(kept).drop("_at"))

    def z_order(self, bits: int = 16) -> Column:
        """Interleaved bits of the coordinates, the first dimension highest."""
        out = F.lit(0).cast("long")
        n = len(self.dims)
        for i, (d, (lo, _)) in enumerate(self.dims.items()):
            x = (F.col(d) - lo).cast("long")
            for b in range(bits):
                out = out.bitwiseOR(F.shiftleft(F.shiftright(x, b).bitwiseAND(F.lit(1).cast("long")), b * n + (n - 1 - i)))
        return out

    def hilbert(self, bits: int = 8) -> Column:
        """Place on the Hilbert curve of a two-dimensional array."""
        if len(self.dims) != 2:
            raise ValueError("the curve is over two dimensions")
        (a, (alo, _)), (b, (blo, _)) = self.dims.items()
        # bits from the highest choose a quadrant each; the ends are then swapped (2) or complemented (1) for the bits
        # below, so that a state of two bits and the pair of bits look up the digit and the next state in a long
        digits, after = 0, 0
        for i in range(16):
            swap, flip, bit = i >> 3, i >> 2 & 1, (i >> 1 & 1, i & 1)
            rx, ry = (bit[::-1] if swap else bit)[0] ^ flip, (bit[::-1] if swap else bit)[1] ^ flip
            digits |= ((3 * rx) ^ ry) << 2 * i
            after |= (2 * (swap ^ (ry == 0)) + (flip ^ (ry == 0 and rx == 1))) << 2 * i
        x, y = (F.col(a) - alo).cast("long"), (F.col(b) - blo).cast("long")
        one, three = F.lit(1).cast("long"), F.lit(3).cast("long")
        found = lambda table, i: F.call_function("shiftright", F.lit(table).cast("long"), i).bitwiseAND(three)
        state, d = F.lit(0).cast("long"), F.lit(0).cast("long")
        for k in range(bits - 1, -1, -1):
            at = ((state * 4 + F.shiftright(x, k).bitwiseAND(one) * 2 + F.shiftright(y, k).bitwiseAND(one)) * 2).cast("int")
            state, d = found(after, at), d.bitwiseOR(F.shiftleft(found(digits, at), 2 * k))
        return d
