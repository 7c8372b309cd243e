"""Computation along one global order, or along one in each key, without sending a table or a hot key to one task.

``number`` gives rows dense numbers and cuts them into blocks. Functions that look a bounded number
of rows back or ahead run inside blocks, with the neighbouring rows copied in (``with_halo``).
Functions of all earlier rows run inside blocks too, and then take in what the blocks before carry
over: one row a block, computed first and written to the shared folder, so that a chain of such
functions reads its table once for each and never twice for each of the others. Tables of one block
need neither (``many`` is false).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import materialise, small

RN, BLOCK, HOME, TOTAL = "__rn", "__block", "__home", "__rows"
ROWS_PER_BLOCK = 1_000_000
#: Ranges in which rows are numbered, for each block: cut points come from a sample, so ranges are finer than blocks.
RANGES_PER_BLOCK = 2
#: So many ranges at most for blocks of few rows, as long as a range stays as small as one of a table in blocks of ROWS_PER_BLOCK: each range is a task, whose result the driver takes.
FEW_RANGES = 200


def number(df: DataFrame, order: str, keys: Sequence[str] = (), ties: Sequence[str] = (), rows_per_block: int = ROWS_PER_BLOCK) -> tuple[DataFrame, bool]:
    """Adds __rn (dense, from 0, within ``keys``) and __block (within ``keys``); and whether there can be many blocks.

    A table of one block needs a window only. A larger one is dealt into ranges of (keys, order, ties)
    whose cut points come from a sample of its rows, so a burst, a hot key, nulls and rows of one time
    are split like any others; of rows that are the same in all columns, all stand in one range. The
    ranges are written, and their counts for each key say at which number each begins. Null comes first.
    """
    by = [F.asc_nulls_first(order), *[F.asc_nulls_first(t) for t in ties]]
    n = df.count()
    if n <= rows_per_block:
        one = df.withColumn(BLOCK, F.lit(0).cast("long"))
        return one.withColumn(RN, F.row_number().over(Window.partitionBy(*keys, BLOCK).orderBy(*by)).cast("long") - 1), False
    return ranked(df, keys, by, ranges_of(n, rows_per_block)).drop(TOTAL).withColumn(BLOCK, F.floor(F.col(RN) / rows_per_block).cast("long")), True


def ranges_of(n: int, rows_per_block: int) -> int:
    """In how many ranges ``n`` rows are numbered. Blocks are cut by number, so a range may hold many of them."""
    return RANGES_PER_BLOCK * min(-(-n // rows_per_block), max(FEW_RANGES // RANGES_PER_BLOCK, -(-n // ROWS_PER_BLOCK)))


def ranked(df: DataFrame, keys: Sequence[str], by: Sequence[Column], ranges: int) -> DataFrame:
    """``df`` with __rn, its dense number from 0 along ``by`` within ``keys``, and __rows, the rows of its key; from ``ranges`` written ranges, so that no key is one task."""
    placed = in_ranges(df, [*[F.asc_nulls_first(k) for k in keys], *by], ranges)
    part = F.shiftright("__place", 33)
    counts = placed.groupBy(*keys, part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"), F.min("__place").alias("__first"))
    key = Window.partitionBy(*keys)
    before = F.sum("__n").over(key.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    starts = materialise(counts.select(*keys, "__part", (F.coalesce(before, F.lit(0)) - F.col("__first")).alias("__shift"), F.sum("__n").over(key).alias(TOTAL)))
    numbered = beside(placed.withColumn("__part", part), small(starts), [*keys, "__part"]).withColumn(RN, F.col("__place") + F.col("__shift"))
    return numbered.drop("__part", "__place", "__shift")


def in_ranges(df: DataFrame, by: Sequence[Column], ranges: int) -> DataFrame:
    """``df`` in order, written in ``ranges`` ranges of about equal size; __place grows along the order, and its bits from the 33rd on are the range.

    Rows that are equal in ``by`` stand in the order of a hash of all their columns, so they can be cut too and a task that is run again finds the same order.
    """
    told = [c for c in df.columns if not isinstance(df.schema[c].dataType, T.MapType)]
    tied = df.withColumn("__tie", F.xxhash64(*[F.col("`" + c.replace("`", "``") + "`") for c in told]))
    order = [*by, F.asc("__tie")]
    return materialise(tied.repartitionByRange(max(1, ranges), *order).sortWithinPartitions(*order).drop("__tie").withColumn("__place", F.monotonically_increasing_id()))


def beside(df: DataFrame, other: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Join by ``on``, where null meets null; ``other`` has one row for each."""
    names = {k: f"__on{i}" for i, k in enumerate(on)}
    same = None
    for k, name in names.items():
        test = F.col("`" + k.replace("`", "``") + "`").eqNullSafe(F.col(name))
        same = test if same is None else same & test
    return df.join(other.withColumnsRenamed(names), same, how).drop(*names.values())


def block_window(keys: Sequence[str] = ()) -> Window:
    return Window.partitionBy(*keys, BLOCK).orderBy(RN)


def with_halo(df: DataFrame, back: int, ahead: int, rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """Each block with the ``back`` rows before and the ``ahead`` rows after it; __home is the block a row belongs to."""
    last = F.floor((F.col(RN) + back) / rows_per_block).cast("long")
    first = F.greatest(F.lit(0), F.floor((F.col(RN) - ahead) / rows_per_block)).cast("long")
    return df.withColumn(HOME, F.col(BLOCK)).withColumn(BLOCK, F.explode(F.sequence(first, last)))


def without_halo(df: DataFrame) -> DataFrame:
    return df.where(F.col(HOME) == F.col(BLOCK)).drop(HOME)


def carry(df: DataFrame, per_block: Sequence[Column], carried: Sequence[Column], keys: Sequence[str] = (), backwards: bool = False) -> DataFrame:
    """Joins to each row what ``carried`` makes of the blocks before it (after it if ``backwards``) in its key: one row a block, so small beside the table."""
    order = F.desc(BLOCK) if backwards else F.asc(BLOCK)
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    blocks = df.groupBy(*keys, BLOCK).agg(*per_block)
    return beside(df, materialise(blocks.select(*keys, BLOCK, *[c.over(w).alias(n) for n, c in carried])), [*keys, BLOCK])


def ffill(df: DataFrame, x: str, out: str, many: bool, keys: Sequence[str] = (), backwards: bool = False, limit: int | None = None) -> DataFrame:
    """The last value that isn't null (the next one if ``backwards``), from at most ``limit`` rows away."""
    if limit is not None:
        known = df.withColumn("__known", F.when(F.col(x).isNotNull(), F.struct(F.col(RN).alias("rn"), F.col(x).alias("v"))))
        filled = ffill(known, "__known", "__near", many, keys, backwards)
        return filled.withColumn(out, F.when(F.abs(F.col(RN) - F.col("__near.rn")) <= limit, F.col("__near.v"))).drop("__known", "__near")
    w = block_window(keys)
    if backwards:
        local, edge = F.first(x, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)), F.min_by(x, F.when(F.col(x).isNotNull(), F.col(RN)))
    else:
        local, edge = F.last(x, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.max_by(x, F.when(F.col(x).isNotNull(), F.col(RN)))
    if not many:
        return df.withColumn(out, local)
    joined = carry(df, [edge.alias("__edge")], [("__carry", F.last("__edge", ignorenulls=True))], keys, backwards)
    return joined.withColumn(out, F.coalesce(local, F.col("__carry"))).drop("__carry")


def cumulate(df: DataFrame, x: str, out: str, many: bool, keys: Sequence[str] = (), product: bool = False) -> DataFrame:
    """Running sum or product; null stays null and the total goes on."""
    total, unit = (F.product, 1.0) if product else (F.sum, 0)  # a sum of whole numbers stays whole, in however many blocks
    local = total(x).over(block_window(keys).rowsBetween(Window.unboundedPreceding, 0))
    if not many:
        return df.withColumn(out, F.when(F.col(x).isNotNull(), local))
    joined = carry(df, [total(x).alias("__total")], [("__carry", total("__total"))], keys)
    before = F.coalesce("__carry", F.lit(unit))
    return joined.withColumn(out, F.when(F.col(x).isNotNull(), local * before if product else local + before)).drop("__carry")


def ema(df: DataFrame, x: str, out: str, span: int, many: bool, keys: Sequence[str] = ()) -> DataFrame:
    """Exponential mean with alpha = 2 / (span + 1), starting at the first value; null stays null.

    A value after a gap of g rows meets (1 - alpha)^g of the mean so far, and the two weights are
    scaled to one. So each row is a step y = a y' + b (a null: a = 1, b = 0). Blocks run these steps
    from zero and so are a step each themselves, which are run in the same way.
    """
    alpha = 2.0 / (span + 1)
    valid = F.col(x).isNotNull()
    known = _previous(df, F.when(valid, F.col(RN)), many, keys)
    weight, first, value = F.pow(F.lit(1 - alpha), F.col(RN) - F.col("__before")), F.col("__before").isNull(), F.col(x).cast("double")
    steps = known.withColumns({
        "__a": F.when(~valid, 1.0).when(first, 0.0).otherwise(weight / (weight + alpha)),
        "__b": F.when(~valid, 0.0).when(first, value).otherwise(value * alpha / (weight + alpha)),
    }).drop("__before")
    made = compose(steps, [*keys, BLOCK])
    if many:
        line = block_window(keys)
        blocks = made.groupBy(*keys, BLOCK).agg(F.product("__a").alias("__a"), F.max_by("__y", RN).alias("__b")).withColumn(RN, F.col(BLOCK))
        ends = compose(blocks, keys).select(*keys, BLOCK, F.lag("__y").over(Window.partitionBy(*keys).orderBy(BLOCK)).alias("__in"))
        made = made.withColumn("__run", F.product("__a").over(line.rowsBetween(Window.unboundedPreceding, 0)))
        made = beside(made, materialise(ends), [*keys, BLOCK]).withColumn("__y", F.col("__y") + F.col("__run") * F.coalesce("__in", F.lit(0.0))).drop("__run", "__in")
    return made.withColumn(out, F.when(valid, F.col("__y"))).drop("__a", "__b", "__y")


#: Powers of e by which a chunk of steps may shrink what came before it. Five chunks together leave nothing that a double can hold.
CHUNK, CHUNKS = 150.0, 5


def compose(df: DataFrame, group: Sequence[str]) -> DataFrame:
    """__y: the steps y = __a y' + __b, run along __rn in each ``group`` from y = 0, where 0 <= __a <= 1.

    Steps are cut into chunks within which the product p of the a's stays far from the smallest double, so that y is
    p times the sum of b / p there. Chunks are steps too; what lies more than CHUNKS of them back is multiplied by less
    than the smallest double, so that many rounds along the same order are exact.
    """
    line = Window.partitionBy(*group).orderBy(RN)
    upto, before = line.rowsBetween(Window.unboundedPreceding, 0), line.rowsBetween(Window.unboundedPreceding, -1)
    shrinks = F.least(F.coalesce(-F.ln("__a"), F.lit(CHUNKS * CHUNK)), F.lit(CHUNKS * CHUNK))  # ln(0) is null
    df = df.withColumn("__chunk", F.floor(F.sum(shrinks).over(upto) / CHUNK))
    chunk = Window.partitionBy(*group, "__chunk").orderBy(RN).rowsBetween(Window.unboundedPreceding, 0)
    head = F.lag("__chunk").over(line).eqNullSafe(F.col("__chunk"))
    df = df.withColumns({"__inner": head, "__tail": ~F.lead("__chunk").over(line).eqNullSafe(F.col("__chunk"))})
    df = df.withColumn("__p", F.product(F.when(F.col("__inner"), F.col("__a")).otherwise(1.0)).over(chunk))
    df = df.withColumns({"__z": F.col("__p") * F.sum(F.col("__b") / F.col("__p")).over(chunk), "__s": F.col("__p") * F.first("__a").over(chunk)})
    df = df.withColumn("__y", F.col("__z"))
    for _ in range(CHUNKS + 1):
        df = df.withColumn("__y", F.col("__z") + F.col("__s") * F.coalesce(F.last(F.when(F.col("__tail"), F.col("__y")), ignorenulls=True).over(before), F.lit(0.0)))
    lost = F.max(F.isnan("__b")).over(upto)  # what isn't a number stays so, however many chunks on
    return df.withColumn("__y", F.when(lost, F.lit(float("nan"))).otherwise(F.col("__y"))).drop("__chunk", "__inner", "__tail", "__p", "__z", "__s")


def _previous(df: DataFrame, at: Column, many: bool, keys: Sequence[str]) -> DataFrame:
    """__before: the number of the last row before this one that has a value, over all blocks."""
    local = F.last(at, ignorenulls=True).over(block_window(keys).rowsBetween(Window.unboundedPreceding, -1))
    if not many:
        return df.withColumn("__before", local)
    joined = carry(df, [F.max(at).alias("__edge")], [("__carry", F.max("__edge"))], keys)
    return joined.withColumn("__before", F.coalesce(local, F.col("__carry"))).drop("__carry")


def value_counts(df: DataFrame, x: str, rows_per_block: int = ROWS_PER_BLOCK, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, x, n, upto): each distinct value that isn't null, its rows, and the rows up to and with it in its key."""
    counts = df.where(F.col(x).isNotNull()).groupBy(*keys, F.col(x).alias("x")).agg(F.count(F.lit(1)).alias("n"))
    counts = materialise(counts)
    placed, many = number(counts, "x", keys, rows_per_block=rows_per_block)
    return cumulate(placed, "n", "upto", many, keys).select(*keys, "x", "n", F.col("upto").cast("long").alias("upto"))


def values_at(counts: DataFrame, indices: dict[str, Callable[[int], int]]) -> dict[str, float | None]:
    """For each name the value at an index of the sorted values; the index follows from their number."""
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return counts.agg(*[F.min(F.when(F.col("upto") > index(total), F.col("x"))).alias(name) for name, index in indices.items()]).first().asDict()


def values_at_by_key(counts: DataFrame, indices: dict[str, Callable[[Column], Column]], keys: Sequence[str]) -> DataFrame:
    """(keys, a column for each name): the values at indices of each key's sorted values."""
    totals = materialise(counts.groupBy(*keys).agg(F.sum("n").alias("__total")))
    found = beside(counts, small(totals), keys)
    return found.groupBy(*keys).agg(*[F.min(F.when(F.col("upto") > index(F.col("__total")), F.col("x"))).alias(name) for name, index in indices.items()])
