"""Key lookups that stay whole and balanced whatever the key distribution."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventcast.session import stage, stage_table

BROADCAST_BYTES = 64 * 1024 * 1024
HOT_KEYS = 1000


def _content_bytes(value: Column, kind: T.DataType) -> Column:
    """Bytes of a value by its content, nested ones included; 16 for anything of fixed width."""
    none = F.lit(0).cast("long")
    if isinstance(kind, (T.StringType, T.BinaryType)):
        size = 16 + F.octet_length(value)
    elif isinstance(kind, T.ArrayType):
        nested = isinstance(kind.elementType, (T.StringType, T.BinaryType, T.ArrayType, T.MapType, T.StructType))
        size = 16 + (F.aggregate(value, none, lambda total, v: total + _content_bytes(v, kind.elementType))
                     if nested else F.size(value) * 16)
    elif isinstance(kind, T.MapType):
        entries = T.ArrayType(T.StructType([T.StructField("key", kind.keyType), T.StructField("value", kind.valueType)]))
        size = _content_bytes(F.map_entries(value), entries)
    elif isinstance(kind, T.StructType):
        size = none
        for field in kind.fields:
            size = size + _content_bytes(value.getField(field.name), field.dataType)
    else:
        return F.lit(16).cast("long")
    return F.coalesce(size.cast("long"), F.lit(16).cast("long"))


def _row_bytes(df: DataFrame) -> Column:
    row = F.lit(16).cast("long")
    for field in df.schema.fields:
        row = row + _content_bytes(F.col(f"`{field.name}`"), field.dataType)
    return row


def table_bytes(df: DataFrame) -> int:
    """Measured size of a staged table, by the content of its values."""
    return int(df.agg(F.coalesce(F.sum(_row_bytes(df)), F.lit(0))).first()[0])


def _bytes_by(df: DataFrame, column: str) -> dict[str, int]:
    """``table_bytes`` per value of a column of few values."""
    return {r[0]: int(r[1]) for r in df.groupBy(column).agg(F.sum(_row_bytes(df))).collect()}


def attach(
    facts: DataFrame,
    lookup: DataFrame,
    on: str | Sequence[str],
    how: str = "left",
    *,
    staged: bool = False,
    broadcast_bytes: int = BROADCAST_BYTES,
    hot_keys: int = HOT_KEYS,
) -> DataFrame:
    """Join ``facts`` to a ``lookup`` that is unique on ``on``.

    The lookup is computed once and measured. Up to ``broadcast_bytes`` it is broadcast and
    the facts are not shuffled at all. Beyond that there is one shuffle join. Keys holding at least
    1/``hot_keys`` of the facts (so at most ``hot_keys`` of them) are dealt over several parts by a
    hash of the row, and only their lookup rows are repeated, once per part; rows with a null key,
    which match nothing, are dealt out too. The facts stand in the plan once.
    """
    keys = [on] if isinstance(on, str) else list(on)
    lookup = lookup if staged else stage(lookup)
    if table_bytes(lookup) <= broadcast_bytes:
        return facts.join(F.broadcast(lookup), keys, how)

    # Both sides must agree on the hot keys, so they are fixed by a staged table.
    counts = stage(facts.groupBy(*keys).count().dropna(subset=keys))
    total = counts.agg(F.coalesce(F.sum("count"), F.lit(0))).scalar()
    hot = stage(counts.filter(F.col("count") * hot_keys >= total).select(
        *keys, F.ceil(F.col("count") * hot_keys / total).cast("int").alias("_parts")))
    hot = F.broadcast(hot)
    missing = F.lit(False)
    for key in keys:
        missing = missing | F.col(key).isNull()
    dealt = [F.col(f"`{f.name}`") for f in facts.schema.fields if "map<" not in f.dataType.simpleString()]
    parts = F.when(missing, F.lit(hot_keys)).otherwise(F.coalesce("_parts", F.lit(1)))
    spread = facts.join(hot, keys, "left").withColumn("_part", F.pmod(F.xxhash64(*dealt), parts).cast("int"))
    copies = lookup.join(hot, keys).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    repeated = lookup.withColumn("_part", F.lit(0)).unionByName(copies.filter("_part > 0").drop("_parts"))
    return spread.drop("_parts").join(repeated, [*keys, "_part"], how).drop("_part")


def attach_codes(
    facts: DataFrame,
    dictionary: DataFrame,
    columns: dict[str, str],
    code: str = "code",
    *,
    null_value: str | None = None,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Look several columns of each row up in one dictionary (column_name, value, ``code``), staged and unique.

    ``columns`` maps a column to the name of its result; values without an entry and nulls get a null; with ``null_value`` a null counts as that text. The dictionary
    is measured once. The columns of few values, as many as fit ``broadcast_bytes`` together, are sent out once, as one hash
    table that each of them probes, and no row moves. One column beyond that is joined as it is, skew-safe; several are
    melted to (row, column, value), joined once and pivoted back by row: one join and two shuffles whatever their number.
    """
    columns = {c: out for c, out in columns.items() if c in facts.columns}

    def text(c: str) -> Column:
        value = F.col(f"`{c}`").cast("string")
        return value if null_value is None else F.coalesce(value, F.lit(null_value))

    entry = F.concat(F.col("column_name"), F.lit("="), F.col("value"))
    wanted = dictionary.filter(F.col("column_name").isin(*columns)) if columns else dictionary.limit(0)
    sizes = _bytes_by(wanted, "column_name")
    small, room = [], broadcast_bytes
    for c in sorted(columns, key=lambda c: sizes.get(c, 0)):
        room -= sizes.get(c, 0)
        if room < 0:
            break
        small.append(c)
    large = {c: out for c, out in columns.items() if c not in small}
    before = facts.columns
    table = F.broadcast(wanted.filter(F.col("column_name").isin(*small)).select(entry.alias("_entry"), F.col(code).alias("_code")))
    for c in [c for c in columns if c in small]:
        probe = F.concat(F.lit(f"{c}="), text(c))
        facts = facts.withColumn("_probe", probe).join(table, F.col("_probe") == F.col("_entry"), "left")
        facts = facts.drop("_probe", "_entry").withColumnRenamed("_code", columns[c])
    if len(large) == 1:
        (c, out), = large.items()
        lookup = wanted.filter(F.col("column_name") == c).select(F.col("value").alias("_probe"), F.col(code).alias(out))
        facts = attach(facts.withColumn("_probe", text(c)), lookup, "_probe", staged=True, broadcast_bytes=broadcast_bytes).drop("_probe")
    elif large:
        # The row numbers must not change between the two readings.
        numbered = stage_table(facts.withColumn("_row", F.monotonically_increasing_id()))
        cells = F.array(*[
            F.struct(F.lit(c).alias("column_name"), text(c).alias("value")) for c in large])
        melted = numbered.select("_row", F.inline(cells)).filter(F.col("value").isNotNull())
        wide = wanted.filter(F.col("column_name").isin(*large))
        found = attach(melted, wide, ["column_name", "value"], "inner", staged=True, broadcast_bytes=broadcast_bytes)
        pivoted = found.groupBy("_row").agg(*[
            F.max(F.when(F.col("column_name") == c, F.col(code))).alias(out) for c, out in large.items()])
        facts = numbered.join(pivoted, "_row", "left").drop("_row")
    return facts.select(*[F.col(f"`{c}`") for c in before], *columns.values())


BITMAP_BITS = 32768  # bits of one bitmap of the aggregate
BITS_PER_KEY = 16


def _bit(value: Column, bitmaps: int) -> Column:
    """Place of a key among all bits, from 1."""
    return F.pmod(F.xxhash64(value), F.lit(bitmaps * BITMAP_BITS)) + 1


def prefilter(facts: DataFrame, keys: DataFrame, on: str, size: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``facts`` without most rows whose ``on`` is not among ``keys``; every row whose key is there stays.

    The keys become hashed bitmaps, built in parallel and broadcast: ``BITS_PER_KEY`` bits a key, where the keys themselves
    would take dozens of bytes, so about one row in sixteen of the others remains for the exact join behind. ``size`` is
    the number of keys; beyond ``limit`` bytes of bitmaps the rows are returned as they are.
    """
    bitmaps = max(1, -(-size * BITS_PER_KEY // BITMAP_BITS))
    if bitmaps * (BITMAP_BITS // 8) > limit:
        return facts
    place = _bit(F.col(on), bitmaps)
    built = keys.select(place.alias("_place")).groupBy(F.bitmap_bucket_number("_place").alias("_bitmap")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("_place")).alias("_bits"))
    marked = facts.withColumn("_place", place).withColumn("_bitmap", F.bitmap_bucket_number("_place"))
    marked = marked.join(F.broadcast(built), "_bitmap")
    at = F.bitmap_bit_position("_place")
    byte = F.conv(F.hex(F.substring("_bits", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.pmod(F.floor(byte / F.pow(F.lit(2.0), F.pmod(at, F.lit(8)))), F.lit(2)) == 1
    return marked.filter(hit).select(*facts.columns)
