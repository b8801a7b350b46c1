"""A keyed collection: Parquet in hash buckets of the key, created once, upserted by key, read as its latest state.

An upsert finds the buckets its rows fall into, reads and rewrites these by dynamic partition overwrite and leaves all others
untouched, so that its cost follows the delivery, not the collection. A job that fails leaves the files as they were; they
are replaced when it ends, bucket by bucket. There is one writer at a time, and a frame read before an upsert is read again
after it. Repeating a delivery changes nothing. Vectors, columns that are arrays of floats, are stored as bytes
(`functions.vectors`) and read as arrays; a collection that was created before stores arrays, and goes on to.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threatloom.functions.vectors import VECTOR, packed, unpacked
from threatloom.operators.dedup import first_wins
from threatloom.schemas import DISTINCT_VALUES
from threatloom.session import open_folders, run_dir
from threatloom.sources.state import read_if_present

BUCKETS = 8
#: Rows of one task of a rewrite, about; a bucket of more is dealt to several.
TASK_ROWS = 50_000
#: Files that a task keeps open, each with rows of at most so many bytes in memory; a task with more sorts its rows.
_OPEN_FILES, _BLOCK_BYTES = 16, 32 << 20
_BUCKET = "key_bucket"
_COMING, _STATE, _HELD, _PLACE, _SLICE, _LATE = "__coming", "__state", "__held", "__place", "__slice", "__late"

#: Adds a dear column to a frame, under a name, where a condition holds.
Late = Callable[[DataFrame, str, Column], DataFrame]


class Collection:
    def __init__(
        self, spark: SparkSession, root: str, schema: T.StructType, key: str = "id", buckets: int = BUCKETS
    ):
        """`buckets` counts when the collection is created; about 1 GB each is a good size."""
        self._spark = spark
        self._root = root.rstrip("/")
        self._schema = schema
        self._key = key
        self._buckets = buckets

    def create(self) -> bool:
        """Set up an empty collection; False when it is already there."""
        if self._settings() is not None:
            return False
        empty = self._spark.createDataFrame([], self._table_schema(True))
        empty.write.mode("overwrite").partitionBy(_BUCKET).parquet(self._data())
        settings = self._spark.range(1).select(F.lit(self._buckets).alias("buckets"), F.lit(True).alias("packed"))
        settings.write.json(f"{self._root}/settings")
        return True

    def upsert(
        self, rows: DataFrame, *, newest: Sequence[Column | str] = (), unique: bool = False, stored: bool = False,
        state: Column | None = None, late: tuple[str, Late] | None = None,
    ) -> int:
        """Insert rows, replacing those with the same key; the number of keys that are new or changed.

        `newest` orders rows of one key within this delivery, winner first; `unique` says there is one row per key already.
        The delivery is read twice, once for its keys alone; it is written to the shared folder before unless `stored` says
        that it comes from a table. `late` names a column that `rows` lack and adds it to those written, after they were
        dealt and compared, so that it is neither shuffled nor sorted nor worked out for rows that lose.
        Where `state` is given, a row whose state is older than that of the stored row is left out, so that deliveries may
        come in any order, and rows of the same state do not count as changed. Rows without a key are refused.
        """
        names = [n for n in self._schema.fieldNames() if late is None or n != late[0]]
        if not unique:
            rows = first_wins(rows, [self._key], newest or [F.col(n).desc() for n in names if n != self._key])
        settings = self._settings()
        if settings is None:
            raise ValueError(f"no collection at {self._root}: create it first")
        buckets, _ = settings
        bucket = F.pmod(F.xxhash64(self._key), F.lit(buckets)).cast("int")
        coming = rows.select(*names, bucket.alias(_BUCKET))
        if not stored:
            path = run_dir(self._spark, "delivery")
            coming.write.option("compression", "zstd").parquet(path)
            coming = self._spark.read.schema(coming.schema).parquet(path)
        seen = coming.agg(
            F.count("*").alias("rows"), F.count_if(F.col(self._key).isNull()).alias("keyless"),
            F.collect_set(_BUCKET).alias("buckets"),
        ).first()
        if seen.keyless:
            raise ValueError(f"{seen.keyless} rows without {self._key}; nothing was written")
        if not seen.rows:
            return 0
        held = self._held_in(seen.buckets)
        held_rows = held.count()
        if not held_rows and seen.rows > TASK_ROWS:
            # nothing to compare with, and enough rows for files of every task
            self._write(self._finished(coming.withColumn(_COMING, F.lit(True)), late))
            return seen.rows
        return self._rewrite(self._stored_form(coming), held, -(-(seen.rows + held_rows) // TASK_ROWS), state, late)

    def insert(self, rows: DataFrame) -> None:
        """Add rows of new keys, one for each, as the caller knows them to be: files are added to buckets, none is read or replaced."""
        buckets, _ = self._settings()
        bucket = F.pmod(F.xxhash64(self._key), F.lit(buckets)).cast("int")
        dealt = rows.select(*self._schema.fieldNames(), bucket.alias(_BUCKET)).repartition(_BUCKET)
        self._stored_form(dealt).write.mode("append").option("compression", "zstd").partitionBy(_BUCKET).parquet(self._data())

    def read(self) -> DataFrame:
        """The row of every key."""
        return self._loaded_form(self._load()).drop(_BUCKET)

    def held_in(self, buckets: Sequence[int]) -> DataFrame:
        """Stored rows of some buckets, and no other file."""
        return self._loaded_form(self._held_in(buckets))

    def _held_in(self, buckets: Sequence[int]) -> DataFrame:
        return self._load().where(F.col(_BUCKET).isin(list(buckets)))

    def _rewrite(self, coming: DataFrame, held: DataFrame, tasks: int, state: Column | None, late: tuple[str, Late] | None) -> int:
        stateless = state is None
        both = coming.withColumn(_COMING, F.lit(True)).unionByName(
            held.withColumn(_COMING, F.lit(False)), allowMissingColumns=late is not None
        )
        # one shuffle, by slices of buckets: it serves the comparison by key as well as the write
        slices = F.lit(-(-tasks // self._settings()[0]))
        both = both.withColumn(_SLICE, F.pmod(F.shiftright(F.xxhash64(self._key), 24), slices).cast("int"))
        both = both.withColumn(_STATE, F.lit(None).cast("int") if stateless else state)
        dealt = both.repartition(2 * tasks, _BUCKET, _SLICE) if tasks > 1 else both.repartition(_BUCKET, _SLICE)
        # a key has at most two rows, so that after a row that comes and wins stands the one it replaces
        of_key = Window.partitionBy(_BUCKET, _SLICE, self._key).orderBy(F.col(_STATE).desc_nulls_last(), F.col(_COMING).desc())
        ranked = dealt.withColumns({_HELD: F.lead(F.struct(_STATE)).over(of_key), _PLACE: F.row_number().over(of_key)})
        kept = ranked.where(F.col(_PLACE) == 1)
        same = F.col(_HELD).isNotNull() & F.col(_STATE).eqNullSafe(F.col(f"{_HELD}.{_STATE}"))
        fresh = F.lit(True) if stateless else ~same
        changed = Observation()
        self._write(self._finished(kept.observe(changed, F.count_if(F.col(_COMING) & fresh).alias("rows")), late))
        return changed.get["rows"]

    def _finished(self, kept: DataFrame, late: tuple[str, Late] | None) -> DataFrame:
        """Rows of the table, those that come with the late column added."""
        if late is not None:
            name, add = late
            kept = self._stored_form(add(kept, _LATE, F.col(_COMING)), {_LATE: name})
            held = [F.col(name)] if name in kept.columns else []
            kept = kept.withColumn(name, F.coalesce(F.when(F.col(_COMING), F.col(_LATE)), *held))
        return self._stored_form(kept.select(*self._schema.fieldNames(), _BUCKET))

    def _stored_form(self, rows: DataFrame, names: Mapping[str, str] | None = None) -> DataFrame:
        """The rows with vectors as the table has them; `names` tells which column of it some columns are to become."""
        table, columns = self._table_schema(), {}
        for name in names or rows.columns:
            kind, wanted = rows.schema[name].dataType, table[(names or {}).get(name, name)].dataType
            if isinstance(kind, T.ArrayType) and wanted == T.BinaryType():
                columns[name] = packed(F.col(name))
            elif kind == T.BinaryType() and wanted == VECTOR:
                columns[name] = unpacked(F.col(name))
        return rows.withColumns(columns)

    def _write(self, rows: DataFrame) -> None:
        """Replace the buckets that the rows lie in."""
        vectors = [f.name for f in self._schema.fields if f.dataType == VECTOR]
        plain = {f"parquet.enable.dictionary#{name}": "false" for name in (self._key, *vectors, *DISTINCT_VALUES)}
        plain |= {f"parquet.column.statistics.enabled#{name}": "false" for name in (*vectors, *DISTINCT_VALUES)}
        if vectors:
            plain["parquet.compression.codec.zstd.level"] = "1"  # zeros and places of cells; more gains little
        with open_folders(rows.sparkSession, _OPEN_FILES):
            (
                rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd")
                .option("parquet.block.size", str(_BLOCK_BYTES)).options(**plain).partitionBy(_BUCKET).parquet(self._data())
            )

    def _data(self) -> str:
        return f"{self._root}/data"

    def _table_schema(self, as_bytes: bool | None = None) -> T.StructType:
        """As stored; `as_bytes` is read from the settings unless given."""
        fields = self._schema.fields
        if any(f.dataType == VECTOR for f in fields) and (self._settings()[1] if as_bytes is None else as_bytes):
            fields = [T.StructField(f.name, T.BinaryType()) if f.dataType == VECTOR else f for f in fields]
        return T.StructType([*fields, T.StructField(_BUCKET, T.IntegerType())])

    def _load(self) -> DataFrame:
        return self._spark.read.schema(self._table_schema()).parquet(self._data())

    def _loaded_form(self, rows: DataFrame) -> DataFrame:
        """Stored rows with vectors as the schema has them."""
        stored_as = {f.name: rows.schema[f.name].dataType for f in self._schema.fields}
        return rows.withColumns({
            f.name: unpacked(F.col(f.name)) for f in self._schema.fields if f.dataType != stored_as[f.name]
        })

    def _settings(self) -> tuple[int, bool] | None:
        """Number of buckets and whether vectors are bytes, or None before the collection is created."""
        found = read_if_present(self._spark, f"{self._root}/settings", "buckets int, packed boolean")
        if found is None:
            return None
        row = found.first()
        return row.buckets, bool(row.packed)
