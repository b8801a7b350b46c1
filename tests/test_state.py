"""Upsert and the stored collection."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threatloom.operators.range_join import first_point_in_span
from threatloom.sources.collection import Collection

SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("v", T.StringType())])


def rows(df):
    return {r.id: r.v for r in df.collect()}


def test_create_is_idempotent(spark, tmp_path):
    collection = Collection(spark, str(tmp_path / "c"), SCHEMA)
    assert collection.create()
    assert not collection.create()
    assert collection.read().count() == 0
    assert collection.read().columns == ["id", "v"]


def test_repeated_delivery_changes_nothing(spark, tmp_path):
    collection = Collection(spark, str(tmp_path / "c"), SCHEMA)
    collection.create()
    first = spark.createDataFrame([(1, "a"), (2, "b")], SCHEMA)
    assert collection.upsert(first, state=F.col("v")) == 2
    assert collection.upsert(first, state=F.col("v")) == 0
    assert collection.upsert(spark.createDataFrame([(1, "b")], SCHEMA), state=F.col("v")) == 1
    assert collection.upsert(first, state=F.col("v")) == 0
    assert collection.upsert(first.limit(0), state=F.col("v")) == 0
    assert rows(collection.read()) == {1: "b", 2: "b"}


def bucket_files(root):
    return {str(f): f.stat().st_mtime_ns for f in sorted(root.glob("data/key_bucket=*/*.parquet"))}


def test_untouched_buckets_are_neither_read_nor_written(spark, tmp_path):
    collection = Collection(spark, str(tmp_path / "c"), SCHEMA, buckets=8)
    collection.create()
    collection.upsert(spark.createDataFrame([(i, "a") for i in range(200)], SCHEMA))
    before = bucket_files(tmp_path / "c")
    assert len(before) == 8
    one = spark.createDataFrame([(7, "b")], SCHEMA)
    bucket = one.select(F.pmod(F.xxhash64("id"), F.lit(8))).first()[0]
    held = collection.held_in([bucket])
    assert {f.split("/")[-2] for f in held.inputFiles()} != set() and "PartitionFilters: [isnotnull(key_bucket" in plan(held)
    assert scanned_files(held) == 1
    collection.upsert(one)
    after = bucket_files(tmp_path / "c")
    assert [f for f in before if after.get(f) == before[f]] == [f for f in before if f"key_bucket={bucket}/" not in f]
    assert rows(collection.read()) == {i: "b" if i == 7 else "a" for i in range(200)}


def plan(df):
    return df._jdf.queryExecution().executedPlan().treeString()


def scanned_files(df):
    """Files the one scan of a frame has opened."""
    df.collect()
    node = df._jdf.queryExecution().executedPlan()
    while node.children().size():
        node = node.children().apply(0)
    return node.metrics().get("numFiles").get().value()


def test_a_failed_delivery_leaves_the_collection(spark, tmp_path):
    collection = Collection(spark, str(tmp_path / "c"), SCHEMA)
    collection.create()
    collection.upsert(spark.createDataFrame([(1, "a")], SCHEMA))
    broken = spark.createDataFrame([(1, "b")], SCHEMA).withColumn("v", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        collection.upsert(broken)
    assert rows(collection.read()) == {1: "a"}


def test_buckets_are_those_of_the_creation(spark, tmp_path):
    first = Collection(spark, str(tmp_path / "c"), SCHEMA, buckets=3)
    first.create()
    first.upsert(spark.createDataFrame([(i, "a") for i in range(50)], SCHEMA))
    later = Collection(spark, str(tmp_path / "c"), SCHEMA, buckets=7)
    assert not later.create()
    later.upsert(spark.createDataFrame([(i, "b") for i in range(25)], SCHEMA))
    assert rows(first.read()) == {i: "b" if i < 25 else "a" for i in range(50)}


def test_upsert_needs_a_collection(spark, tmp_path):
    with pytest.raises(ValueError, match="create"):
        Collection(spark, str(tmp_path / "c"), SCHEMA).upsert(spark.createDataFrame([(1, "a")], SCHEMA))


@pytest.mark.parametrize("buckets", [1, 16])
def test_sequence_of_upserts_equals_a_dict(spark, tmp_path, buckets):
    collection = Collection(spark, str(tmp_path / "c"), SCHEMA, buckets=buckets)
    collection.create()
    expected = {}
    for step in range(5):
        batch = {i: f"{step}-{i}" for i in range(step * 3, step * 3 + 6)}
        expected.update(batch)
        collection.upsert(spark.createDataFrame(list(batch.items()), SCHEMA))
    assert rows(collection.read()) == expected


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(
    spans=st.lists(st.tuples(st.integers(0, 1), st.integers(0, 60), st.integers(1, 50)), min_size=1, max_size=30),
    points=st.lists(st.tuples(st.integers(0, 1), st.integers(0, 100)), max_size=30),
    rows=st.sampled_from([3, 7, 1000]),
)
def test_first_point_equals_brute_force(spark, spans, points, rows):
    span_rows = [(n, key, start, start + length) for n, (key, start, length) in enumerate(spans)]
    point_rows = [(key, at, n) for n, (key, at) in enumerate(points)]
    found = first_point_in_span(
        spark.createDataFrame(span_rows, "span long, key int, a long, b long"),
        spark.createDataFrame(point_rows, "key int, at long, name long"),
        ["key"], start="a", end="b", position="at", value=["name"], bin_rows=rows,
    ).collect()
    expected = {}
    for n, key, a, b in span_rows:
        inside = sorted((at, name) for k, at, name in point_rows if k == key and a <= at < b)
        if inside:
            expected[n] = inside[0]
    assert {r.span: (r.at, r.name) for r in found} == expected


def test_rows_without_a_key_are_refused(spark, tmp_path):
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("v", T.StringType())])
    collection = Collection(spark, str(tmp_path / "c"), schema)
    collection.create()
    collection.upsert(spark.createDataFrame([(1, "a")], schema))
    with pytest.raises(ValueError, match="without id"):
        collection.upsert(spark.createDataFrame([(2, "b"), (None, "c")], schema))
    assert [tuple(r) for r in collection.read().collect()] == [(1, "a")]


def test_older_states_are_left_out(spark, tmp_path):
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("v", T.LongType())])
    collection = Collection(spark, str(tmp_path / "c"), schema, buckets=2)
    collection.create()
    for rows in ([(1, 5), (2, 5)], [(1, 4), (2, 6), (3, None)], [(1, 5), (2, 1), (3, 1)]):
        collection.upsert(spark.createDataFrame(rows, schema), state=F.col("v"))
    assert sorted(tuple(r) for r in collection.read().collect()) == [(1, 5), (2, 6), (3, 1)]


def test_large_deliveries_add_late_columns_where_they_are_written(spark, tmp_path, monkeypatch):
    """Beyond the rows of one task: a first delivery is not shuffled, later ones are dealt in slices of buckets, without the late column."""
    from threatloom.sources import collection as module

    monkeypatch.setattr(module, "TASK_ROWS", 20)
    schema = T.StructType([*SCHEMA.fields, T.StructField("w", T.StringType())])
    collection = Collection(spark, str(tmp_path / "c"), schema, buckets=2)
    collection.create()
    frames = []

    def add(df, out, wanted):
        frames.append(df)
        return df.withColumn(out, F.when(wanted, F.concat(F.lit("late "), "v")))

    def deliver(pairs):
        return collection.upsert(spark.createDataFrame(pairs, SCHEMA), state=F.col("v"), late=("w", add))

    assert deliver([(i, "a") for i in range(200)]) == 200
    assert "Exchange" not in plan(frames[0])
    assert deliver([(i, "b" if i % 3 else "a") for i in range(100, 260)]) == 160 - 33
    want = {i: "b" if i >= 100 and i % 3 else "a" for i in range(260)}
    assert {r.id: (r.v, r.w) for r in collection.read().collect()} == {i: (v, f"late {v}") for i, v in want.items()}
    assert len(list((tmp_path / "c").glob("data/key_bucket=*/*.parquet"))) > 2


def test_stream_lands_files_of_bounded_size(spark, sf_dir, monkeypatch):
    """More records land as more files, written without a sort, read in as many turns, with the same rows."""
    from threatloom.queries import state

    plain = sorted(map(str, state.stream_ingest(spark, sf_dir).collect()))
    turns, written = [], []
    run, stream = state.run_available, state.feed_stream
    monkeypatch.setattr(state, "_FILE_RECORDS", 50)
    monkeypatch.setattr(state, "feed_stream", lambda s, path, max_files: (turns.append(max_files), stream(s, path, max_files))[1])
    monkeypatch.setattr(state, "run_available", lambda stream, collection, checkpoint: (
        written.append(spark.read.text(checkpoint.removesuffix("checkpoint") + "landed").select("file").distinct().count()),
        run(stream, collection, checkpoint),
    ))
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    assert sorted(map(str, state.stream_ingest(spark, sf_dir).collect())) == plain
    assert turns == [-(-rows // 200)] and written[0] > 4


@pytest.mark.parametrize("as_bytes", [True, False])
def test_vectors_are_stored_as_bytes(spark, tmp_path, as_bytes):
    """Vectors are read as they were delivered, late or not; a collection that was created with arrays goes on with them."""
    from threatloom.operators.embed import embed_text

    schema = T.StructType([*SCHEMA.fields, T.StructField("e", T.ArrayType(T.FloatType()))])
    root = tmp_path / "c"
    collection = Collection(spark, str(root), schema, buckets=2)
    if as_bytes:
        collection.create()
    else:
        (root / "settings").mkdir(parents=True)
        (root / "settings" / "part.json").write_text('{"buckets":2}\n')
        empty = spark.createDataFrame([], T.StructType([*schema.fields, T.StructField("key_bucket", T.IntegerType())]))
        empty.write.partitionBy("key_bucket").parquet(str(root / "data"))
    collection.upsert(spark.createDataFrame([(1, "a", [1.0, 0.0]), (2, "b", None), (3, "c", [])], schema))

    def add(df, out, wanted):
        texts = df.withColumn("text", F.when(wanted, F.col("v")))
        return embed_text(texts, "text", out, skip_null=True, packed=True).drop("text")

    assert collection.upsert(spark.createDataFrame([(2, "word"), (4, "other words")], SCHEMA), late=("e", add)) == 2
    collection.insert(spark.createDataFrame([(5, "d", [0.5] * 3)], schema))
    read = collection.read()
    assert read.schema == schema
    found = {r.id: (r.v, r.e) for r in read.collect()}
    assert found[1] == ("a", [1.0, 0.0]) and found[3] == ("c", []) and found[5] == ("d", [0.5] * 3)
    assert [max(found[2][1]), sum(found[2][1]), len(found[2][1])] == [1.0, 1.0, 384] and len(found[4][1]) == 384
    assert {r.id for r in collection.held_in([0, 1]).where(F.size("e") == 384).collect()} == {2, 4}
    kind = spark.read.parquet(str(root / "data")).schema["e"].dataType
    assert kind == (T.BinaryType() if as_bytes else schema["e"].dataType)
