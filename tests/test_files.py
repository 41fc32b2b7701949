"""The file table: footers, failures, plans over files, scans of what they choose."""

import pathlib

import pytest
from pyspark.sql import functions as F

from evtlake.functions import codes
from evtlake.sources import files, scan, tables

S = codes.SENSOR_COLUMNS


def events(spark, ids, **changes):
    full = spark.createDataFrame([(i,) for i in ids], "event_id long").withColumns({
        **{c: F.array(F.lit(1.0), F.lit(2.0)) for c in S.values()}, **{c: F.col("event_id") * 1.5 for c in codes.TRUTH_COLUMNS}, codes.MORPHOLOGY_COLUMN: F.lit("0T1C")})
    return full.withColumns(changes).coalesce(1)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("files")
    for i in range(3):
        events(spark, range(10 * i, 10 * i + 4 + i)).sortWithinPartitions("event_id").write.parquet(f"{root}/21217/f{i}")
    events(spark, range(100, 105), mc_primary_energy=(F.col("event_id") * 0.5).cast("float"), **{S["t20"]: F.array(F.lit(3).cast("float"))}).write.parquet(f"{root}/charm/a_float")
    events(spark, range(110, 113)).drop(S["t_std"], codes.MORPHOLOGY_COLUMN).write.parquet(f"{root}/charm/b_old")
    events(spark, range(120, 123), mc_primary_energy=F.lit("high")).write.parquet(f"{root}/charm/c_text")
    broken = pathlib.Path(root, "99999")
    broken.mkdir()
    (broken / "cut.parquet").write_bytes(b"PAR1 and no footer")
    (broken / "noise.parquet").write_bytes(b"noise" * 100)
    events(spark, []).write.parquet(f"{root}/none")
    return str(root)


@pytest.fixture(scope="module")
def table(spark, folder):
    found = files.file_table(spark, [folder])
    found.write.parquet(f"{folder}-table")
    return spark.read.parquet(f"{folder}-table")


def test_footers(table):
    rows = {"/".join(r.file.split("/")[-3:-1]): r for r in table.collect()}
    assert [rows[f"21217/f{i}"].rows for i in range(3)] == [4, 5, 6]
    good = rows["21217/f0"]
    assert good.error is None and {c.name for c in good.columns} == {"event_id", *scan.REQUIRED} and good.bytes > 0
    assert [(g.first, g.rows) for g in good.row_groups] == [(0, 4)]
    assert rows["21217/f0"].version == rows["21217/f1"].version != rows["charm/a_float"].version
    assert rows["charm/c_text"].error == "no numbers in mc_primary_energy"
    assert table.where("error is not null").count() == 3 == files.failures(table).count()


def test_bad_files_fail_alone(spark, folder, table):
    for found in (files.scan_files(spark, table, ["event_id"], file_columns=True), scan.scan_versions(spark, [folder], ["event_id"], True)):
        rows = {r.event_id: r for r in found.collect()}
        assert sorted(rows) == [*range(4), *range(10, 15), *range(20, 26), *range(100, 105), 110, 111, 112]
        assert rows[102].mc_primary_energy == 51.0 and rows[12].mc_primary_energy == 18.0
        assert rows[102][S["t20"]] == [3.0] and rows[111][S["t_std"]] == [] and rows[111][codes.MORPHOLOGY_COLUMN] == "Unknown"
        assert rows[12].row_index == 2 and "/f1/" in rows[12].file_path


def test_manifest_counts_failed_files(spark, table):
    index = files.scan_files(spark, table, ["event_id"], file_columns=True).withColumn("dataset_id", F.when(F.col("file_path").contains("21217"), 21217).otherwise(0).cast("long"))
    rows = {r.dataset_id: r for r in tables.dataset_manifest(index, files=table).collect()}
    assert (rows[99999].events, rows[99999].failed, rows[99999].files, rows[99999].failed_files) == (0, 1, 2, 2)
    assert (rows[21217].events, rows[21217].sensors, rows[21217].failed_files) == (15, 30, 0)
    assert (rows[None].events, rows[None].failed_files, rows[None].is_total) == (23, 3, 1)


def test_one_file_of_many_parts(spark, tmp_path):
    """A file of all rows that no task holds whole is one file of the table, with all its rows."""
    from pyarrow import dataset
    root = f"{tmp_path}/whole/99999"
    events(spark, range(20)).withColumn("mc_primary_energy", F.lit("high")).repartition(4).write.parquet(f"{root}/_rows")
    files.write_whole(spark, f"{root}/_rows", f"{root}/part-0.parquet")
    (found,) = files.file_table(spark, [f"{tmp_path}/whole"]).collect()
    assert (found.rows, found.error, len(found.row_groups)) == (20, "no numbers in mc_primary_energy", 4)
    assert sorted(dataset.parquet_dataset(f"{root}/part-0.parquet").to_table(columns=["event_id"])["event_id"].to_pylist()) == list(range(20))


def test_the_unusable_version_is_not_read_by_one_task(spark):
    """Its rows lie in several parts, and it is still one file."""
    from evtlake.surrogate import data
    root = data.version_files(spark, "/root/testdata/sf0.01").removeprefix("file:")
    (bad,) = files.file_table(spark, [f"{root}/v3"]).collect()
    good = files.file_table(spark, [data.source_files(spark, "/root/testdata/sf0.01")]).agg(F.sum("rows")).first()[0]
    assert bad.rows == good and len(list(pathlib.Path(f"{root}/v3/99999/_rows").glob("*.parquet"))) > 1
    assert max(g.rows for g in bad.row_groups) < good


def test_only_new_files_are_read_again(spark, tmp_path, monkeypatch):
    root = f"{tmp_path}/grow"
    for i in range(3):
        events(spark, range(i + 1)).write.parquet(f"{root}/{i}")
    first = files.file_table(spark, [root])
    first.write.parquet(f"{tmp_path}/t1")
    known = spark.read.parquet(f"{tmp_path}/t1").withColumn("version", F.lit("as it was"))
    events(spark, range(9)).write.parquet(f"{root}/3")
    (gone,) = pathlib.Path(f"{root}/0").glob("*.parquet")
    gone.unlink()
    rows = {r.rows: r.version for r in files.file_table(spark, [root], known).collect()}
    assert sorted(rows) == [2, 3, 9] and rows[2] == rows[3] == "as it was" != rows[9]


def test_plans(spark, table):
    good = files.usable(table).where("rows > 0")
    paths = sorted(r.file for r in good.collect())
    names = lambda df: sorted(r.file for r in df.collect())
    assert names(files.in_range(good, 1, 4)) == scan.choose_range(paths, 1, 4)
    assert names(files.per_folder(good, 1, 3)) == scan.choose_per_dir(paths, 1, 3)
    sides = {r.file: r.split for r in files.split(good, 0.4, 3).collect()}
    train, val = scan.choose_split(paths, 0.4, 3)
    assert sorted(f for f, s in sides.items() if s == "train") == train and sorted(f for f, s in sides.items() if s == "val") == val
    listed = files.split(good, train=["*21217/f[01]*"], valid=["*charm*"])
    assert sorted((r.split, r.rows) for r in listed.collect()) == [("train", 4), ("train", 5), ("val", 3), ("val", 5)]
    recipe = (scan.Source("tracks", "21217", files=(1, 3)), scan.Source("charm", "charm", starting_only=True))
    mixed = files.mix(good, recipe).collect()
    chosen = scan.choose_mix(paths, recipe)
    assert {n: sorted(r.file for r in mixed if r.source == n) for n in ("tracks", "charm")} == chosen
    assert all(r.only_starting == (r.source == "charm") for r in mixed)


def test_other_files_are_not_opened(spark, table):
    chosen = files.in_range(files.usable(table).where("rows > 0"), 0, 2)
    found = files.scan_files(spark, chosen, ["event_id"], carry=["rows"])
    opened = {"/" + f.split(":", 1)[1].lstrip("/") for f in found.inputFiles() if "-table" not in f}
    assert opened == {"/" + r.file.split(":", 1)[1].lstrip("/") for r in chosen.collect()}
    assert sorted((r.event_id, r.rows) for r in found.select("event_id", "rows").collect())[0] == (0, 4)
    assert "event_id" in found.columns and "file_path" not in found.columns


@pytest.mark.parametrize("limit", [0, 1, 5, 100])
def test_first_rows(spark, table, limit):
    found = files.scan_files(spark, table, ["event_id"], file_columns=True, limit=limit).collect()
    expected = [i for ids in (range(4), range(10, 15), range(20, 26), range(100, 105), range(110, 113)) for i in list(ids)[:limit]]
    assert sorted(r.event_id for r in found) == expected
    assert all(r.row_index == r.event_id % 10 for r in found)
    if limit == 5:
        old = next(r for r in found if r.event_id == 111)
        assert old[S["x"]] == [1.0, 2.0] and old[S["t_std"]] == [] and old[codes.MORPHOLOGY_COLUMN] == "Unknown"


def test_first_rows_leave_later_row_groups_alone(spark, tmp_path):
    import pyarrow as pa
    from pyarrow import parquet
    path = tmp_path / "groups.parquet"
    with parquet.ParquetWriter(path, pa.schema([("event_id", pa.int64()), ("mc_primary_energy", pa.float64())])) as out:
        for g in range(4):
            out.write_table(pa.table({"event_id": range(10 * g, 10 * g + 10), "mc_primary_energy": [1.0] * 10}), row_group_size=10)
    data = bytearray(path.read_bytes())
    second = parquet.ParquetFile(path).metadata.row_group(2).column(0).data_page_offset
    data[second:second + 40] = b"\xff" * 40
    path.write_bytes(data)
    found = files.scan_files(spark, files.file_table(spark, [str(tmp_path)]), ["event_id"], limit=15)
    assert sorted(r.event_id for r in found.collect()) == list(range(15))


@pytest.mark.parametrize("few", [100_000, 0])
def test_positions(spark, table, few, monkeypatch):
    monkeypatch.setattr(files.ordering, "BROADCAST_KEYS", few)
    asked = spark.createDataFrame([(i,) for i in (0, 3, 4, 8, 9, 14, 15, 22, 23, 99)], "position long")
    found = sorted((r.position, r.file.split("/")[-2], r.row_index) for r in files.locate(table, asked).collect())
    assert found == [(0, "f0", 0), (3, "f0", 3), (4, "f1", 0), (8, "f1", 4), (9, "f2", 0), (14, "f2", 5), (15, "a_float", 0), (22, "b_old", 2)]
    limited = sorted((r.position, r.file.split("/")[-2], r.row_index) for r in files.locate(table, asked, limit=4).collect())
    assert limited[:4] == [(0, "f0", 0), (3, "f0", 3), (4, "f1", 0), (8, "f2", 0)]


def test_no_files(spark, folder):
    with pytest.raises(ValueError):
        files.scan_files(spark, files.file_table(spark, [f"{folder}/99999"]))
    assert files.file_table(spark, [f"{folder}/none"]).first().rows == 0


def test_slices_open_the_files_that_hold_them(spark, tmp_path):
    rng = __import__("random").Random(4)
    sizes = [rng.randrange(0, 9) for _ in range(400)]
    starts = [sum(sizes[:i]) for i in range(400)]
    index = spark.createDataFrame([(i, 5 if i < 300 else 6, starts[i], starts[i] + sizes[i]) for i in range(400)], "event_id long, dataset_id long, sensor_start_idx long, sensor_end_idx long")
    rows = [(5 if i < 300 else 6, starts[i] + k, float(10 * i + k)) for i in range(400) for k in range(sizes[i])]
    rng.shuffle(rows)
    sensors = spark.createDataFrame(rows, "dataset_id long, sensor_idx long, c_total double")
    path = f"{tmp_path}/t"
    tables.write_event_tables(index, sensors, path, zone=128)
    zones = spark.read.parquet(f"{path}/zones").orderBy("dataset_id", "first").collect()
    assert sum(z.rows for z in zones) == len(rows) and len(zones) > 8
    assert all(z.last - z.first + 1 == z.rows <= 128 for z in zones)
    for some in ([7], [7, 8, 150], [399], list(range(250, 320)), [i for i in range(400) if sizes[i] == 0][:2], list(range(400))):
        found = tables.read_slices(spark, path, index.where(F.col("event_id").isin(some)), ["c_total"])
        assert sorted((r.event_id, r.pos, r.c_total) for r in found.collect()) == [(i, k, float(10 * i + k)) for i in some for k in range(sizes[i])]
        opened = {f.rsplit("/", 1)[-1] for f in found.select("c_total").inputFiles() if "/sensors/" in f}
        held = {z.file.rsplit("/", 1)[-1] for z in zones for i in some if sizes[i] and z.dataset_id == (5 if i < 300 else 6) and z.first < starts[i] + sizes[i] and z.last >= starts[i]}
        assert opened == held


def test_lookup_over_many_blocks(spark, monkeypatch):
    from evtlake.plans import lookup
    monkeypatch.setattr(lookup, "RUN", 4)
    intervals = spark.createDataFrame([(1, 0, 300, "a"), (1, 300, 305, "b"), (1, 600, 900, "c"), (2, 10, 20, "d")], "k int, s long, e long, name string")
    points = spark.range(0, 1000, 7).crossJoin(spark.createDataFrame([(1,), (2,)], "k int")).withColumnRenamed("id", "p")
    found = {(r.k, r.p): r.name for r in lookup.interval_lookup(points, "p", intervals, "s", "e", 10, ["k"]).collect()}
    name = lambda k, p: next((n for kk, s, e, n in [(1, 0, 300, "a"), (1, 300, 305, "b"), (1, 600, 900, "c"), (2, 10, 20, "d")] if kk == k and s <= p < e), None)
    assert found == {(k, p): name(k, p) for k in (1, 2) for p in range(0, 1000, 7) if name(k, p)}


def test_sources_meet_their_sensors_once(spark, monkeypatch):
    """Three folders of sources are one pass over the sensors, not one each."""
    from evtlake.surrogate import data
    kind, passes = type(spark.range(0).write), []
    write = kind.parquet
    monkeypatch.setattr(kind, "parquet", lambda self, *a, **k: (passes.append(any("lineitem" in f for f in self._df.inputFiles())), write(self, *a, **k))[1])
    monkeypatch.setattr(data, "_written", {})
    found = spark.read.parquet(*data.source_folders(spark, "/root/testdata/sf0.001"))
    assert sum(passes) == 1 and found.where("chunk = 0").count() == spark.read.parquet("/root/testdata/sf0.001/orders.parquet").count()
