"""Queries on sources, labels, nesting, batches, checks and sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from evtlake.functions import codes
from evtlake.operators import labels, nested, quality, sampling
from evtlake.plans import ordering
from evtlake.sources import files, scan, tables
from evtlake.surrogate import views as v
from evtlake.surrogate.registry import query, r, rounded

S = codes.SENSOR_COLUMNS
NAMED = {"Background": 0, "BackGround": 0, "0T0C": 0, "1T0C": 0, "0T1C": 1, "0TnC": 1, "1T1C": 2, "1TnC": 2, "2TnC": -1}
CODED = {0: 0, 1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: -1}


def as_long(expression: str) -> str:
    """Oracle integers as wide as the results."""
    return f"CAST({expression} AS BIGINT)"


RAW = as_long(
    "CASE mc_event_morphology WHEN '0T0C' THEN 0 WHEN '0T1C' THEN 1 WHEN '0TnC' THEN 2 WHEN '1T0C' THEN 3 "
    "WHEN '1T1C' THEN 4 WHEN '1TnC' THEN 5 WHEN '2TnC' THEN 6 WHEN 'Background' THEN 7 WHEN 'BackGround' THEN 7 "
    "ELSE -1 END")
TOPO = as_long(
    "CASE WHEN mc_event_morphology IN ('0T0C','1T0C','Background','BackGround') THEN 0 "
    "WHEN mc_event_morphology = '0T1C' THEN 1 WHEN mc_event_morphology IN ('0TnC','1T1C','1TnC','2TnC') THEN 2 "
    "ELSE -1 END")
START = "mc_event_morphology IN ('0T1C','0TnC','1T1C','1TnC','2TnC')"
DATASET = as_long("CASE dir WHEN '/data/v1/21217/' THEN 21217 WHEN '/data/v2/21316_extended/' THEN 21316 ELSE 0 END")
LABEL = as_long(f"CASE WHEN {START} THEN 1 ELSE 0 END")
WEIGHT = (f"CASE WHEN {START} AND mc_primary_dir_z > 0 THEN CASE WHEN mc_primary_energy >= 1e6 THEN 20.0e0 "
          "WHEN mc_primary_energy >= 1e5 THEN 10.0e0 WHEN mc_primary_energy >= 1e4 THEN 3.0e0 ELSE 1.0e0 END ELSE 1.0e0 END")
CATEGORY = (f"CASE WHEN {START} AND mc_primary_dir_z > 0 THEN CASE WHEN mc_primary_energy >= 1e6 THEN 'very_high_upgoing' "
            "WHEN mc_primary_energy >= 1e5 THEN 'high_upgoing' WHEN mc_primary_energy >= 1e4 THEN 'med_upgoing' "
            f"ELSE 'low_upgoing' END WHEN {START} THEN 'starting_downgoing' ELSE 'background' END")
NESTED = "se.pos // 65536 AS chunk"


def full_events(spark, sf):
    """Non-empty events with sensor statistics and codes."""
    kept, _ = labels.drop_empty_events(v.events_with_stats(spark, sf), F.col("num_sensors"))
    return v.in_blocks(labels.morphology_codes(kept))


FOLDERS = {"/data/charm/": "charm", "/data/v1/21217/": "v1/21217", "/data/v2/21316_extended/": "v2/21316_extended"}
PARTS = sorted(f"part_{i}.parquet" for i in range(20))
TABLE_ZONE = 65_536
#: Event ids of one ordering block of a source file, which has one of every 60 events.
TABLE_BLOCK = 60 * v.EVENT_BLOCK
_written: dict[tuple[str, str, str], str] = {}


def once(spark, sf, name, write):
    """The folder that ``write`` fills, once per session: sources are given to a query as files."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _written:
        path = ordering.scratch_path(spark, name)
        write(path)
        _written[key] = path
    return _written[key]


def source_files(spark, sf):
    """Nested events as files, the form that sources arrive in: three folders of up to 20 files, numbered as their names are ordered.

    Events meet their sensors once, for all folders, in a table of raw columns; the sensor lists are computed where they are written.
    """
    def write(path):
        events = v.raw_nested(spark, sf).selectExpr("*", f"{v.EVENT['dir']} AS dir", f"{v.EVENT['file_path']} AS file_path")
        part = F.array_position(F.array(*map(F.lit, PARTS)), F.substring_index("file_path", "/", -1)) - 1
        folder = F.array_position(F.array(*map(F.lit, FOLDERS)), F.col("dir"))
        kept, columns = ordering.scratch_path(spark, "nested"), [c for c in events.columns if c not in ("dir", "file_path")]
        events.select(*columns, part.cast("int").alias("_part"), folder.alias("_folder")).write.partitionBy("_folder").parquet(kept, compression="zstd")
        stored = spark.read.parquet(kept)
        for number, name in enumerate(FOLDERS.values(), 1):
            rows = stored.where(F.col("_folder") == number).drop("_folder")
            rows = rows.repartitionById(len(PARTS), "_part").sortWithinPartitions("o_orderkey", "chunk")
            v.computed(rows).withColumn("origin", F.col("file_path")).drop("file_path").write.parquet(f"{path}/{name}", compression="zstd")
    return once(spark, sf, "sources", write)


def source_folders(spark, sf):
    return [f"{source_files(spark, sf)}/{name}" for name in FOLDERS.values()]


def source_table(spark, sf):
    """The files of the sources as their footers describe them."""
    path = once(spark, sf, "file-table", lambda path: files.file_table(spark, [source_files(spark, sf)]).write.parquet(path))
    return spark.read.parquet(path)


def version_files(spark, sf):
    """Sources of three versions, one without some columns and with other types, and a fourth whose coordinates are no numbers."""
    def write(path):
        full = spark.read.parquet(*source_folders(spark, sf)).select("event_id", "chunk", "dir", *scan.REQUIRED)
        changes = {
            "/data/v1/21217/": full,
            "/data/v2/21316_extended/": full.drop(codes.MORPHOLOGY_COLUMN, S["c_100ns"], "mc_primary_dir_x").withColumns({
                "mc_primary_dir_z": F.col("mc_primary_dir_z").cast("float"), S["t_std"]: F.col(S["t_std"]).cast("array<float>"),
                S["t_last"]: F.col(S["t_last"]).cast("array<int>")}),
            "/data/charm/": full.withColumns({
                S["x"]: F.when(F.col("event_id") % 10 != 0, F.col(S["x"])),
                "mc_primary_energy": F.when(F.col("event_id") % 10 != 1, F.col("mc_primary_energy"))})}
        for name, df in changes.items():
            df.where(F.col("dir") == name).drop("dir").write.parquet(f"{path}/{FOLDERS[name]}", compression="zstd")
        rows = f"{path}/v3/99999/_rows"
        full.drop("dir").withColumn(S["x"], F.col(S["x"]).cast("array<string>")).write.parquet(rows, compression="zstd")
        files.write_whole(spark, rows, f"{path}/v3/99999/part-0.parquet")
    return once(spark, sf, "versions", write)


def source_name():
    """The name that a source file stands for, which does not change when the files are written anew."""
    folder = F.regexp_replace("dir", "^.*/(charm|v1/21217|v2/21316_extended)$", "/data/$1/")
    return F.concat(folder, F.element_at(F.array(*map(F.lit, PARTS)), F.regexp_extract("file", "part-([0-9]+)-", 1).cast("int") + 1))


def first_chunks(found):
    """Of an event that takes several rows, the first one."""
    return found.where("chunk = 0").drop("chunk")


# --- sources ------------------------------------------------------------------------


@query(v.sql(
    "SELECT ev.event_id, coalesce(n.chunk,0) AS chunk, coalesce(n.n,0) AS n_points, round(coalesce(n.c,0),4) AS charge, "
    "round(mc_primary_energy,4) AS energy, mc_event_morphology AS morphology FROM ev LEFT JOIN "
    f"(SELECT event_id, {NESTED}, count(*) AS n, sum(c_total) AS c FROM se GROUP BY 1,2) n USING (event_id)", "ev", "se"))
def scan_events(spark, sf):
    found = scan.scan_events(spark, source_folders(spark, sf), ["event_id", "chunk"])
    return found.select(
        "event_id", "chunk", F.size(S["x"]).cast("long").alias("n_points"),
        r(F.aggregate(S["c_total"], F.lit(0.0), lambda a, c: a + c), 4, "charge"),
        r("mc_primary_energy", 4, "energy"), F.col(codes.MORPHOLOGY_COLUMN).alias("morphology"))


@query(v.sql(
    "SELECT ev.event_id, coalesce(n.chunk,0) AS chunk, "
    "CASE WHEN dir='/data/charm/' AND event_id % 10 = 0 THEN 0 ELSE coalesce(n.n,0) END AS num_sensors, "
    "CASE WHEN dir='/data/v2/21316_extended/' THEN 0 ELSE coalesce(n.n,0) END AS n_c100, "
    "dir='/data/charm/' AND event_id % 10 = 1 AS energy_is_nan, "
    "CASE WHEN dir='/data/charm/' AND event_id % 10 = 1 THEN 0 ELSE round(mc_primary_energy,4) END AS energy, "
    "CASE WHEN dir='/data/v2/21316_extended/' THEN 0 ELSE round(mc_primary_dir_x,6) END AS dir_x, "
    "CASE WHEN dir='/data/v2/21316_extended/' THEN 'Unknown' ELSE mc_event_morphology END AS morphology "
    f"FROM ev LEFT JOIN (SELECT event_id, {NESTED}, count(*) AS n FROM se GROUP BY 1,2) n USING (event_id)", "ev", "se"))
def conform_columns(spark, sf):
    """Files of three versions below one folder, one of them of other types, beside a file that cannot be used: one call reads all good rows."""
    folder = version_files(spark, sf)
    keys = ["event_id", "chunk"]
    out = scan.scan_versions(spark, [folder], keys)
    nan = F.isnan("mc_primary_energy")
    return out.select(
        *keys, "num_sensors", F.size(S["c_100ns"]).cast("long").alias("n_c100"), nan.alias("energy_is_nan"),
        r(F.when(nan, 0.0).otherwise(F.col("mc_primary_energy")), 4, "energy"),
        r("mc_primary_dir_x", 6, "dir_x"), F.col(codes.MORPHOLOGY_COLUMN).alias("morphology"))


@query(v.sql("SELECT event_id, file_path FROM ev JOIN f USING (file_path) WHERE n >= 5 AND n < 25", "ev",
             f="SELECT file_path, row_number() OVER (ORDER BY file_path)-1 AS n FROM (SELECT DISTINCT file_path FROM ev)"))
def file_range(spark, sf):
    chosen = files.in_range(source_table(spark, sf), *scan.parse_file_range("5-25"))
    return first_chunks(files.scan_files(spark, chosen, ["event_id", "chunk", "origin"])).select("event_id", F.col("origin").alias("file_path"))


@query(v.sql("SELECT event_id, file_path FROM (SELECT event_id, file_path, row_number() OVER "
             "(PARTITION BY file_path ORDER BY event_id) AS n FROM ev) WHERE n <= 10", "ev"))
def limit_per_file(spark, sf):
    found = files.scan_files(spark, source_table(spark, sf), ["event_id", "chunk", "origin"], limit=10)
    return first_chunks(found).select("event_id", F.col("origin").alias("file_path"))


@query(v.sql("SELECT event_id, file_path FROM ev JOIN f USING (file_path) WHERE n <= 7", "ev",
             f="SELECT file_path, row_number() OVER (PARTITION BY dir ORDER BY md5(concat('42-',file_path)), file_path) AS n "
               "FROM (SELECT DISTINCT dir, file_path FROM ev)"))
def sample_files_per_dir(spark, sf):
    chosen = files.per_folder(source_table(spark, sf), 7, 42, source_name())
    return first_chunks(files.scan_files(spark, chosen, ["event_id", "chunk", "origin"])).select("event_id", F.col("origin").alias("file_path"))


@query(v.sql(
    "SELECT event_id, source_no, row_number() OVER (PARTITION BY source_no ORDER BY event_id)-1 AS local_idx, "
    "row_number() OVER (ORDER BY source_no, event_id)-1 AS global_idx FROM s", "ev",
    s="SELECT event_id, CAST(CASE dir WHEN '/data/v1/21217/' THEN 0 WHEN '/data/v2/21316_extended/' THEN 1 ELSE 2 END AS BIGINT) AS source_no FROM ev"))
def union_sources(spark, sf):
    ev = v.events(spark, sf).select("event_id", "dir")
    parts = [ev.where(F.col("dir") == d) for d in ("/data/v1/21217/", "/data/v2/21316_extended/", "/data/charm/")]
    out = scan.union_sources(
        [parts[0], None, *parts[1:]], ["event_id"], [F.expr(f"event_id div {v.EVENT_BLOCK}")])
    return rounded(out.select("event_id", "source_no", "local_idx", "global_idx"))


TABLE_ORDER = "ORDER BY file_path, event_id"
F32 = "CAST(CAST({} AS FLOAT) AS DOUBLE)"


@query(v.sql(
    "SELECT event_id, dataset_id, num_sensors, e - num_sensors AS sensor_start_idx, e AS sensor_end_idx, "
    "round(total_charge,2) AS total_charge, round(energy,2) AS energy, round(dir_x,5) AS dir_x, morphology, "
    "morphology_raw, starting, pos_sum, round(t_sum,3) AS t_sum FROM i JOIN "
    "(SELECT event_id, CAST(sum(pos) AS BIGINT) AS pos_sum, "
    f"sum({F32.format('t20')}) AS t_sum FROM se GROUP BY 1) USING (event_id)", "ec", "se",
    i=(f"SELECT event_id, {DATASET} AS dataset_id, num_sensors, CAST(sum(num_sensors) OVER ({TABLE_ORDER}) AS BIGINT) AS e, "
       f"{F32.format('c')} AS total_charge, {F32.format('mc_primary_energy')} AS energy, "
       f"{F32.format('mc_primary_dir_x')} AS dir_x, {TOPO} AS morphology, {RAW} AS morphology_raw, {START} AS starting "
       "FROM ec JOIN (SELECT event_id, sum(" + F32.format("c_total") + ") AS c FROM se GROUP BY 1) USING (event_id) "
       "WHERE num_sensors > 0")))
def write_event_tables(spark, sf):
    index, sensors = tables.read_event_tables(spark, table_folder(spark, sf))
    sums = sensors.groupBy("event_id").agg(
        F.sum("pos").alias("pos_sum"), F.sum(F.col("t20").cast("double")).alias("t_sum"))
    return rounded(index.join(sums, "event_id").select(
        "event_id", "dataset_id", "num_sensors", "sensor_start_idx", "sensor_end_idx", "total_charge",
        F.col("mc_primary_energy").alias("energy"), F.col("mc_primary_dir_x").alias("dir_x"),
        "morphology", "morphology_raw", "starting", "pos_sum", "t_sum"),
        2, dir_x=5, t_sum=3)


def table_folder(spark, sf):
    """Event index and sensors, converted from nested files and written."""
    def write(path):
        source = scan.scan_events(spark, source_folders(spark, sf), ["event_id", "origin", "first_pos"])
        conformed = scan.conform_columns(source, ["event_id", "origin", "first_pos"]).withColumn("block", F.expr(f"event_id div {TABLE_BLOCK}"))
        index, sensors = tables.event_tables(conformed, "event_id", "origin", ["origin", "block"], ["event_id"])
        tables.write_event_tables(index, sensors, path, zone=TABLE_ZONE, in_ranges=True)
    return once(spark, sf, "tables", write)


@query(v.sql(
    f"SELECT {DATASET} AS dataset_id, CAST(e - num_sensors + pos AS BIGINT) AS sensor_idx, event_id, pos, round({F32.format('c_total')},2) AS c_total "
    f"FROM (SELECT event_id, dir, num_sensors, sum(num_sensors) OVER ({TABLE_ORDER}) AS e FROM ec WHERE num_sensors > 0) JOIN se USING (event_id)", "ec", "se"))
def written_slices(spark, sf):
    """Sensors of the written table, given back to their events by the offsets of the written index."""
    index, sensors = tables.read_event_tables(spark, table_folder(spark, sf))
    joined = nested.slice_join(
        sensors.select("dataset_id", "sensor_idx", "c_total"),
        index.select("dataset_id", "event_id", "sensor_start_idx", "sensor_end_idx"), keys=["dataset_id"], rows=sensors.count())
    return rounded(joined.select("dataset_id", "sensor_idx", "event_id", "pos", "c_total"), 2)


CHOSEN = "sensor_start_idx % 997 < 100 AND morphology_raw = 4"


@query(v.sql(
    f"SELECT {DATASET} AS dataset_id, event_id, pos, round({F32.format('c_total')},2) AS c_total "
    f"FROM (SELECT event_id, dir, mc_event_morphology, CAST(e - num_sensors AS BIGINT) AS sensor_start_idx, {RAW} AS morphology_raw FROM "
    f"(SELECT *, sum(num_sensors) OVER ({TABLE_ORDER}) AS e FROM ec WHERE num_sensors > 0)) JOIN se USING (event_id) WHERE {CHOSEN}", "ec", "se"))
def chosen_slices(spark, sf):
    """The sensors of some events of the written index, from the files that hold them."""
    path = table_folder(spark, sf)
    chosen = tables.read_event_tables(spark, path)[0].where(CHOSEN).select("dataset_id", "event_id", "sensor_start_idx", "sensor_end_idx")
    return rounded(tables.read_slices(spark, path, chosen, ["c_total"]).select("dataset_id", "event_id", "pos", "c_total"), 2)


RECIPE = (
    scan.Source("tracks", "21217", files=(0, 12)),
    scan.Source("muons", "21316_extended", files=(3, 15)),
    scan.Source("charm_starting", "charm", starting_only=True),
)


@query(v.sql(
    "SELECT event_id, CASE dir WHEN '/data/v1/21217/' THEN 'tracks' WHEN '/data/v2/21316_extended/' THEN 'muons' "
    "ELSE 'charm_starting' END AS source FROM ev JOIN f USING (file_path) WHERE "
    f"(dir='/data/v1/21217/' AND n < 12) OR (dir='/data/v2/21316_extended/' AND n >= 3 AND n < 15) OR (dir='/data/charm/' AND {START})",
    "ev", f="SELECT file_path, row_number() OVER (PARTITION BY dir ORDER BY file_path)-1 AS n FROM "
            "(SELECT DISTINCT dir, file_path FROM ev)"))
def training_mix(spark, sf):
    found = first_chunks(files.scan_files(spark, files.mix(source_table(spark, sf), RECIPE), ["event_id", "chunk"], carry=["source", "only_starting"]))
    return labels.starting_only(found.where("only_starting")).unionByName(found.where("not only_starting")).select("event_id", "source")


@query(v.sql(
    "SELECT CAST(coalesce(dataset_id,-1) AS BIGINT) AS dataset_id, CAST(sum(events) AS BIGINT) AS events, CAST(sum(sensors) AS BIGINT) AS sensors, "
    "count(*) FILTER (events > 0) AS succeeded, count(*) FILTER (events = 0) AS failed, CAST(sum(failed_files) AS BIGINT) AS failed_files, "
    "CAST(grouping(dataset_id) AS BIGINT) AS is_total FROM d GROUP BY ROLLUP (dataset_id)", "ec",
    k="SELECT *, num_sensors > 0 AND NOT (dir='/data/charm/' AND event_id % 10 = 0) AS good FROM ec",
    d=f"SELECT {DATASET} AS dataset_id, count(*) FILTER (good) AS events, coalesce(sum(num_sensors) FILTER (good), 0) AS sensors, 0 AS failed_files "
      "FROM k GROUP BY 1 UNION ALL SELECT 99999, 0, 0, 1"))
def dataset_manifest(spark, sf):
    """What came of every dataset of the folder, also of the one whose only file cannot be used."""
    table = ordering.cut_lineage(files.file_table(spark, [version_files(spark, sf)]))
    events, _ = labels.drop_empty_events(files.scan_files(spark, table, ["event_id", "chunk"], file_columns=True), F.col("num_sensors"))
    whole = events.groupBy("event_id", labels.dataset_id_from_path(F.col("file_path")).alias("dataset_id")).agg(F.sum("num_sensors").alias("num_sensors"))
    return rounded(tables.dataset_manifest(whole, files=table).drop("files").na.fill(-1, ["dataset_id"]))


# --- projections and filters ------------------------------------------------------------


@query(v.sql(f"SELECT {DATASET} AS dataset_id, count(*) AS n FROM ev GROUP BY 1", "ev"))
def dataset_id_from_path(spark, sf):
    found = v.events(spark, sf).select(labels.dataset_id_from_path(F.col("file_path")).alias("dataset_id"))
    return rounded(found.groupBy("dataset_id").agg(F.count("*").alias("n")))


@query(v.sql(f"SELECT event_id, {TOPO} AS morphology, {RAW} AS morphology_raw, {START} AS starting FROM ev", "ev"))
def morphology_codes(spark, sf):
    return rounded(labels.morphology_codes(v.events(spark, sf)).select(
        "event_id", "morphology", "morphology_raw", "starting"))


NAMED_SQL = as_long(
    "CASE WHEN mc_event_morphology IN ('0T1C','0TnC') THEN 1 WHEN mc_event_morphology IN ('1T1C','1TnC') THEN 2 ELSE 0 END")
NAMED_RANK = as_long(
    "CASE mc_event_morphology WHEN '0T0C' THEN 0 WHEN '0T1C' THEN 1 WHEN '0TnC' THEN 2 WHEN '1T0C' THEN 3 "
    "WHEN '1T1C' THEN 4 WHEN '1TnC' THEN 5 WHEN '2TnC' THEN 6 WHEN 'BackGround' THEN 7 WHEN 'Background' THEN 8 ELSE -1 END")
CODED_SQL = as_long(f"CASE {RAW} WHEN 7 THEN 0 WHEN -1 THEN 0 WHEN 6 THEN -1 ELSE {RAW} END")


@query(v.sql(f"SELECT event_id, {NAMED_SQL} AS label, {NAMED_RANK} AS raw_index FROM ev", "ev"))
def class_labels_nested(spark, sf):
    name = F.col(codes.MORPHOLOGY_COLUMN)
    return rounded(v.events(spark, sf).select(
        "event_id", labels.class_label(name, NAMED, "nested").alias("label"),
        labels.raw_index(name, NAMED, "nested").alias("raw_index")))


@query(v.sql(f"SELECT event_id, {CODED_SQL} AS label, {RAW} AS raw_index FROM ev", "ev"))
def class_labels_flat(spark, sf):
    raw = labels.raw_index(F.col(codes.MORPHOLOGY_COLUMN), CODED, "flat")
    return rounded(v.events(spark, sf).withColumn("raw_index", raw).select(
        "event_id", labels.class_label(F.col("raw_index"), CODED, "flat").alias("label"), "raw_index"))


def _labels(df, names):
    return rounded(df.select("event_id", *[F.col("labels")[i].alias(n) for i, n in enumerate(names)]))


LABELS = ("log_energy", "dir_x", "dir_y", "dir_z", "label", "raw_index")
DIRS = "round(mc_primary_dir_x,6) AS dir_x, round(mc_primary_dir_y,6) AS dir_y, round(mc_primary_dir_z,6) AS dir_z"


@query(v.sql(
    f"SELECT event_id, round(log10(greatest(mc_primary_energy,1e-6)),6) AS log_energy, {DIRS}, "
    f"CAST({NAMED_SQL} AS DOUBLE) AS label, CAST({NAMED_RANK} AS DOUBLE) AS raw_index, "
    "round(mc_primary_dir_x*0.5e0,6) AS vx, round(mc_primary_dir_y*0.5e0,6) AS vy, round(mc_primary_dir_z*0.5e0,6) AS vz FROM ev", "ev"))
def label_vector_nested(spark, sf):
    ev = v.events(spark, sf).withColumn(
        codes.VERTEX_COLUMN, F.array(*[F.col(c) * 500 for c in codes.TRUTH_COLUMNS[1:]]))
    return _labels(labels.label_vector(ev, NAMED, "nested", codes.VERTEX_COLUMN, rescale=True), [*LABELS, "vx", "vy", "vz"])


@query(v.sql(
    f"SELECT event_id, CASE WHEN e > 0 THEN round(log10(greatest(e,1e-300)),6) ELSE 0 END AS log_energy, {DIRS}, "
    f"CAST({CODED_SQL} AS DOUBLE) AS label, CAST({RAW} AS DOUBLE) AS raw_index FROM "
    "(SELECT *, CASE WHEN event_id % 13 = 0 THEN 0 ELSE mc_primary_energy END AS e FROM ev)", "ev"))
def label_vector_flat(spark, sf):
    energy = F.when(F.col("event_id") % 13 == 0, 0.0).otherwise(F.col("mc_primary_energy"))
    ev = v.events(spark, sf).withColumn("mc_primary_energy", energy)
    return _labels(labels.label_vector(ev, CODED, "flat"), LABELS)


@query(v.sql(f"SELECT event_id, mc_event_morphology FROM ev WHERE {START}", "ev"))
def starting_only(spark, sf):
    return labels.starting_only(v.events(spark, sf)).select("event_id", codes.MORPHOLOGY_COLUMN)


@query(v.sql("SELECT event_id, num_sensors FROM ec WHERE num_sensors > 0", "ec"))
def drop_empty_events(spark, sf):
    return labels.drop_empty_events(v.events_with_stats(spark, sf), F.col("num_sensors"))[0].select("event_id", "num_sensors")


@query(v.sql("SELECT count(*) FILTER (num_sensors > 0) AS kept, count(*) FILTER (num_sensors = 0) AS dropped FROM ec", "ec"))
def drop_empty_report(spark, sf):
    return labels.drop_empty_events(v.events_with_stats(spark, sf), F.col("num_sensors"))[1]


@query(v.sql(
    "SELECT event_id, num_sensors, round(total_charge,2) AS total_charge, round(mc_primary_energy,4) AS energy, "
    f"{DIRS}, CASE {RAW} WHEN -1 THEN 'Unknown' WHEN 7 THEN 'Background' ELSE mc_event_morphology END AS morphology_name, "
    f"{START} AS starting, {DATASET} AS dataset_id FROM ec WHERE num_sensors > 0 AND o_orderpriority = '1-URGENT'", "ec"))
def event_lookup(spark, sf):
    index = full_events(spark, sf).withColumn("dataset_id", labels.dataset_id_from_path(F.col("file_path")))
    wanted = v.events(spark, sf).where(F.col("o_orderpriority") == "1-URGENT")
    found = labels.event_lookup(index, wanted, "event_id")
    return rounded(found.select(
        "event_id", "num_sensors", "total_charge", F.col("mc_primary_energy").alias("energy"),
        *[F.col(f"mc_primary_{d}").alias(d) for d in ("dir_x", "dir_y", "dir_z")],
        "morphology_name", "starting", "dataset_id"), 6, total_charge=2, energy=4)


COORDS_SQL = ("x", "y", "z", "t_first")


def _points(df):
    """Exploded coords and features of assembled rows."""
    both = df.select("event_id", "first_pos", F.posexplode(F.arrays_zip("coords", "features")).alias("i", "p"))
    return rounded(both.select(
        "event_id", (F.col("first_pos") + F.col("i")).alias("pos"),
        *[F.col("p.coords")[i].alias(f"c{i}") for i in range(4)],
        *[F.col("p.features")[i].alias(f"f{i}") for i in range(9)]))


@query(v.sql(
    "SELECT event_id, pos, " + ", ".join(f"round({c}*1e-3,6) AS c{i}" for i, c in enumerate(COORDS_SQL)) + ", "
    + ", ".join(f"CASE WHEN {f} > -1 THEN round(ln(1+greatest({f},-0.999999e0)),6) WHEN {f} = -1 THEN CAST('-inf' AS DOUBLE) "
                f"ELSE CAST('nan' AS DOUBLE) END AS f{i}" for i, f in enumerate(codes.FEATURES)) + " FROM se", "se"))
def rescale_points(spark, sf):
    return _points(nested.rescale_points(nested.assemble_points(v.nested_events(spark, sf))))


@query(v.sql("SELECT event_id, pos, round((c_total-30000)/20000e0,8) AS c_total, round((t_first-500)/300e0,8) AS t_first, "
             "round(x,8) AS x FROM se", "se"))
def standardise_features(spark, sf):
    found = nested.standardise_features(
        v.sensors(spark, sf), {"c_total": (30000.0, 20000.0), "t_first": (500.0, 300.0), "absent": (0.0, 1.0)})
    return rounded(found.select("event_id", "pos", "c_total", "t_first", "x"), 8)


def _spoiled(spark, sf):
    return v.predictions(spark, sf).withColumns({
        "pred_log_energy": F.when(F.col("event_id") % 50 == 0, float("nan")).otherwise(F.col("pred_log_energy")),
        "raw_sigma": F.when(F.col("event_id") % 77 == 0, float("inf")).otherwise(F.col("raw_sigma")),
        "pred_x": F.when(F.col("event_id") % 91 != 0, F.col("pred_x"))})


BAD = "(event_id % 50 = 0 OR event_id % 77 = 0 OR event_id % 91 = 0)"
METRICS = ("pred_log_energy", "raw_sigma", "pred_x")


@query(v.sql(f"SELECT event_id, round(pred_log_energy,6) AS pred_log_energy FROM pr WHERE NOT {BAD}", "pr"))
def finite_only(spark, sf):
    return labels.finite_only(_spoiled(spark, sf), METRICS)[0].select("event_id", r("pred_log_energy"))


@query(v.sql(f"SELECT count(*) FILTER (NOT {BAD}) AS kept, count(*) FILTER ({BAD}) AS dropped FROM ev", "ev"))
def finite_report(spark, sf):
    return labels.finite_only(_spoiled(spark, sf), METRICS)[1]


# --- nesting and batches ------------------------------------------------------------------


@query(v.sql(
    "SELECT event_id, pos, round(x,4) AS x, round(y,4) AS y, round(z,4) AS z, round(t_first,4) AS t_first, "
    "round(c_total,4) AS c_total, CASE WHEN pos < 3 THEN round(c_100ns,6) ELSE 0 END AS c_100ns, round(t_std,4) AS t_std FROM se", "se"))
def explode_sensors(spark, sf):
    ragged = v.nested_events(spark, sf).withColumns({
        S["c_100ns"]: F.when(F.col("chunk") == 0, F.slice(S["c_100ns"], 1, 3)).otherwise(F.array().cast("array<double>")),
        S["t_std"]: F.concat(S["t_std"], F.array(F.lit(7.0), F.lit(8.0)))})
    out = nested.explode_sensors(ragged, ["event_id"], F.col("first_pos"))
    return rounded(out.select("event_id", "pos", "x", "y", "z", "t_first", "c_total", "c_100ns", "t_std"), 4, c_100ns=6)


@query(v.sql(
    f"SELECT event_id, e - num_sensors AS sensor_start_idx, e AS sensor_end_idx FROM (SELECT event_id, num_sensors, "
    f"CAST(sum(num_sensors) OVER ({TABLE_ORDER}) AS BIGINT) AS e FROM ec WHERE num_sensors > 0)", "ec"))
def sensor_offsets(spark, sf):
    return nested.sensor_offsets(full_events(spark, sf), ["file_path", "block"], ["event_id"]).select(
        "event_id", "sensor_start_idx", "sensor_end_idx")


@query(v.sql(
    "SELECT file_path, row_number() OVER (PARTITION BY file_path ORDER BY event_id, pos)-1 AS sensor_idx, event_id, pos, "
    "round(x,4) AS x, round(c_total,4) AS c_total FROM se JOIN ev USING (event_id)", "ev", "se"))
def slice_join(spark, sf):
    index = nested.sensor_offsets(full_events(spark, sf), ["block"], ["event_id"], ["file_path"]).select(
        "file_path", "event_id", "sensor_start_idx", "sensor_end_idx")
    placed = v.sensor_rows(spark, sf).join(v.events(spark, sf).select("event_id", "file_path"), "event_id")
    stored = ordering.row_positions(
        v.in_blocks(placed), "sensor_idx", ["block"], [F.col(c) for c in ("event_id", *v.TIE)], ["file_path"]
    ).select("file_path", "sensor_idx", "x", "c_total")
    joined = nested.slice_join(stored, index, keys=["file_path"])
    return rounded(joined.select("file_path", "sensor_idx", "event_id", "pos", "x", "c_total"), 4)


@query(v.sql("SELECT event_id, pos, " + ", ".join(f"round({c},6) AS c{i}" for i, c in enumerate(COORDS_SQL)) + ", "
             + ", ".join(f"round({f},6) AS f{i}" for i, f in enumerate(codes.FEATURES)) + " FROM se", "se"))
def assemble_points(spark, sf):
    return _points(nested.assemble_points(v.nested_events(spark, sf)))


BATCHED = ("SELECT event_id, num_sensors, (rn-1)//512 AS batch_id, (rn-1)%512 AS event_in_batch, label FROM "
           f"(SELECT event_id, num_sensors, {LABEL} AS label, row_number() OVER (ORDER BY event_id) AS rn FROM ec WHERE num_sensors > 0)")


def batches(spark, sf):
    events = full_events(spark, sf).withColumn("label", labels.class_label(F.col("morphology_raw"), None, "flat"))
    return nested.assign_batches(events, 512, ["block"], ["event_id"])


@query(v.sql("SELECT batch_id, event_in_batch, event_id, pos, round(x,4) AS x, round(c_total,4) AS c_total "
             "FROM se JOIN b USING (event_id)", "ec", "se", b=BATCHED))
def pack_batches(spark, sf):
    packed = nested.pack_batches(batches(spark, sf), v.sensors(spark, sf))
    return rounded(packed.select("batch_id", "event_in_batch", "event_id", "pos", "x", "c_total"), 4)


@query(v.sql("SELECT batch_id, event_in_batch, event_id, pos, label, round(x,4) AS x FROM se JOIN b USING (event_id)", "ec", "se", b=BATCHED))
def pack_batches_labelled(spark, sf):
    packed = nested.pack_batches(batches(spark, sf), v.sensors(spark, sf), labels=["label"])
    return rounded(packed.select("batch_id", "event_in_batch", "event_id", "pos", "label", "x"), 4)


@query(v.sql("SELECT batch_id, event_id, pos, CAST(event_in_batch AS DOUBLE) AS c0, round(x,4) AS c1, round(y,4) AS c2, "
             "round(z,4) AS c3, round(t_first,4) AS c4 FROM se JOIN b USING (event_id)", "ec", "se", b=BATCHED))
def pack_batches_coordinate(spark, sf):
    packed = nested.with_batch_coordinate(nested.pack_batches(batches(spark, sf), v.sensors(spark, sf)))
    return rounded(packed.select("batch_id", "event_id", "pos", *[F.col("coords")[i].alias(f"c{i}") for i in range(5)]), 4)


@query(v.sql(
    "SELECT b.batch_id, b.event_in_batch, b.event_id, g.pos, g.pos < b.num_sensors AS valid, b.num_sensors AS \"count\", m.n_max, "
    "round(coalesce(se.x,0),4) AS x, round(coalesce(se.c_total,0),4) AS c_total FROM b JOIN m USING (batch_id) "
    "JOIN g ON g.pos < m.n_max LEFT JOIN se ON se.event_id = b.event_id AND se.pos = g.pos", "ec", "se", b=BATCHED,
    m="SELECT batch_id, max(num_sensors) AS n_max FROM b GROUP BY 1",
    g="SELECT unnest(generate_series(0, (SELECT max(n_max) FROM m)-1)) AS pos"))
def pack_padded(spark, sf):
    return rounded(nested.pack_padded(batches(spark, sf), v.sensors(spark, sf), ["x", "c_total"]), 4)


@query(v.sql(
    "SELECT ev.event_id, g.pos, round(coalesce(se.x,0),4) AS x, se.pos IS NULL AS padded FROM ev CROSS JOIN g "
    "LEFT JOIN se ON se.event_id = ev.event_id AND se.pos = g.pos LEFT JOIN (SELECT event_id, count(*) AS n FROM se GROUP BY 1) k "
    "ON k.event_id = ev.event_id WHERE g.pos < greatest(coalesce(k.n,0),5)", "ev", "se",
    g="SELECT unnest(generate_series(0, (SELECT greatest(max(pos),4) FROM se))) AS pos"))
def pad_to_max(spark, sf):
    ev = v.nested_events(spark, sf)
    padded = ev.withColumn("points", nested.pad_to_max(F.col(S["x"]), F.lit(5), F.lit(0.0)))
    size = F.size(S["x"])
    rows = padded.select("event_id", "first_pos", size.alias("n"), F.posexplode("points").alias("i", "x")).where(
        (F.col("first_pos") == 0) | (F.col("i") < F.col("n")))
    return rows.select("event_id", (F.col("first_pos") + F.col("i")).alias("pos"), r("x", 4), (F.col("i") >= F.col("n")).alias("padded"))


@query(v.sql("SELECT batch_id, count(*) AS events, min(num_sensors) AS min_sensors, max(num_sensors) AS max_sensors, "
             "round(avg(num_sensors),6) AS mean_sensors FROM b GROUP BY 1", "ec", b=BATCHED))
def batch_summary(spark, sf):
    return rounded(nested.batch_summary(batches(spark, sf)))


# --- aggregates and checks ------------------------------------------------------------------


@query(v.sql("SELECT event_id, num_sensors, round(total_charge,2) AS total_charge FROM ec", "ec"))
def event_stats(spark, sf):
    return rounded(v.events_with_stats(spark, sf).select("event_id", "num_sensors", "total_charge"), 2)


@query(v.sql("SELECT batch_id, count(*) AS events, count(*) FILTER (label=0) AS class_0, count(*) FILTER (label=1) AS class_1 "
             "FROM b GROUP BY 1", "ec", b=BATCHED))
def batch_class_counts(spark, sf):
    return nested.batch_class_counts(batches(spark, sf), [0, 1])


@query(v.sql(
    "SELECT count(*) AS events, CAST(sum(num_sensors) AS BIGINT) AS header_sensors, 0::BIGINT AS reversed_ranges, 0 AS ranges_past_end, "
    "0::BIGINT AS size_mismatches, (SELECT count(*) FROM lineitem WHERE l_orderkey % 211 <> 0) AS sensors, "
    "(SELECT count(*) FROM lineitem WHERE l_orderkey % 211 <> 0 AND l_orderkey NOT IN (SELECT event_id FROM ev)) AS orphan_sensors, "
    "(SELECT count(*) FROM ec WHERE num_sensors > 0 AND event_id % 211 = 0) AS events_without_sensors, count(*) AS source_events, "
    "true AS within_tolerance FROM ec WHERE num_sensors > 0", "ec").replace("0 AS ranges_past_end", (
        "(SELECT count(*) FROM (SELECT CAST(sum(num_sensors) OVER (ORDER BY file_path, event_id) AS BIGINT) AS e FROM ec WHERE num_sensors > 0) "
        "WHERE e > (SELECT count(*) FROM lineitem WHERE l_orderkey % 211 <> 0)) AS ranges_past_end")))
def integrity_checks(spark, sf):
    """A sensor table with some events missing, so that the checks have violations to find."""
    index = nested.sensor_offsets(full_events(spark, sf), ["file_path", "block"], ["event_id"])
    damaged = v.sensor_rows(spark, sf).where(F.col("event_id") % 211 != 0)
    return quality.integrity_checks(index, damaged, full_events(spark, sf).select("event_id"))


SPLIT = ("SELECT event_id, CASE WHEN rn > n - CAST(floor(n*0.2e0) AS BIGINT) THEN 'val' ELSE 'train' END AS split FROM "
         "(SELECT event_id, row_number() OVER (ORDER BY md5(concat('42-',CAST(event_id AS VARCHAR)))) AS rn, count(*) OVER () AS n "
         "FROM ec WHERE num_sensors > 0)")


@query(v.sql("SELECT event_id, split FROM s", "ec", s=SPLIT))
def split_events(spark, sf):
    return sampling.split_events(full_events(spark, sf), 0.2, 42).select("event_id", "split")


@query(v.sql("SELECT 0::BIGINT AS overlap, count(*) AS covered, 0::BIGINT AS missing, 0::BIGINT AS extra, count(*) AS full_events FROM ec WHERE num_sensors > 0", "ec"))
def split_checks(spark, sf):
    full = full_events(spark, sf).select("event_id")
    halves = sampling.split_events(full, 0.2, 42)
    side = lambda s: halves.where(F.col("split") == s).select("event_id")
    return quality.split_checks(side("train"), side("val"), full)


@query(v.sql(
    "SELECT CAST(label AS BIGINT) AS label, dim-1 AS dim, round(sum(val*w)/greatest(sum(w),1),5) AS pooled FROM "
    "(SELECT label, unnest(embedding)::DOUBLE AS val, unnest(generate_series(1,len(embedding))) AS dim, "
    "CASE WHEN vec_id % 3 <> 0 THEN 1e0 ELSE 0e0 END AS w FROM embeddings) GROUP BY 1,2"))
def mean_pool(spark, sf):
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet").withColumn("mask", F.col("vec_id") % 3 != 0)
    return rounded(quality.mean_pool(vectors, "label", "embedding", "mask"), 5)


def weighted_events(spark, sf):
    events = full_events(spark, sf).withColumn("label", labels.class_label(F.col("morphology_raw"), None, "flat"))
    return sampling.sample_weights(events)


WEIGHTED = f"SELECT event_id, {CATEGORY} AS category, {WEIGHT} AS weight FROM ec WHERE num_sensors > 0"


@query(v.sql(
    "SELECT category, count(*) AS events, max(weight) AS weight, sum(weight) AS effective, "
    "round(sum(weight)/sum(sum(weight)) OVER (),6) AS probability, CASE WHEN category <> 'low_upgoing' THEN "
    "round(sum(weight)/sum(CASE WHEN category <> 'low_upgoing' THEN sum(weight) END) OVER (),6) END AS reported_share "
    "FROM w GROUP BY category", "ec", w=WEIGHTED))
def weight_report(spark, sf):
    return rounded(sampling.weight_report(weighted_events(spark, sf)))


# --- sampling and order ----------------------------------------------------------------------


@query(v.sql("SELECT event_id, split FROM ev JOIN f USING (file_path)", "ev",
             f="SELECT file_path, CASE WHEN rn <= floor(n*0.9e0) THEN 'train' ELSE 'val' END AS split FROM (SELECT file_path, "
               "row_number() OVER (ORDER BY md5(concat('42-',file_path)), file_path) AS rn, count(*) OVER () AS n FROM "
               "(SELECT DISTINCT file_path FROM ev))"))
def split_files(spark, sf):
    chosen = files.split(source_table(spark, sf), 0.1, 42, name=source_name())
    return first_chunks(files.scan_files(spark, chosen, ["event_id", "chunk"], carry=["split"])).select("event_id", "split")


@query(v.sql("SELECT event_id, category, weight FROM w", "ec", w=WEIGHTED))
def sample_weights(spark, sf):
    return weighted_events(spark, sf).select("event_id", "category", "weight")


UNIT = "CAST(concat('0x',substr(md5(concat('{}-',CAST({} AS VARCHAR))),1,13)) AS BIGINT)/4503599627370496e0"


@query(v.sql(
    "SELECT d.draw, i.event_id FROM d ASOF JOIN i ON d.u >= i.lo", "ec", w=WEIGHTED,
    i="SELECT event_id, sum(weight) OVER (ORDER BY md5(concat('42-',CAST(event_id AS VARCHAR))), event_id) - weight AS lo FROM w",
    d=f"SELECT event_id AS draw, {UNIT.format('42-draw', 'event_id')}*(SELECT sum(weight) FROM w) AS u FROM w"))
def weighted_sample(spark, sf):
    return sampling.weighted_sample(weighted_events(spark, sf), 42)


@query(v.sql("SELECT event_id, row_number() OVER (ORDER BY md5(concat('7-',file_path)), event_id)-1 AS position FROM ev", "ev"))
def shuffle_by_file(spark, sf):
    return sampling.shuffle_by_file(
        v.in_blocks(v.events(spark, sf)), 7, ["event_id"], ["block"]).select("event_id", "position")


def feistel_sql(source: str, seed: int, walks: int = 3) -> dict[str, str]:
    """The rounds of the keyed permutation over a view (event_id, i, n), written out."""
    p = sampling.PRIME
    steps, last = {"w0": f"SELECT event_id, n, i AS x, false AS done, CAST(ceil(sqrt(n)) AS BIGINT) AS a FROM {source}"}, "w0"
    for walk in range(walks):
        steps[f"s{walk}"] = (f"SELECT event_id, n, a, (n + a - 1) // a AS b, x, done, x // ((n + a - 1) // a) AS l, x % ((n + a - 1) // a) AS r FROM {last}")
        last = f"s{walk}"
        for k, (u, c, w) in enumerate(sampling.round_constants(seed)):
            mixed = "(((({x} + {u}) % {p}) * (({x} + {u}) % {p})) % {p} * {c} + {w}) % {p}".format(x="lr"[(k + 1) % 2], u=u, c=c, w=w, p=p)
            halves = f"(l + {mixed}) % a AS l, r" if k % 2 == 0 else f"l, (r + {mixed}) % b AS r"
            steps[f"r{walk}_{k}"] = f"SELECT event_id, n, a, b, x, done, {halves} FROM {last}"
            last = f"r{walk}_{k}"
        # a cell that is inside already stays
        steps[f"w{walk + 1}"] = f"SELECT event_id, n, a, CASE WHEN done THEN x ELSE l * b + r END AS x, done OR l * b + r < n AS done FROM {last}"
        last = f"w{walk + 1}"
    return steps


@query(v.sql("SELECT event_id, x AS position FROM w3", "ev",
             nr="SELECT event_id, row_number() OVER (ORDER BY file_path, event_id)-1 AS i, count(*) OVER () AS n FROM ev", **feistel_sql("nr", 7)))
def shuffle_events(spark, sf):
    """A shuffle of the written rows: their numbers come from the file table and their places in the files."""
    table = files.cumulative(files.usable(source_table(spark, sf)))
    found = files.scan_files(spark, table, ["event_id", "chunk"], file_columns=True, carry=["start"])
    numbered = found.withColumn("i", F.col("start") + F.col("row_index"))
    return first_chunks(sampling.shuffle_events(numbered, 7, "i", table.agg(F.sum("rows")).scalar())).select("event_id", "position")
