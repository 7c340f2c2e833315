from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from pathpulse.operators.describe import data_info
from pathpulse.operators.features_signal import signal_features
from pathpulse.operators.resample import resampled_tracks
from pathpulse.operators.segments import assign_segments, coordinate_bounds, trim_at_death
from pathpulse.params import TrackParams
from pathpulse.plans import jobs
from pathpulse.plans.extract import FEATURES, extract_checked, extract_features
from pathpulse.plans.preprocess import clean_tracks
from pathpulse.sources import manifest, stores, track_files

P = TrackParams(segment_len=10, interp_limit=1, long_gap=2)


@pytest.fixture
def folder(tmp_path):
    """Track files in two conditions, an excluded folder, other CSVs and a lookup."""
    def track(name, n, extra=""):
        path = tmp_path / "data" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        lines = ["GlobalFrame,Speed,X,Y" + (",Area" if extra else "")]
        for i in range(n):
            x = "" if i % 7 == 3 else str(float(i))
            lines.append(f"{i * 2},{i / 10},{x},{x}{extra}")
        path.write_text("\n".join(lines) + "\n")

    track("drug+ one/coordinates_highestspeed_20240827_1_1.csv", 41)
    track("control/coordinates_highestspeed_20240827_12_3.csv", 26)
    track("Optogenetics/coordinates_highestspeed_20240827_2_1.csv", 30)
    (tmp_path / "data" / "control" / "lifespan_SUMMARY.csv").write_text("a,b\n1,2\n")
    (tmp_path / "lookup.csv").write_text(
        "Filename,Seconds5x\n/20240827_piworm01_1,25\n/20240827_piworm01_1,999\n/20240101_piworm09_1,5\n"
    )
    return tmp_path


def test_scan_numbers_lines_of_every_file(spark, folder):
    rows = track_files.scan_tracks(spark, str(folder / "data"))
    seen = {r["entity"]: r for r in rows.groupBy("entity", "label").agg(
        F.count(F.lit(1)).alias("n"), F.min("row_no").alias("lo"), F.max("row_no").alias("hi")
    ).collect()}
    assert set(seen) == {
        "coordinates_highestspeed_20240827_1_1", "coordinates_highestspeed_20240827_12_3"
    }
    one = seen["coordinates_highestspeed_20240827_1_1"]
    assert (one["label"], one["n"], one["lo"], one["hi"]) == (1, 41, 0, 40)
    assert rows.where("speed <> row_no / 10").count() == 0


def test_scan_survives_many_splits(spark, folder):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "64b")
        rows = track_files.scan_tracks(spark, str(folder / "data"))
        assert rows.select("entity", "row_no").distinct().count() == 67
        assert rows.where("speed <> row_no / 10").count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_extra_columns_are_ignored(spark, tmp_path):
    path = tmp_path / "coordinates_highestspeed_20240827_1_1.csv"
    path.write_text("GlobalFrame,Area,Speed,X,Y\n1,9,0.5,1.5,2.5\n2,9,0.6,1.6,2.6\n")
    rows = track_files.scan_tracks(spark, str(tmp_path)).orderBy("row_no").collect()
    assert [(r["speed"], r["x"], r["y"]) for r in rows] == [(0.5, 1.5, 2.5), (0.6, 1.6, 2.6)]


def test_columns_go_by_each_files_header(spark, tmp_path):
    for folder, text in (
        ("a", "GlobalFrame,Speed,X,Y\n1,0.5,1.5,2.5\n"),
        ("b", '"X","Y","Speed","GlobalFrame"\n\n1.5, 2.5,0.5,1\nNaN,,x,2\n'),
    ):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / f"coordinates_highestspeed_20240827_{folder}_1.csv").write_text(text)
    rows = track_files.scan_tracks(spark, str(tmp_path)).orderBy("path", "row_no").collect()
    assert [tuple(r)[-5:] for r in rows] == [
        (0, 1, 0.5, 1.5, 2.5), (0, 1, 0.5, 1.5, 2.5), (1, 2, None, None, None),
    ]


def test_one_file_name_in_two_folders_is_two_entities(spark, tmp_path):
    for folder in ("a", "b+"):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "coordinates_highestspeed_20240827_1_1.csv").write_text("GlobalFrame,Speed,X,Y\n1,1,1,1\n2,1,1,1\n")
    rows = track_files.scan_tracks(spark, str(tmp_path)).groupBy("entity", "label").count().collect()
    name = "coordinates_highestspeed_20240827_1_1"
    assert {tuple(r) for r in rows} == {(f"a/{name}", 0, 2), (f"b+/{name}", 1, 2)}


def test_bounds_take_columns_by_name(spark, tmp_path):
    (tmp_path / "a-preprocessed.csv").write_text(
        "frame,speed,x,y,segment,segment_index,turning_angle\n1,0.5,0.1,0.2,7,7.0,0.25\n2,0.6,0.3,0.4,7,7.0,-0.5\n"
    )
    (tmp_path / "coordinates_highestspeed_20240827_1_1.csv").write_text("Area,GlobalFrame,Speed,X,Y\n300,1,3,4,5\n")
    row = coordinate_bounds(track_files.scan_bounds_files(spark, str(tmp_path)), "path").first()
    assert (row["turning_angle_min"], row["turning_angle_max"], row["speed_max"], row["x_max"]) == (-0.5, 0.25, 0.6, 4.0)


def test_files_to_clean_segments(spark, folder):
    frames = track_files.frames_of(track_files.scan_tracks(spark, str(folder / "data")))
    assert frames.agg(F.min("frame")).first()[0] == 1
    from pathpulse.functions.filenames import lookup_key

    spans = track_files.read_lifespans(spark, str(folder / "lookup.csv"))
    lifespans = (
        frames.select("entity", lookup_key(F.col("path")).alias("key")).distinct().join(spans, "key")
    )
    trimmed = trim_at_death(assign_segments(frames, P), lifespans, P)
    # 25 seconds are segments 0-2; the entity without a lookup line is left out
    assert trimmed.select("entity").distinct().count() == 1
    assert trimmed.agg(F.max("seg")).first()[0] == 2
    clean = clean_tracks(frames, P, lifespans)
    assert clean.agg(F.max("x")).first()[0] <= 1


def test_bounds_over_both_kinds_of_files(spark, folder):
    pre = folder / "pre"
    pre.mkdir()
    (pre / "a-preprocessed.csv").write_text(
        "frame,speed,x,y,turning_angle\n1,0.5,0.1,0.2,-0.5\n2,20,0.3,,0.25\n"
    )
    scanned = track_files.scan_bounds_files(spark, str(folder / "data" / "control"), str(pre))
    row = coordinate_bounds(scanned, "path").first()
    assert (row["x_min"], row["speed_max"], row["turning_angle_min"]) == (0.0, 20.0, -0.5)
    assert (row["files"], row["files_with_angle"]) == (2, 1)


def test_stored_tables(spark, frames_of, tmp_path):
    frames = frames_of(speed=[1.0, 2, 3, 4], seg=[0, 0, 1, 1], label=[1, 1, 0, 0])
    stores.write_frames(frames, f"{tmp_path}/frames")
    back = stores.read_frames(spark, f"{tmp_path}/frames")
    assert back.count() == 4 and back.where("label = 1").count() == 2
    table = spark.createDataFrame(
        [(1, s, 0, float(s)) for s in range(10)], "entity long, seg long, label int, mean_speed double"
    )
    stores.store_features(table, f"{tmp_path}/f")
    assert stores.load_features(spark, f"{tmp_path}/f").count() == 10
    late = stores.load_labelled_features(spark, f"{tmp_path}/f", threshold=3).where("label = 1")
    assert sorted(r["seg"] for r in late.collect()) == [7, 8, 9]
    assert stores.load_labelled_features(spark, f"{tmp_path}/f", "original").where("label = 1").count() == 0
    with pytest.raises(ValueError):
        stores.load_labelled_features(spark, f"{tmp_path}/f", "nonsense")
    with pytest.raises(ValueError):
        stores.load_features(spark, f"{tmp_path}/f", "weekly")
    stores.write_report(data_info(table), f"{tmp_path}/info")
    assert spark.read.json(f"{tmp_path}/info").first()["samples"] == 10
    stores.write_csv(table, f"{tmp_path}/csv")
    assert spark.read.option("header", True).csv(f"{tmp_path}/csv").count() == 10
    stores.write_analyses({"a": table, "b": table.limit(3)}, f"{tmp_path}/res")
    assert spark.read.parquet(f"{tmp_path}/res").where("analysis = 'b'").count() == 3


def test_sequences_of_listed_segments(spark, frames_of):
    frames = frames_of(x=[1, None, 3], seg=[0, 0, 1])
    listed = spark.createDataFrame([(1, 0), (1, 7)], "entity long, seg long")
    found, absent = stores.load_sequences(frames, listed)
    assert [p["x"] for p in found.first()["seq"]] == [1, 0]
    assert [tuple(r) for r in absent.collect()] == [(1, 7)]
    assert stores.sequence_lengths(found).first()["max_length"] == 2


def test_cells_keep_commas_inside_quotes(spark, tmp_path):
    (tmp_path / "coordinates_highestspeed_20240827_1_1.csv").write_text(
        '"GlobalFrame","Note, free","Speed","X","Y"\n"1","a, b","3.5"," 1.5 ",2.5\n2,,"4",x,\n'
    )
    rows = track_files.scan_tracks(spark, str(tmp_path)).orderBy("row_no").collect()
    assert [(r["global_frame"], r["speed"], r["x"], r["y"]) for r in rows] == [(1, 3.5, 1.5, 2.5), (2, 4.0, None, None)]


def test_report_names_broken_and_absent_files(spark, folder):
    data = folder / "data" / "drug+ one"
    whole = (data / "coordinates_highestspeed_20240827_1_1.csv").read_text()
    (data / "cut.csv").write_text(whole[: whole.index("\n30,") + 6])
    (data / "texts.csv").write_text("GlobalFrame,Speed,X,Y\n1,fast,NaN,2\n2,1,,x\n")
    (data / "empty.csv").write_text("")
    (data / "header.csv").write_text("GlobalFrame,Speed,X,Y\n")
    (data / "other.csv").write_text("a,b\n1,2\n")
    listed = spark.createDataFrame([("drug+ one/cut.csv",), ("drug+ one/gone.csv",), ("drug+ one/empty.csv",)], "relative_path string")
    rows = {r["relative_path"].split("/")[-1]: r for r in track_files.scan_report(spark, str(folder / "data"), listed).collect()}
    status = {k: r["status"] for k, r in rows.items()}
    assert {k: status[k] for k in ("cut.csv", "texts.csv", "empty.csv", "header.csv", "other.csv", "gone.csv")} == {
        "cut.csv": "short lines", "texts.csv": "bad cells", "empty.csv": "missing", "header.csv": "no lines",
        "other.csv": "no columns", "gone.csv": "missing",
    }
    assert status["coordinates_highestspeed_20240827_1_1.csv"] == status["coordinates_highestspeed_20240827_12_3.csv"] == "ok"
    assert rows["texts.csv"]["bad_cells"] == 2 and rows["cut.csv"]["short_lines"] == 1 and rows["gone.csv"]["bytes"] is None


def test_stored_files_that_break_or_vanish(spark, frames_of, tmp_path):
    n = 400
    frames = frames_of(speed=[float(k) for k in range(n)], seg=[k // 10 for k in range(n)], label=[k // 10 % 2 for k in range(n)])
    path = str(tmp_path / "frames")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        stores.write_frames(frames, path)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert {r["status"] for r in manifest.stored_report(spark, path).collect()} == {"ok"}
    files = sorted((tmp_path / "frames" / "label=0").glob("*.parquet"), key=lambda f: f.stat().st_size)
    assert len(files) > 2
    cut, gone = files[-1], files[-2]
    lost = {f.name: {r["seg"] for r in spark.read.parquet(str(f)).collect()} for f in (cut, gone)}
    cut.write_bytes(cut.read_bytes()[: cut.stat().st_size // 2])
    gone.unlink()
    for f in (cut, gone):
        (f.parent / f".{f.name}.crc").unlink(missing_ok=True)
    status = {r["file"]: r["status"] for r in manifest.stored_report(spark, path).collect()}
    assert status.pop(f"label=0/{cut.name}") == "unreadable" and status.pop(f"label=0/{gone.name}") == "missing" and set(status.values()) == {"ok"}
    read = stores.read_frames(spark, path, tolerant=True)
    listed = frames.select("entity", "seg").distinct()
    found, absent = stores.load_sequences(read.withColumn("label", F.col("label").cast("int")), listed)
    assert {r["seg"] for r in absent.collect()} == set().union(*lost.values())
    assert found.count() == 40 - len(set().union(*lost.values()))


def test_whole_tracks_in_chunks_and_resampled(spark, frames_of):
    x = [float(k) if k % 5 else None for k in range(1, 101)]
    frames = frames_of(x=x, seg=[k // 10 for k in range(100)], entity=[1] * 97 + [2] * 3)
    chunks, absent = stores.load_full_sequences(frames, spark.createDataFrame([(1,), (2,), (9,)], "entity long"), 30)
    rows = {(r["entity"], r["chunk"]): r for r in chunks.collect()}
    assert [len(rows[1, k]["seq"]) for k in range(4)] == [30, 30, 30, 7] and rows[1, 3]["start"] == 90 and rows[1, 0]["n_frames"] == 97
    whole = [p["x"] for k in range(4) for p in rows[1, k]["seq"]]
    assert whole == [v or 0.0 for v in x[:97]]
    assert [r["entity"] for r in absent.collect()] == [9]
    lengths = stores.full_sequence_lengths(chunks).first()
    assert (lengths["min_length"], lengths["max_length"]) == (3, 97)
    for length in (2, 13, 50, 96, 97, 98, 300):
        got = {r["entity"]: [p["x"] for p in r["seq"]] for r in resampled_tracks(frames, length).collect()}
        step = 96 / (length - 1)
        want = [whole[96 if i == length - 1 else int(i * step)] for i in range(length)] if length <= 97 else whole + [0.0] * (length - 97)
        assert got[1] == want, length
        assert len(got[2]) == length


def test_bad_segments_get_a_message(spark, frames_of):
    rng = [0.1 * (k * 7 % 11) for k in range(60)]
    frames = frames_of(speed=rng, x=rng, y=rng[::-1], turning_angle=[v - 0.5 for v in rng], seg=[k // 20 for k in range(60)])
    wild = frames.withColumn("speed", F.when((F.col("seg") == 1) & (F.col("frame") == 25), F.lit(float("inf"))).otherwise(F.col("speed")))
    listed = spark.createDataFrame([(1, 0), (1, 1), (1, 2), (1, 3)], "entity long, seg long")
    clean = {r["seg"]: r for r in extract_features(frames).collect()}
    got = {r["seg"]: r for r in extract_checked(wild, listed).collect()}
    assert {k: r["error"] for k, r in got.items()} == {0: None, 1: "speed is not finite", 2: None, 3: "no frames"}
    for seg in (0, 2):
        assert [got[seg][f] for f in FEATURES] == [clean[seg][f] for f in FEATURES]
    assert all(got[1][f] is None and got[3][f] is None for f in FEATURES)


def test_signal_functions_report_what_they_cannot_do(spark):
    arrays = spark.createDataFrame(
        [(1, 0, 40, [float(k % 7) for k in range(40)], [0.1] * 40), (1, 1, 40, [1.0, float("inf")], [0.1] * 40)],
        "entity long, seg long, n_frames long, speed array<double>, turning array<double>",
    )
    got = {r["seg"]: r for r in signal_features(arrays, "spectrum", "wavelet", "roaming", errors=True).collect()}
    assert got[0]["error"] is None and got[0]["wavelet_speed_level0"] > 0
    assert got[1]["error"] == "ValueError: a value is not finite" and got[1]["wavelet_speed_level0"] is None


def test_jobs_from_files_to_both_grains(spark, folder):
    out = str(folder / "out")
    lookup = "Filename,Seconds5x\n/20240827_piworm01_1,25\n/20240827_piworm12_3,900\n"
    (folder / "lookup.csv").write_text(lookup)
    track = folder / "data" / "control" / "coordinates_highestspeed_20240827_12_3.csv"
    track.write_text(track.read_text().replace("\n36,1.8,", "\n36,Infinity,"))
    jobs.preprocess_folder(spark, str(folder / "data"), str(folder / "lookup.csv"), out, TrackParams(segment_len=10, interp_limit=1, long_gap=2, max_speed=float("inf")))
    metadata = spark.read.parquet(f"{out}/metadata").collect()
    assert {(r["original_file"], r["file"]) for r in metadata if r["seg"] == 1} == {
        (f"coordinates_highestspeed_20240827_{k}.csv", f"coordinates_highestspeed_20240827_{k}-segment1-preprocessed.csv") for k in ("1_1", "12_3")
    }
    assert {r["relative_path"] for r in metadata} == {"drug+ one", "control"}
    errors = jobs.extract_stored(spark, out).collect()
    assert [(r["seg"], r["error"]) for r in errors] == [(1, "speed is not finite")]
    segments = stores.load_features(spark, out, "segments")
    assert segments.count() == len(metadata) - 1 and {"file", "original_file", "relative_path", "file_id"} <= set(segments.columns)
    full = stores.load_features(spark, out, "full").collect()
    assert {r["file"] for r in full} == {f"coordinates_highestspeed_20240827_{k}-preprocessed.csv" for k in ("1_1", "12_3")}
