"""Scans, parsers, manifests, model boundaries, audits."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelquery.operators import fingerprints as fp
from reelquery.sources import frames as src, media, subtitles

SRT = "﻿1\r\n00:00:01,000 --> 00:00:02,500\r\n<i>Hello</i> {\\an8}there\r\n\r\n2\n00:00:03,000 --> 00:00:04,000 X1:1\nsecond\nline\n\n3\nno arrow here\n\n4\n00:00:05,000 --> 00:00:06,000\n<b></b>\n"


@pytest.fixture(scope="module")
def library(tmp_path_factory):
    root = tmp_path_factory.mktemp("library")
    for p in ("series/Some Show/S1/Some.Show.S01E02.mkv", "series/Some Show/S1/Some.Show.S01E02.srt", "series/Some Show/S1/extra.mkv", "movies/A Film/film.MP4", "movies/A Film/notes.txt", "animated/Cartoon/c.avi"):
        f = root / p
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(SRT if p.endswith("srt") else "x")
    return str(root)


def test_scan(spark, library, tmp_path):
    found = media.scan(spark, library)
    rows = [(r["id"], r["type"], r["season"], r["episode"], bool(r["subtitle_path"])) for r in found.collect()]
    assert rows == [("cartoon", "animated", None, None, False), ("a_film", "movie", None, None, False), ("some_show_s01e02", "series", 1, 2, True)]
    media.save(found, str(tmp_path / "m"))
    again = media.load(spark, str(tmp_path / "m"), lines=True)
    assert media.by_id(again, "a_film").first()["title"] == "A Film"
    with pytest.raises(LookupError):
        media.by_id(again, "none")
    entries = subtitles.index(subtitles.files(spark, library), found).collect()
    assert [(e["media_id"], e["start"], e["end"], e["text"]) for e in entries] == [("some_show_s01e02", 1.0, 2.5, "Hello there"), ("some_show_s01e02", 3.0, 4.0, "second line")]


def test_tolerant_subtitles(spark):
    forms = [json.dumps([{"start": 2, "end": 3, "text": "b"}, {"start_seconds": 1, "content": "a"}]), json.dumps({"items": [{"start": 1, "end": 2, "subtitle": "x"}]}), json.dumps({"data": {"lines": [{"start": 1, "end": 2, "text": "y"}]}}), "{}", "not json"]
    got = spark.createDataFrame([(i, f) for i, f in enumerate(forms)], "i int, t string").orderBy("i").select(subtitles.tolerant(F.col("t")).alias("e")).collect()
    assert [[(e["start"], e["end"], e["text"]) for e in r["e"]] for r in got] == [[(1.0, 1.0, "a"), (2.0, 3.0, "b")], [(1.0, 2.0, "x")], [(1.0, 2.0, "y")], [], []]


def test_nested_candidates(spark):
    nested = spark.createDataFrame([(1, (0.5, ("m", 1, 2, "000001", 3)))], "q int, candidate struct<similarity: double, metadata: struct<media_id: string, season: int, episode: int, frame_id: string, timestamp_seconds: int>>")
    assert subtitles.flat_candidates(nested).first().asDict() == {"q": 1, "media_id": "m", "season": 1, "episode": 2, "frame_id": "000001", "timestamp_seconds": 3.0, "sim": 0.5}


def test_probe(spark):
    report = json.dumps({"streams": [{"codec_type": "audio"}, {"codec_type": "video", "width": 640, "height": 360, "avg_frame_rate": "25/1"}], "format": {"duration": "10.02"}})
    df = spark.createDataFrame([("a",)], "path string").withColumn("r", media.probe_with(lambda p: report)("path"))
    got = df.select(media.parsed_probe(F.col("r")).alias("i")).first()["i"].asDict()
    assert got == {"duration_seconds": 10.02, "fps": 25.0, "frame_count": 250, "width": 640, "height": 360}
    assert spark.range(1).select(media.parsed_probe(F.lit("{}")).alias("i")).first()["i"]["fps"] is None


def test_frames_and_vectors(spark, tmp_path):
    items = spark.createDataFrame([("m", "T", "series", 1, 2, None, "v")], "id string, title string, type string, season int, episode int, episode_title string, video_path string")
    paths = spark.createDataFrame([("m", "b.jpg"), ("m", "a.jpg")], "media_id string, image_path string")
    rows = src.manifest_rows(paths, items)
    man = src.manifests(rows)
    assert man.first()["frame_count"] == 2
    man.write.json(str(tmp_path / "man"))
    assert src.exploded(src.load_manifests(spark, str(tmp_path / "man"))).count() == 2
    assert [(r["frame_id"], r["timestamp_seconds"], r["image_path"]) for r in rows.orderBy("frame_id").collect()] == [("000001", 0, "a.jpg"), ("000002", 2, "b.jpg")]

    def load():
        return lambda xs: np.array([[len(x), 1.0, 2.0] for x in xs])

    enc = src.encoded(rows, load)
    assert all(abs(np.linalg.norm(r["embedding"]) - 1) < 1e-5 for r in enc.collect())
    assert src.encoded(rows.limit(0), load).count() == 0
    vec = enc.select("media_id", (F.col("frame_id").cast("int") - 1).alias("position"), "embedding")
    table = src.global_table(rows, vec)
    assert table.count() == 2
    src.save_frames(table, str(tmp_path / "t"))
    src.save_frames(table, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2
    assert src.missing(paths, rows.limit(1), "image_path").count() == 1
    assert [r["image_path"] for r in src.first_paths(paths, 1).collect()] == ["a.jpg"]
    d = spark.createDataFrame([("series", "T", 1, 2), ("movie", "F", None, None)], "k string, t string, s int, e int").select(src.frame_directory(F.col("k"), F.col("t"), F.col("s"), F.col("e")).alias("d"))
    assert [r["d"] for r in d.collect()] == ["series/T/S01/E02", "movie/F"]


@pytest.mark.parametrize("how, want", [("join", "one\ntwo words"), ("space", "one two words"), ("longest", "two words")])
def test_recognised(spark, how, want):
    rows = spark.createDataFrame([("p",)], "image_path string")
    got = src.recognised(rows, lambda: lambda p: ["one", " two  words", "one", ""], how).first()
    assert got["ocr_text"] == want


def test_audit_and_prototypes(spark):
    from tables import SF
    from reelquery.plans.base import frames

    fr = frames(spark, SF)
    p = fp.prototypes(fr)
    sums = {r["media_id"]: r["n"] for r in p.groupBy("media_id").agg(F.sum("cluster_size").alias("n")).collect()}
    assert sums == {r["media_id"]: r["count"] for r in fr.groupBy("media_id").count().collect()}
    assert fp.prototypes(fr.limit(0)).count() == 0
    media_ids = fr.select("media_id").distinct()
    bad = src.audit(media_ids.union(media_ids.filter("media_id = 'media_01'")), fr, fr.limit(0), 64)
    assert {r["problem"] for r in bad.collect()} == {"repeated media id", "no vectors"}


def test_external_programs_are_exchangeable(spark):
    videos = spark.createDataFrame([("m", "v.mkv", "d")], "media_id string, video_path string, directory string")
    got = src.extracted(videos, lambda v, d: [f"{d}/{i:06d}.jpg" for i in (1, 2)]).collect()
    assert [(r["media_id"], r["image_path"]) for r in got] == [("m", "d/000001.jpg"), ("m", "d/000002.jpg")]
    clips = spark.createDataFrame([("c", "v.mkv", [0.0, 1.5])], "clip_id string, video_path string, times array<double>")
    images = src.grabbed(clips, lambda v, t: f"{v}@{t}".encode())
    assert [(r["step"], bytes(r["image"])) for r in images.orderBy("step").collect()] == [(0, b"v.mkv@0.0"), (1, b"v.mkv@1.5")]
    pixels = src.decoded(images, lambda b: np.zeros((2, 3, 3))).first()
    assert (pixels["height"], pixels["width"], len(pixels["rgb"])) == (2, 3, 18)


def test_command_line(spark, tmp_path, library, capsys):
    from tables import SF
    from reelquery.__main__ import main
    from reelquery.plans.base import frames

    fr = frames(spark, SF)
    fr.write.parquet(str(tmp_path / "frames"))
    fr.filter("vec_id IN (3, 4)").select(F.col("vec_id").alias("query_id"), F.lit("c").alias("clip_id"), F.col("vec_id").alias("step"), "embedding").write.parquet(str(tmp_path / "vectors"))
    for what in ("image", "video"):
        main([what, str(tmp_path / "frames"), str(tmp_path / "vectors")], spark)
        assert "confidence" in capsys.readouterr().out
    main(["scan", library, str(tmp_path / "media")], spark)
    main(["query", "densest_cluster", SF], spark)
    assert "media_05" in capsys.readouterr().out


def test_strict_times(spark):
    from reelquery.functions.formats import strict_seconds

    assert spark.range(1).select(strict_seconds(F.lit("2.5")).alias("t")).first()["t"] == 2.5
    with pytest.raises(Exception, match="not a time"):
        spark.range(1).select(strict_seconds(F.concat(F.lit("x"), F.col("id").cast("string"))).alias("t")).collect()


def test_cache_of_recognised_texts(spark, tmp_path):
    from reelquery.sources import frames as fr

    asked = tmp_path / "asked"
    asked.mkdir()

    def load():
        def read(path):
            (asked / path).touch()
            return [f"text of  {path}"]

        return read

    cache = fr.OcrCache(spark, str(tmp_path / "cache"))
    assert cache.load().count() == 0
    rows = lambda *names: spark.createDataFrame([(n,) for n in names], "image_path string")
    assert {(r["image_path"], r["ocr_text"]) for r in cache.get(rows("a", "b", "a"), load).collect()} == {("a", "text of a"), ("b", "text of b")}
    for f in asked.iterdir():
        f.unlink()
    assert cache.get(rows("b", "c"), load).count() == 2 and {f.name for f in asked.iterdir()} == {"c"}
    assert cache.load().count() == 3


def test_new_items_are_encoded_once_and_counts_are_checked(spark, tmp_path):
    import pytest

    from reelquery.sources import frames as fr

    path, log = str(tmp_path / "index"), tmp_path / "log"
    log.mkdir()

    def load():
        import numpy as np

        def encode(values):
            for v in values:
                (log / v).touch()
            return np.ones((len(values), 4))

        return encode

    frames = spark.createDataFrame([("m1", "000001", "p1"), ("m1", "000002", "p2"), ("m2", "000001", "p3")], "media_id string, frame_id string, image_path string")
    assert fr.index_new(frames.filter("media_id = 'm1'"), path, load).count() == 2
    for f in log.iterdir():
        f.unlink()
    got = fr.index_new(frames, path, load)
    assert got.count() == 3 and {f.name for f in log.iterdir()} == {"p3"}
    assert fr.checked(got, frames, ["media_id"]).count() == 3
    with pytest.raises(ValueError, match="m2"):
        fr.checked(got.filter("media_id = 'm1'"), frames, ["media_id"])
    with pytest.raises(ValueError, match="m1"):
        fr.load_frames(spark, path, frames.filter("image_path <> 'p2'"))


def test_stored_prototypes(spark, tmp_path):
    import pytest

    from reelquery.sources import frames as fr

    rows = spark.createDataFrame([("m1", i, [1.0, 0.0]) for i in range(3)], "media_id string, prototype_index int, embedding array<double>")
    fr.save_table(rows, str(tmp_path / "p"))
    load = lambda n: fr.load_table(spark, str(tmp_path / "p"), "media_id string, prototype_index int, embedding array<double>", spark.createDataFrame([("m1", n)], "media_id string, n int"))
    assert load(3).count() == 3
    with pytest.raises(ValueError):
        load(2)


def test_image_variants():
    import numpy as np

    from reelquery.sources import frames as fr

    image = np.zeros((20, 30, 3), "u1")
    image[:, 15:] = 200
    grey, adaptive, parted = fr.image_variants(image)
    assert grey.shape == adaptive.shape == parted.shape == (40, 60)
    assert grey[20, 5] == 0 and grey[20, 50] == 200 and set(np.unique(parted)) == {0, 255}
    assert (parted[:, :28] == 0).all() and (parted[:, 32:] == 255).all()
    # slow forms of the weighted mean and of the histogram's threshold
    rng = np.random.default_rng(3)
    x = rng.integers(0, 256, (12, 9)).astype("u1")
    bell = np.exp(-0.5 * (np.arange(-2, 3) / 1.1) ** 2)
    kernel = np.outer(bell, bell) / bell.sum() ** 2
    wide = np.pad(x.astype(float), 2, mode="edge")
    assert np.allclose(fr.local_mean(x, 2), [[(wide[i : i + 5, j : j + 5] * kernel).sum() for j in range(9)] for i in range(12)])
    spread = lambda t: sum(len(p) * (p.mean() - x.mean()) ** 2 for p in (x[x <= t].astype(float), x[x > t].astype(float)) if len(p))
    assert spread(fr.otsu(x)) == max(spread(t) for t in range(256))


def test_hard_queries_that_are_lost(spark):
    from reelquery.operators import metrics

    hard = metrics.hard_queries(spark)
    ranked = hard.selectExpr("*", "1 AS position", "title AS found_title", "season AS found_season", "IF(seconds = 896, 99, episode) AS found_episode")
    before = hard.selectExpr("*", "IF(seconds = 2990, 2, 1) AS truth_rank")
    got = {r["seconds"]: (r["truth_rank"], r["lost"]) for r in metrics.hard_regression(ranked, hard, before).collect()}
    assert got[896] == (None, True) and got[2990] == (1, False) and len(got) == 7 and sum(x for _, x in got.values()) == 1
