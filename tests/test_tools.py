"""The command line's tools, and what they are made of."""

import json
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tables import SF
from reelquery.__main__ import main
from reelquery.operators import metrics
from reelquery.plans.base import frames
from reelquery.sources import frames as src
from reelquery.sources.versions import Published


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tools") / "frames")
    frames(spark, SF).write.parquet(path)
    return path


def out(capsys):
    lines = [line.split("\t") for line in capsys.readouterr().out.splitlines() if "\t" in line]
    return [dict(zip(lines[0], line, strict=True)) for line in lines[1:]]


def test_video_shows_the_time_of_the_best_frame(spark, stored, tmp_path, capsys):
    fr = spark.read.parquet(stored)
    fr.filter("media_id = 'media_08' AND frame_no IN (20, 21)").select(F.lit("c").alias("clip_id"), F.col("vec_id").alias("step"), "embedding").write.parquet(str(tmp_path / "v"))
    main(["video", stored, str(tmp_path / "v"), "--top-k-episodes", "2"], spark)
    rows = out(capsys)
    assert len(rows) == 2 and rows[0]["time"] in ("00:00:38.00", "00:00:40.00") and rows[0]["name"] == "media_08"


def test_all_rows_are_printed_unless_limited(spark, capsys):
    main(["query", "frame_numbering", SF], spark)
    assert len(out(capsys)) == 500
    main(["--limit", "3", "query", "frame_numbering", SF], spark)
    assert len(out(capsys)) == 3


def test_evaluate(spark, stored, tmp_path, capsys):
    main(["evaluate", stored, "--samples", "30", "--top-k", "20", "--report", str(tmp_path / "r")], spark)
    row = out(capsys)[0]
    fr = spark.read.parquet(stored).toPandas()
    drawn = {r["vec_id"] for r in metrics.sampled(spark.read.parquet(stored).repartition(7), 30).collect()}
    assert drawn == {r["vec_id"] for r in metrics.sampled(spark.read.parquet(stored), 30).collect()} and len(drawn) == 30
    x = np.array(fr["embedding"].tolist(), "f8")
    right = 0
    for i in fr.index[fr["vec_id"].isin(drawn)]:
        sims = x @ x[i]
        sims[i] = -9
        best = {}
        for j in sorted(np.lexsort((fr["vec_id"], -sims))[:20], key=lambda j: -sims[j]):
            best.setdefault(fr["media_id"][j], []).append(sims[j])
        score = {m: 0.6 * s[0] + 0.25 * np.mean(s[:3]) + 0.15 * np.mean(s[:5]) for m, s in best.items()}
        right += max(score, key=score.get) == fr["media_id"][i]
    assert int(row["queries"]) == 30 and float(row["top1"]) == pytest.approx(right / 30)
    assert spark.read.json(str(tmp_path / "r")).count() == 30 - right if right < 30 else True


ENCODER = """
import time

import numpy as np


def encoder():
    def encode(values):
        time.sleep(0.01)
        if any("bad" in v for v in values):
            raise ValueError("bad picture")
        return np.array([[len(v), 1.0] for v in values])

    return encode
"""


def test_embedding_is_measured_and_published(spark, tmp_path, capsys, monkeypatch):
    code = tmp_path / "code"
    code.mkdir()
    (code / "small_encoder.py").write_text(ENCODER)
    monkeypatch.syspath_prepend(str(code))
    spark.sparkContext.addPyFile(str(code / "small_encoder.py"))
    from small_encoder import encoder

    items = [{"media_id": m, "title": m, "type": "movie", "frame_count": n, "frames": [{"frame_id": f"{i:06d}", "timestamp_seconds": 2 * i, "timestamp_formatted": "", "image_path": f"{m}/{'bad' if m == 'b' and i == 3 else i}"} for i in range(n)]} for m, n in (("a", 5), ("b", 40))]
    for x in items:
        (tmp_path / f"{x['media_id']}.json").write_text(json.dumps(x))
    main(["embed", str(tmp_path / "*.json"), str(tmp_path / "index"), "small_encoder:encoder", "--id", "a"], spark)
    assert out(capsys)
    table = Published(spark, str(tmp_path / "index"))
    assert table.read().count() == 5
    rows = src.exploded(src.load_manifests(spark, str(tmp_path / "*.json")))
    run = metrics.Measured(src.encoded_timed(rows, encoder))
    table.publish(run.rows.drop("failed"))
    seen = run.report()
    assert seen["images"] == 45 and seen["failed"] == 1 and seen["seconds"] > 0 and seen["model_seconds"] >= 0.02
    assert seen["images_per_second"] == pytest.approx(45 / seen["seconds"])
    assert table.read().filter("embedding IS NULL").count() == 1 and table.read().count() == 45


def test_rows_without_their_other_half_are_counted(spark):
    f = spark.createDataFrame([("a", "000001"), ("a", "000002"), ("b", "000001")], "media_id string, frame_id string")
    v = spark.createDataFrame([("a", 0, [1.0]), ("b", 0, [1.0]), ("b", 1, [1.0]), ("c", 0, [1.0])], "media_id string, position int, embedding array<double>")
    assert {tuple(r) for r in src.unmatched(f, v).collect()} == {("a", 1, 0), ("b", 0, 1), ("c", 0, 1)}


def test_an_operator_that_fails_to_import_is_not_passed_over(monkeypatch):
    import sys

    import __spark_entry__ as e

    assert e._module("reelquery.absent") is None and e._module("absent") is None
    monkeypatch.setitem(sys.modules, "reelquery.schemas", None)
    with pytest.raises(ImportError):
        e.importlib.reload(e.importlib.import_module("reelquery.operators.scoring"))
