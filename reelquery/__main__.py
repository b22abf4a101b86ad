"""python -m reelquery ...: the engine from the command line. Tables of results are printed whole, unless --limit says otherwise."""

from __future__ import annotations

import argparse
import importlib

from pyspark.sql import DataFrame, SparkSession, functions as F

from reelquery import catalog
from reelquery.operators import blockindex, knn, metrics, scoring
from reelquery.plans.present import shown
from reelquery.session import session
from reelquery.sources import frames as src, media
from reelquery.sources.versions import Published
from reelquery.streaming.clips import identify


def image(frames: DataFrame, vectors: DataFrame, k: int = 50, episodes: int = 5) -> DataFrame:
    """Episodes for images: ``vectors`` is query_id, embedding."""
    asked = vectors.select("query_id", F.lit(None).cast("long").alias("self_id"), "embedding")
    hits = knn.nearest(frames, asked, k).join(frames.select("vec_id", "media_id", "season", "episode", "ts"), "vec_id")
    return scoring.order_episodes(scoring.image_scores(hits), episodes)


def printed(rows: DataFrame, limit: int | None = None) -> None:
    """Rows under their column names, tab-separated, fetched partition by partition."""
    print(*rows.columns, sep="\t")
    for row in (rows if limit is None else rows.limit(limit)).toLocalIterator():
        print(*row, sep="\t")


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="reelquery", description=__doc__)
    p.add_argument("--limit", type=int, help="rows to print, all by default")
    sub = p.add_subparsers(dest="what", required=True)
    for name, k in (("image", 50), ("video", 20)):
        s = sub.add_parser(name, help="episodes of query vectors")
        s.add_argument("frames", help="table of frames: vec_id, media_id, season, episode, ts, embedding")
        s.add_argument("vectors", help="table of query vectors: query_id or clip_id and step, embedding")
        s.add_argument("--top-k-frames", type=int, default=k)
        s.add_argument("--top-k-episodes", type=int, default=5)
    s = sub.add_parser("scan", help="media of a folder")
    s.add_argument("folder")
    s.add_argument("out")
    s = sub.add_parser("manifests", help="frame manifests of images that are there already")
    s.add_argument("media")
    s.add_argument("images", help="table of media_id, image_path")
    s.add_argument("out")
    s.add_argument("--id", help="one media item instead of all")
    s = sub.add_parser("embed", help="encodes the frames of manifests that the index lacks, and publishes them")
    s.add_argument("manifests")
    s.add_argument("index", help="a published table")
    s.add_argument("encoder", help="module:function that returns an encoder")
    s.add_argument("--id", help="one media item instead of all")
    s = sub.add_parser("blocks", help="publishes the block index of a frame table")
    s.add_argument("frames")
    s.add_argument("out")
    s = sub.add_parser("audit", help="what keeps media from being indexed")
    s.add_argument("media")
    s.add_argument("frames")
    s = sub.add_parser("evaluate", help="finds sampled frames among all others")
    s.add_argument("frames")
    s.add_argument("--samples", type=int, default=50)
    s.add_argument("--top-k", type=int, default=10)
    s.add_argument("--seed", type=int, default=42)
    s.add_argument("--report", help="folder for the queries that fail, as JSON")
    s = sub.add_parser("query", help="a registered query")
    s.add_argument("name", choices=sorted(catalog.QUERIES))
    s.add_argument("tables")
    return p


def table(spark: SparkSession, path: str) -> DataFrame:
    """A published table's last version, or a folder's."""
    published = Published(spark, path)
    return published.read() if published.versions() else spark.read.parquet(path)


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = _parser().parse_args(args)
    spark = spark or session()
    one = lambda rows, key: rows if a.id is None else rows.filter(F.col(key) == a.id)
    if a.what == "scan":
        media.save(media.scan(spark, a.folder), a.out)
    elif a.what == "manifests":
        src.manifest_from_images(one(media.load(spark, a.media), "id"), one(spark.read.parquet(a.images), "media_id")).write.mode("overwrite").json(a.out)
    elif a.what == "embed":
        module, _, name = a.encoder.partition(":")
        load = getattr(importlib.import_module(module), name)
        index, rows = Published(spark, a.index), src.exploded(one(src.load_manifests(spark, a.manifests), "media_id"))
        new = src.missing(rows, index.items(), "media_id") if index.versions() else rows
        run = metrics.Measured(src.encoded_timed(new, load))
        index.publish(run.rows.drop("failed"))
        for name, value in run.report().items():
            print(name, value, sep="\t")
    elif a.what == "blocks":
        print("version", Published(spark, a.out).publish(blockindex.build(table(spark, a.frames))), sep="\t")
    elif a.what == "audit":
        frames = table(spark, a.frames)
        printed(src.audit(media.load(spark, a.media).select(F.col("id").alias("media_id")), frames, frames).filter("problem IS NOT NULL"), a.limit)
    elif a.what == "evaluate":
        found, missed = metrics.evaluation(table(spark, a.frames), a.samples, a.top_k, a.seed)
        printed(found)
        if a.report:
            missed.write.mode("overwrite").json(a.report)
    elif a.what == "query":
        printed(catalog.QUERIES[a.name](spark, a.tables), a.limit)
    else:
        frames, vectors = table(spark, a.frames), spark.read.parquet(a.vectors)
        find = image if a.what == "image" else lambda f, v, k, n: identify(v, f, k, n)
        printed(shown(find(frames, vectors, a.top_k_frames, a.top_k_episodes)), a.limit)


if __name__ == "__main__":
    main()
