"""Subtitle indexes of any nesting against a recursive reading of the same JSON."""

import json

import pytest

from reelquery.sources import subtitles

NAMES = ("entries", "subtitles", "segments", "lines", "items", "data")


def entry(x):
    if not isinstance(x, dict):
        return None
    first = lambda *names: next((x[n] for n in names if x.get(n) is not None), None)
    start, end, text = first("start", "start_seconds"), first("end", "end_seconds"), first("text", "content", "subtitle")
    try:
        return (float(start), float(end), "" if text is None else str(text))
    except (TypeError, ValueError):
        return None


def walk(x):
    if isinstance(x, list):
        return [e for e in map(entry, x) if e]
    if not isinstance(x, dict):
        return []
    for n in NAMES:
        if n in x and (got := walk(x[n])):
            return got
    return [entry(x)] if entry(x) else [e for v in x.values() for e in walk(v)]


def expected(text):
    try:
        data = json.loads(text)
    except ValueError:
        return []
    named = list(data.items()) if isinstance(data, dict) else [(next((x[n] for n in ("media_id", "id", "episode_id") if x.get(n)), None), x) for x in data if isinstance(x, dict)] if isinstance(data, list) else []
    return [(str(m), e) for m, v in named if m is not None for e in walk(v)]


E = lambda t, **more: {"start": t, "end": t + 1, "text": f"at {t}"} | more
TEXTS = [
    json.dumps({"a": [E(2), E(1), "no", None, {"start": 5}, {"start_seconds": "3.5", "end_seconds": 4, "content": "c"}, {"start": 7, "end": 8, "subtitle": 12}, {"start": 9, "end": 9}]}),
    json.dumps({"b": {"entries": [], "segments": {"lines": {"data": {"items": {"subtitles": [E(4), E(3)]}}}}, "other": [E(99)]}}),
    json.dumps({"c": {"x": {"y": [E(1)], "z": {"w": {"v": {"u": E(2)}}}}, "k": E(3), "n": 5}}),
    json.dumps({"d": E(6, entries={"data": "nothing"})}),
    json.dumps({"e": {"data": {"start": "?", "end": 2}, "items": [], "start": 1, "end": 2, "content": "own"}}),
    json.dumps({"f": {"subtitles": {"p": [E(1)], "q": {"items": {"r": [E(2)], "s": E(3)}}}, "entries": {"t": {}}}}),
    json.dumps([{"media_id": "g", "entries": [E(1)]}, {"id": "h", "data": {"x": {"y": {"z": [E(2)]}}}}, {"episode_id": 7, "lines": [E(3)]}, {"entries": [E(4)]}, 5, {"media_id": "", "id": "i", "start": 1, "end": 2}]),
    "not json", "5", "{}", "[]", "",
]


def test_every_nesting(spark, tmp_path):
    rows = spark.createDataFrame([(t,) for t in [*TEXTS, None]], "text string").repartition(3)
    got = [(r["media_id"], (r["start"], r["end"], r["text"])) for r in subtitles.subtitle_index(rows).collect()]
    want = [x for t in TEXTS for x in expected(t)]
    assert sorted(got) == sorted(want) and len({m for m, _ in want}) >= 9
    numbered = {}
    for r in subtitles.subtitle_index(rows).collect():
        numbered.setdefault(r["media_id"], []).append((r["entry_no"], r["start"]))
    assert all([n for n, _ in sorted(x)] == list(range(len(x))) and [t for _, t in sorted(x)] == sorted(t for _, t in x) for x in numbered.values())
    for i, t in enumerate(TEXTS):
        (tmp_path / f"{i}.json").write_text(t)
    assert subtitles.load_subtitle_index(spark, str(tmp_path)).count() == len(want)


@pytest.mark.parametrize("depth", [1, 9])
def test_depth_is_no_limit(spark, depth):
    value = [E(1), E(2)]
    for i in range(depth):
        value = {NAMES[i % 6] if i % 2 else f"k{i}": value}
    rows = spark.createDataFrame([(json.dumps({"m": value}),)], "text string")
    assert [r["text"] for r in subtitles.subtitle_index(rows).orderBy("entry_no").collect()] == ["at 1", "at 2"]


def test_none(spark):
    assert subtitles.subtitle_index(spark.createDataFrame([], "text string")).count() == 0
