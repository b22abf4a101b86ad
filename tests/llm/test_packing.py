import zlib
from collections import defaultdict

import numpy as np
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from reelquery.llm import packing


def check(rows, texts, window, path):
    t = Tokenizer.from_file(path)
    want = sorted(zlib.crc32(np.array(t.encode(x or "", add_special_tokens=False).ids + [1], "<u4").tobytes()) for _, x in texts)
    whole = defaultdict(int)
    for r in rows:
        whole[r["doc_id"], r["doc_tokens"]] += r["length"]
        assert 0 < r["length"] <= window
    assert sum(n for n in whole.values()) == sum(len(t.encode(x or "", add_special_tokens=False).ids) + 1 for _, x in texts)
    single = sorted(r["ids_crc32"] for r in rows if r["length"] == r["doc_tokens"])
    assert set(single) <= set(want)
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window
    return len(by)


def test_odd_documents(spark, odd, none, texts):
    path = packing.tokenizer_path()
    for window, shard in ((2048, 1500), (16, 3)):
        check(packing.pack(odd, window=window, shard=shard).collect(), texts, window, path)
    assert packing.pack(none).count() == 0


@given(st.text(max_size=60))
@settings(max_examples=300, deadline=None)
def test_ids_are_the_tokenizers(text):
    path = packing.tokenizer_path()
    try:
        text.encode()
    except UnicodeEncodeError:
        return
    want = Tokenizer.from_file(path) if not hasattr(test_ids_are_the_tokenizers, "t") else test_ids_are_the_tokenizers.t
    test_ids_are_the_tokenizers.t = want
    got = np.frombuffer(packing.known(path).ids([text])[0], "<u4").tolist()
    assert got == want.encode(text, add_special_tokens=False).ids


@given(st.lists(st.integers(1, 64), max_size=60))
@settings(max_examples=200, deadline=None)
def test_best_fit_decreasing(lengths):
    lengths = sorted(lengths, reverse=True)
    placed = packing.best_fit_decreasing(lengths, 64)
    rooms: list[int] = []  # the same by looking at every window
    for n, (which, offset) in zip(lengths, placed, strict=True):
        fits = [r for r in rooms if r >= n]
        if fits:
            assert 64 - offset == min(fits)
        else:
            assert which == len(rooms) and offset == 0
            rooms.append(64)
        assert rooms[which] == 64 - offset
        rooms[which] -= n
