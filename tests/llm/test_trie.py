import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from reelquery.llm import trie
from tables import SF


def x_of(role, text):
    role, text = role or "", text or ""
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()


def slow(rows, graft):
    """(conv_id, turn, role, text) -> the nodes, by following every prefix of every conversation."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, x_of(role, text), role or "", text or ""))
    own = {c: [t[3:] for t in sorted(ts)] for c, ts in own.items()}
    built = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 4 if graft else 0
        base = c - int(abs(c) % 20 * (1 if c >= 0 else -1))
        built[c] = tuple(own.get(base, [])[:h] + ts[h:]) if graft and base != c else tuple(ts)
    members = defaultdict(list)
    for c, ts in built.items():
        for d in range(len(ts) + 1):
            members[ts[:d]].append(c)
    out = []
    for p, cs in members.items():
        under = [q for q in members if q[: len(p)] == p]
        saved = sum((len(members[q]) - 1) * len(q[-1][1].encode().split()) for q in under if q)
        leaf = sum(not any(r[:-1] == q for r in members if r) for q in under)
        ends = ",".join(map(str, sorted(c for c in cs if built[c] == p)))
        out.append((min(cs), len(p), min(members[p[:-1]]) if p else None, len(cs), sum(r[:-1] == p for r in members if r), leaf, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def found(df):
    return sorted(map(tuple, df.collect()), key=repr)


ODD = [
    (20, None, "user", "first of all"), (20, 0, "user", "hi  there"), (20, 1, None, None), (20, 2, "bot", "x" * 50_000), (20, 3, "user", ""),
    (21, 0, "user", "hi  there"), (21, 0, "user", "tie"), (21, 0, "user", "tie"), (21, None, None, "null turn"), (22, 5, "", "a b c"),
    (39, 1, "user", "short"), (40, 0, "user", "hi  there"), (-3, 0, "user", "below zero"), (None, 0, "user", "nobody's"), (61, 0, "a", "base is absent"), (1, 0, "a", "x"), (2, 0, "a", "x"),
]


@pytest.fixture(scope="module")
def talk(spark):
    df = spark.createDataFrame(ODD, "conv_id long, turn long, role string, text string")
    return df.withColumns({c: F.lit("clash") for c in ("x", "words", "depth", "digest", "kind", "skip", "parent", "owner", "path", "ends")}).repartition(4)


@pytest.mark.parametrize("graft", [False, True])
def test_odd_conversations(talk, graft):
    assert found(trie.prefix_trie(talk, graft)) == slow(ODD, graft)
    assert trie.prefix_trie(talk.limit(0), graft).count() == 0
    assert trie.prefix_trie(talk.filter("conv_id IS NULL"), graft).count() == 0


def test_all_conversations_turnless(spark):
    """Conversation 1 has h turns or fewer and no base."""
    c = next(c for c in range(1, 99) if c % 20 and zlib.crc32(str(c).encode()) % 4 == 3)
    rows = [(c, 0, "user", "gone")]
    assert found(trie.prefix_trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), True)) == slow(rows, True)


def test_as_sql(spark, same_as_sql):
    same_as_sql(trie.op13_prefix_trie(spark, SF), trie.SQL)


def test_shared_openings_copies_and_a_long_conversation(spark, monkeypatch):
    """A third has one opening, a third is one conversation, branches leave branches, one conversation is long; blocks of ids are small."""
    monkeypatch.setattr(trie, "IDS", 7)
    rows = [(c, t, "user", f"common {t}" if t < 3 else f"{c} says {t}") for c in range(0, 300, 3) for t in range(2 + c % 4)]
    rows += [(c, t, "user", f"copy {t}") for c in range(1, 300, 3) for t in range(4)]
    rows += [(c, t, "bot", f"branch {c // (30 if t < 2 else 10 if t < 4 else 3)} {t}") for c in range(2, 300, 3) for t in range(6)]
    rows += [(1000, t, "user", f"copy {t}") for t in range(60)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(6)
    assert found(trie.prefix_trie(df)) == slow(rows, False)
    assert found(trie.prefix_trie(df, True)) == slow(rows, True)
