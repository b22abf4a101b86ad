import re

from hypothesis import given, settings, strategies as st

from tables import SF
from reelquery.llm import linededup


def near(a, b):
    """Whether one word put in, left out or replaced leads from a to b."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if abs(len(a) - len(b)) != 1:
        return False
    long, short = (a, b) if len(a) > len(b) else (b, a)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def slow(rows):
    """(doc, text) -> (doc, text, exact, near) by looking at all pairs of lines."""
    place = lambda d, i: (d is not None, d or 0, i)
    lines = [(place(d, i), re.findall(r"[^\x20\x09-\x0D]+", x)) for d, t in rows if t is not None for i, x in enumerate(t.split("\n"))]
    first = {}
    for p, w in lines:
        if w:
            first[tuple(w)] = min(p, first.get(tuple(w), p))
    gone = {w for w, p in first.items() if any(q < p and max(len(v), len(w)) >= linededup.PER_EDIT and near(list(v), list(w)) for v, q in first.items())}
    out = []
    for d, t in rows:
        if t is None:
            out.append((d, None, 0, 0))
            continue
        kept, e, n = [], 0, 0
        for i, x in enumerate(t.split("\n")):
            w = tuple(re.findall(r"[^\x20\x09-\x0D]+", x))
            if w and place(d, i) > first[w]:
                e += 1
            elif w in gone:
                n += 1
            else:
                kept.append(x)
        out.append((d, "\n".join(kept), e, n))
    return sorted(out, key=repr)


def fast(df):
    assert linededup.deduped(df).columns == df.columns
    return sorted(((r["row"]["doc_id"], r["text"], r["n_exact"], r["n_near"]) for r in linededup.marked(df).collect()), key=repr)


def test_sql(spark, same_as_sql):
    same_as_sql(linededup.op8_line_dedup(spark, SF), linededup.SQL)


def test_odd_documents(spark, odd, none, texts):
    assert fast(odd) == slow(texts)
    assert linededup.deduped(none).count() == 0


word = st.sampled_from("a b c d".split())


@given(st.lists(st.tuples(st.integers(0, 5), st.lists(st.lists(word, min_size=0, max_size=11).map(" ".join), max_size=3).map("\n".join)), min_size=1, max_size=12, unique_by=lambda r: r[0]))
@settings(max_examples=6, deadline=None)
def test_against_all_pairs(spark, rows):
    assert fast(spark.createDataFrame(rows, "doc_id long, text string")) == slow(rows)


def test_many_variants_of_one_line(spark):
    base = [f"w{i}" for i in range(12)]
    rows = [(i, " ".join(base[: i % 12] + [f"x{i}"] + base[i % 12 + 1 :])) for i in range(60)]
    rows += [(100 + i, " ".join(base[:i] + base[i + 1 :])) for i in range(12)] + [(200, " ".join(base)), (-1, " ".join(base[:5] + base[6:]))]
    assert fast(spark.createDataFrame(rows, "doc_id long, text string")) == slow(rows)


def test_documents_without_ids(spark):
    rows = [(None, f"a line of its own with number {i} in it and more words\nand one that all of them have in common here") for i in range(30)]
    rows += [(3, "and one that all of them have in common there"), (4, "a line of its own with number 7 in it and more")]
    assert fast(spark.createDataFrame(rows, "doc_id long, text string")) == slow(rows)
