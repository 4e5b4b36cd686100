import random

import pytest

from bioquery.llm import line_dedup as ld


def brute(rows, least):
    """Deletes the union of all runs of enough words that stand earlier in (id, line) order, without what overlaps the first."""
    docs = [(i, [x.rstrip() for x in (t or "").split("\n")]) for i, t in sorted(rows)]
    seen, gone = {}, {i: set() for i, _ in docs}
    for i, lines in docs:
        for s in range(len(lines)):
            weight = 0
            for e in range(s, len(lines)):
                weight += max(1, len(lines[e].split()))
                if weight >= least:
                    first = seen.setdefault(tuple(lines[s : e + 1]), (i, s))
                    if first[0] != i or s > first[1] + e - s:
                        gone[i] |= set(range(s, e + 1))
    return {i: "\n".join(x for k, x in enumerate((t or "").split("\n")) if k not in gone[i]) if gone[i] else t for i, t in rows}


@pytest.mark.parametrize(("seed", "least"), [(1, 4), (2, 9), (3, 6)])
def test_equals_brute_force(spark, seed, least):
    r = random.Random(seed)
    pool = [" ".join(f"w{r.randrange(30)}" for _ in range(r.choice([0, 1, 1, 2, 3, 5, 12]))) for _ in range(25)]
    passage = [pool[k] for k in (1, 2, 3, 4, 5, 6)]
    rows = [(0, None), (1, ""), (2, "\n" * 12), (3, "a\n" * 20), (4, "a\n" * 20)]
    for i in range(60):
        lines = [r.choice(pool) if r.random() < 0.5 else f"u{r.randrange(10**6)} x y" for _ in range(r.randrange(1, 12))]
        if r.random() < 0.4:
            at = r.randrange(len(lines))
            lines[at:at] = passage[r.randrange(3) :]
        rows.append((10 + 7 * i, "\n".join(lines)))
    rows += [(1000 + i, rows[r.randrange(len(rows))][1]) for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as pos", "2 as doc").repartition(3)
    got = {x.doc_id: x["__lines"].text for x in ld.delete_later_copies(df, least).collect()}
    assert got == brute(rows, least)


def test_edges(spark):
    df = spark.createDataFrame([(None, "x"), (5, None)], "doc_id long, text string")
    assert sorted((x.doc_id or 0, x["__lines"].text, x["__lines"].n_deleted) for x in ld.delete_later_copies(df).collect()) == [(0, "x", 0), (5, None, 0)]
    assert ld.delete_later_copies(df.limit(0)).count() == 0


def test_the_first_copy_stays_whole(spark):
    """Ten equal lines of five words: five of them are the first run of 25 words."""
    df = spark.createDataFrame([(1, "a b c d e\n" * 9 + "a b c d e"), (2, "x\n" + "a b c d e\n" * 6)], "doc_id long, text string")
    got = {x.doc_id: x["__lines"] for x in ld.delete_later_copies(df).collect()}
    assert got[1].text == "\n".join(["a b c d e"] * 5) and got[1].runs == "5:10"
    assert got[2].text == "x\n" and got[2].runs == "1:7"


def test_clashing_columns_long_texts_and_repeated_ids(spark):
    long = "\n".join(f"line {i} of a very long text" for i in range(60_000))
    again = "\n".join(f"{k} words that are in two rows of one id" for k in range(9))
    rows = [(1, long, "a", 1), (2, long + "\nand more", "b", 2), (3, long, "c", 3), (3, "short", "c", 3), (4, again, "d", 4), (4, again, "d", 4), (5, again, "e", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, __lines string, windows long")
    out = ld.delete_later_copies(df)
    assert out.columns[:-1] == df.columns and out.columns[-1] == "___lines"
    got = [(r.doc_id, r["__lines"], r.windows, r["___lines"].text) for r in out.collect()]
    assert sorted(got, key=str) == sorted([(1, "a", 1, long), (2, "b", 2, "and more"), (3, "c", 3, long), (3, "c", 3, "short"), (4, "d", 4, again), (4, "d", 4, again), (5, "e", 5, "")], key=str)
